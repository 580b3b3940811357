import random

import pytest

from tessella.llm import op5_html as m


@pytest.mark.parametrize(
    "page, want",
    [
        ("", ""),
        ("plain", "plain"),
        ("<body><nav>menu</nav><article><h1>T&amp;t</h1><p>a\n b<p>c<b>d</b></article><footer>f</footer>", "T&t\n\na b\n\ncd"),
        ("<body><article><p>one</p><div class='comments'><p>reader</p></div><form><p>x</p></form><p>two<br>lines</p></article>", "one\n\ntwo lines"),
        ("<body><div id=sidebar><p>side side side</p></div><div class=content><p>main text of page</p><script>var a='</p>';</script></div>", "main text of page"),
        ("<body><header>site</header><article><header><h1>Title</h1></header><p>x</p><!-- a <p>no</p> --></article>", "Title\n\nx"),
        ("<article><ul><li>a<li>b</ul>&lt;p&gt;&nbsp;&#8364;</article>", "a\n\nb\n\n<p> €"),
        ("<article><p>unclosed <b>bold</article></div></p> <p>after", "unclosed bold"),
        ("<div class='cookie-notice'>We use</div><div><p>A < B and C</p></div><p", "A < B and C"),
        ("<article><p>5 < 6 &copy; <a href=\"x>y\">link</a></p></article>", "5 < 6 © link"),
        ("<nav>only menu</nav>", ""),
        ("<body><div class=wrap><div class=head><h1>Title here</h1></div><div class=copy><p>long text of the page</p></div></div><div class=x><a href=/>links</a></div>", "Title here\n\nlong text of the page"),
        ("<body><h1>Title</h1><div class=copy><p>long text of the page</p></div><footer>f</footer>", "Title\n\nlong text of the page"),
        ("<body><h1>Site</h1><p>slogan</p><div class=copy><p>long text of the page it is</p></div>", "long text of the page it is"),
        ("<article><p>text of it</p><figure class=header-image><figcaption>caption</figcaption></figure><p class='notice-of-award'>award</p></article>", "text of it\n\ncaption\n\naward"),
        ("<article><p>text of it</p><fieldset><label>a choice</label></fieldset><div class='ad-slot'>buy</div><div id=site-footer>f</div></article>", "text of it\n\na choice"),
        ("<article><p>text of it</p><div class='cookie-consent'>c</div><div class='post-comments'>c</div><div class='comment-list'>c</div></article>", "text of it"),
    ],
)
def test_pages(page, want):
    assert m.text_at(m.read(page), None) == want


def test_host_consensus_beats_one_page(spark):
    good = "<body><div class='story 12'><p>{0} {0} {0} {0}</p></div><div class='extra'><p>short</p></div></body>"
    odd = "<body><div class='story 7'><p>tiny</p></div><div class='extra'><p>{0}</p></div></body>".format("much longer text " * 9)
    rows = [(i, "https://Host.example/a?b", good.format(f"word{i}"), "x") for i in range(5)] + [(9, "http://host.example/z", odd, "x"), (10, None, None, "x"), (11, "http://other.example", "", "x"), (9, "http://host.example/z", odd, "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    for limit in (m.BROADCAST_HOSTS, 0):
        out = {}
        for r in m.extract(pages, limit).collect():
            out.setdefault(r.page_id, []).append((r.text, r.path))
        assert out[9] == [("tiny", ">body>div.#.story")] * 2 and out[0][0][0] == " ".join(["word0"] * 4)
        assert out[10] == [("", None)] and out[11] == [("", None)] and sum(map(len, out.values())) == len(rows)
    assert m.extract(pages.limit(0)).count() == 0


def test_votes_against_brute_force(spark):
    """Random hosts of two layouts; the vote changes what odd pages and ties give."""
    rng = random.Random(5)
    text = lambda n: " ".join(rng.choice("alpha beta gamma delta".split()) for _ in range(n))
    rows = [(i, f"http://h{rng.randrange(12)}.example/{i}", f"<body><div class=a><p>{text(rng.randrange(1, 12))}</p></div><div class='b {i}'><p>{text(rng.randrange(1, 12))}</p></div>") for i in range(60)]
    rows += [(100 + i, "http://tie.example", f"<body><div class={c}><p>one two three</p></div><div class=z><p>x</p></div>") for i, c in enumerate("qr")]
    tally, first = {}, {}
    for i, url, page in rows:
        found = sorted(m.read(page), key=lambda e: -e.score)[:2]
        first[i] = found[0].path
        for k, e in enumerate(found):
            host_votes = tally.setdefault(url.split("/")[2], {})
            host_votes[e.path] = host_votes.get(e.path, 0) + (m.RUNNER_UP * e.score / found[0].score if k else 1.0)
    win = {h: max(v, key=lambda p: (round(v[p], 6), p)) for h, v in tally.items()}
    got = {r.page_id: (r.path, r.text) for r in m.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i, url, page in rows:
        path = win[url.split("/")[2]]
        assert got[i][0] == path
        blocks = {n: t for e in m.read(page) if e.path == path for n, t, _ in e.blocks}
        if blocks:
            assert got[i][1] == "\n\n".join(t for _, t in sorted(blocks.items()))
    assert sum(first[i] != win[url.split("/")[2]] for i, url, _ in rows) > 5 and win["tie.example"].endswith("div.r")


def test_long_page():
    page = "<body><article>" + "<p>some words here</p>" * 20000 + "</article>"
    assert m.text_at(m.read(page), ">body>article").count("\n\n") == 19999
