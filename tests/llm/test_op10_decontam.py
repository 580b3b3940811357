import random
import re
import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from tessella.llm import op10_decontam as m


def semi_global(item, text):
    """Least edits of item against any part of text, whole matrix."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def words(rng, n):
    return " ".join("".join(rng.choice("etaoin shr") for _ in range(rng.randrange(2, 9))).strip() or "x" for _ in range(n))


def edited(rng, s, k):
    s = list(s)
    for _ in range(k):
        at = rng.randrange(len(s))
        kind = rng.randrange(3)
        if kind == 0:
            s[at] = "Z"
        elif kind == 1:
            del s[at]
        else:
            s.insert(at, "q")
    return "".join(s)


def whole(item, raw):
    """Whether a short item stands in a text as whole tokens."""
    inner = r"[0-9a-z_A-Z\x80-\xff]".encode()
    return re.search((b"(?<!" + inner + b")" if re.match(inner, item[:1]) else b"") + re.escape(item) + (b"(?!" + inner + b")" if re.match(inner, item[-1:]) else b""), raw) is not None


def test_against_whole_matrix():
    rng = random.Random(10)
    items = [(i, m.normal(words(rng, rng.randrange(2, 40)).encode())) for i in range(24)] + [(50, b"tiny item"), (51, b"x" * 19), (52, b"a b"), (53, b"+1")]
    assert {m.gram_size(len(t)) for _, t in items} >= {None, 4, 6, 7, 8}
    index = m.Index(items)
    caught = 0
    for n in range(120):
        text = words(rng, rng.randrange(60))
        if n % 3:
            i = rng.randrange(24)
            k = m.budget(len(items[i][1])) if n % 2 else m.budget(len(items[i][1])) * 2
            text += " " + edited(rng, items[i][1].decode(), k) + " " + words(rng, 10)
        raw = m.normal((text + rng.choice([" a b", "a b", " tiny item", "+1", "x+1", ""])).encode())
        got = {h["item_id"] for h in m._text_hits(index, raw)}
        want = {i for i, t in items if (semi_global(t, raw) <= m.budget(len(t)) if m.gram_size(len(t)) else whole(t, raw))}
        assert got == want
        caught += len(want)
    assert caught > 40


def test_slices_of_pairs_lose_nothing(monkeypatch):
    rng = random.Random(3)
    items = [(i, m.normal(words(rng, 12).encode())) for i in range(6)] + [(9, b"ab" * 60)]
    text = " ".join(words(rng, 30) + " " + edited(rng, t.decode(), m.budget(len(t))) for _, t in items * 3)
    raw = m.normal(text.encode())
    want = m._text_hits(m.Index(items), raw)
    for pairs in (1, 7, 100):
        monkeypatch.setattr(m, "PAIRS", pairs)
        assert m._text_hits(m.Index(items), raw) == want and len(want) >= 6


def test_repetitive_text_in_bounded_memory():
    """One item of 200 dashes, and one that never fits, against a line of two million dashes."""
    index = m.Index([(1, b"-" * 200), (2, b"-" * 150 + bytes(range(97, 123)) * 2)])
    tracemalloc.start()
    got = m._text_hits(index, b"-" * 300_000)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [(h["item_id"], h["start"], h["edits"]) for h in got] == [(1, 0, 0)] and peak < 300 << 20


def test_short_items_need_whole_tokens():
    index = m.Index([(1, b"yes"), (2, b"no.")])
    ids = lambda t: [h["item_id"] for h in m._text_hits(index, t)]
    assert ids(b"eyesight, no.") == [2] and ids(b"eyes yes") == [1] and ids(b"yes") == [1] and ids("yesé".encode()) == [] and ids(b"piano. no") == []


def test_banded_distances_are_exact_in_their_bands():
    one = lambda item, text, shift, width, k: m.banded_distances(item, text, np.array([shift]), width, k)[0]
    assert one(b"abcdef", b"xxabcdefyy", 2, 0, 0) == (0, 8)
    assert one(b"abcdef", b"xxabXdefyy", 1, 2, 2)[0] == 1
    assert one(b"abcdef", b"", 0, 2, 1) is None
    rng = random.Random(2)
    for _ in range(60):
        item = words(rng, 4).encode()
        text = (words(rng, 3) + edited(rng, item.decode(), rng.randrange(4)) + words(rng, 2)).encode()
        k = 3
        got = m.banded_distances(item, text, np.arange(-k, len(text) - len(item) + k), 2 * k, k)
        least = min((g[0] for g in got if g), default=None)
        want = semi_global(item, text)
        assert least == (want if want <= k else None)


def test_edges(spark):
    item = "The quick brown fox jumps over the lazy dog near the river bank today."
    rows = [(1, None, "h"), (2, "", "h"), (3, item.upper().replace(" ", "\n\t"), "h"), (4, "word " * 300000 + item, "h"), (4, "word " * 300000 + item, "h"), (None, item, "h"), (5, "clean words only here", "h")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, benchmark_hits string")
    bench = spark.createDataFrame([(7, item, 1), (8, item, 1), (9, None, 1), (10, "", 1)], "item_id long, text string, doc_id int")
    out = m.find(docs, bench).select("doc_id", F.transform("benchmark_hits", lambda h: h["item_id"]).alias("ids")).collect()
    assert len(out) == 7 and all(r.ids == ([7, 8] if r.doc_id in (3, 4, None) else []) for r in out)
    assert sorted(r.doc_id for r in m.clean(docs.drop("benchmark_hits"), bench).collect()) == [1, 2, 5]
    assert m.find(docs, bench, block=1).where(F.size("benchmark_hits") == 2).count() == 4
    assert m.find(docs.limit(0), bench).count() == 0 and m.find(docs, bench.limit(0)).where(F.size("benchmark_hits") > 0).count() == 0


def test_letters_beyond_ascii_are_lowered():
    item = "Été à l'école, où l'élève étudie la géométrie différentielle et l'algèbre"
    index = m.Index([(1, m.normal(item.encode()))])
    assert m._text_hits(index, m.normal(("AVANT " + item.upper() + " APRÈS").encode()))[0]["edits"] == 0
