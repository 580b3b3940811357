import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tessella.llm import op3_repeats as m


def brute(rows, length, passage=6):
    """The contract by all strings of the length, and the runs of words in repeated strings of ``passage`` words."""
    data = [(t or "").encode() for _, t in rows]
    words = [re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for _, t in rows]
    covered = []
    for parts, n in ((data, length), ([tuple(w) for w in words], passage)):
        seen = Counter(d[i : i + n] for d in parts for i in range(len(d) - n + 1))
        covered.append([])
        for d in parts:
            gone = np.zeros(len(d), bool)
            for i in range(len(d) - n + 1):
                if seen[d[i : i + n]] > 1:
                    gone[i : i + n] = True
            covered[-1].append(gone)
    runs = lambda gone: int((gone & ~np.r_[False, gone[:-1]]).sum()) if len(gone) else 0
    out = []
    for (doc, _), d, gone, passages in zip(rows, data, *covered):
        rest = bytes(b for b, g in zip(d, gone) if not g)
        out.append((doc, len(d), int(gone.sum()), runs(gone), hashlib.sha256(rest).hexdigest(), runs(passages)))
    return sorted(out, key=str)


def units(length, gram, passage=6, passage_gram=2):
    return m.Unit(length, gram), m.Unit(passage, passage_gram, True)


def result(df):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, r.n_passages) for r in df.collect()), key=str)


def corpus(seed, n=60, size=300):
    rng = random.Random(seed)
    passages = ["".join(rng.choice("abcdA é ") for _ in range(rng.randrange(10, 160))) for _ in range(8)]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rng.randrange(6)):
            parts.append("".join(rng.choice("abcdA é ") for _ in range(rng.randrange(60))) if rng.random() < 0.5 else rng.choice(passages)[rng.randrange(8) :])
        rows.append((i, "".join(parts)[:size * 2]))
    return rows + [(100, None), (101, ""), (102, "x" * 500), (103, "ab" * 200), (104, "ab" * 40), (5, rows[5][1]), (5, "other " * 20), (None, rows[6][1])]


@pytest.mark.parametrize("seed, length, gram, hot", [(1, 40, 12, 10**6), (2, 40, 40, 10**6), (3, 30, 1, 10**6), (4, 40, 12, 2)])
def test_against_brute_force(spark, seed, length, gram, hot):
    rows = corpus(seed)
    docs = spark.createDataFrame([(a, b, 1, 2) for a, b in rows], "doc_id long, text string, k1 int, gram int")
    want = brute(rows, length)
    assert result(m.remove(docs, units(length, gram), hot)) == want and sum(x[2] for x in want) > 1000 and sum(x[5] for x in want) > 20


def test_defaults_and_no_rows(spark):
    rng = random.Random(3)
    block = "".join(rng.choice("etaoin shrdlu") for _ in range(700))
    rows = [(1, block), (2, "head " + block[100:600] + " tail"), (3, block[:399]), (4, block[-400:] + "é" * 300000), (5, "unique " * 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = result(m.remove(docs))
    # Without the long run the rest is the same, and small enough for brute force.
    short = [(a, b[:400] if a == 4 else b) for a, b in rows]
    assert [x for x in out if x[0] != 4] == [x for x in brute(short, 400, 51) if x[0] != 4]
    four = next(x for x in out if x[0] == 4)
    assert four[1] == 600400 and four[2] == 600400 and four[3] == 1  # the run of é repeats within itself
    assert m.remove(docs.limit(0)).count() == 0


def test_interval_tree_and_repeats():
    text = "banana$"
    suffixes = sorted(range(len(text)), key=lambda i: text[i:])
    after = [text[i:].encode() for i in suffixes]
    before = [text[:i][::-1].encode() for i in suffixes]
    lcp = [m.common_prefix(a, b) for a, b in zip(after, after[1:])]
    nodes = list(m.interval_tree(lcp))
    assert sorted(d for d, _ in nodes) == [0, 1, 2, 3]
    found = {text[suffixes[i] - l : suffixes[i] + r] for i, j, l, r in m.repeats(before, after, 1)}
    assert {"ana", "a"} <= found and not found & {"n", "an"}


@pytest.mark.parametrize("n", [60, 120])
def test_planted_passages_of_over_50_words(spark, n):
    """A passage under 400 bytes is counted and stays; one of 400 bytes or more is counted and removed."""
    rng = random.Random(n)
    word = lambda: "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(2, 8)))
    passage, short = (" ".join(word() for _ in range(k)) for k in (n, 51))
    less = " ".join(word() for _ in range(50))
    rows = []
    for i in range(30):
        own = lambda: " ".join(word() for _ in range(rng.randrange(5, 80)))
        rows.append((i, "\n".join([own(), *([passage], [short.upper()], [less], [])[i % 4], own()])))
    out = result(m.remove(spark.createDataFrame(rows, "doc_id long, text string")))
    assert out == brute(rows, 400, 51)
    assert all(x[5] == (x[0] % 4 < 2) and (x[2] > 0) == (x[0] % 4 == 0 and len(passage) >= 400) for x in out)


def test_maximal_repeat_groups(spark):
    a, b, c = "x" + "shared passage one" + "yy1", "zz" + "shared passage one" + "w2", "q" + "shared passage one" + "y"
    docs = spark.createDataFrame([(1, a), (2, b), (3, c)], "doc_id long, text string")
    got = defaultdict(set)
    for r in m.repeat_groups(docs, 16, 8).collect():
        got[r.length].add(r.k1)
    assert got[18] == {1, 2, 3} and got[19] == {1, 3}


def closed(groups, rows, length):
    """Occurrences of each string of ``length`` in the parts that the groups join, by content; all of a group must be equal."""
    data = {a: b.encode() for a, b in rows}
    root, first = {}, {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for r in groups:
        head = first.setdefault((r.repeat, r.length), r)
        assert r.length >= length and r.start >= 0 and data[r.k1][r.start : r.start + r.length] == data[head.k1][head.start : head.start + r.length] and len(data[r.k1]) >= r.start + r.length
        for i in range(r.length - length + 1):
            root[find((r.k1, r.start + i))] = find((head.k1, head.start + i))
    parts = defaultdict(set)
    for x in list(root):
        parts[find(x)].add(x)
    return sorted(sorted(x) for x in parts.values())


def occurrences(rows, length):
    seen = defaultdict(list)
    for a, b in rows:
        for i in range(len(b.encode()) - length + 1):
            seen[b.encode()[i : i + length]].append((a, i))
    return sorted(sorted(x) for x in seen.values() if len(x) > 1)


@pytest.mark.parametrize("seed, gram", [(1, 12), (2, 40), (3, 4)])
def test_repeat_groups_of_copies(spark, seed, gram):
    texts = [b for a, b in corpus(seed)[:25]]
    rows = list(enumerate(texts + texts[:12] + texts[:12] + texts[5:8] * 10))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = occurrences(rows, 40)
    assert closed(m.repeat_groups(docs, 40, gram).collect(), rows, 40) == want and len(want) > 500


def test_repeat_groups_where_all_contexts_are_copies(spark):
    shared = "".join(random.Random(4).choice("abcdefgh") for _ in range(50))
    only = "".join(random.Random(5).choice("ijklmnop") for _ in range(60))
    rows = [(1, "Q1" + shared + "R1"), (2, "Q1" + shared + "R1"), (3, "S2" + shared + "T2"), (4, "S2" + shared + "T2"), (5, only), (6, only), (7, only)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = m.repeat_groups(docs, 40, 12).collect()
    assert closed(got, rows, 40) == occurrences(rows, 40)
    twice = spark.createDataFrame([(1, only), (1, only)], "doc_id long, text string")
    assert {(r.k1, r.rows) for r in m.repeat_groups(twice, 40, 12).collect()} == {(1, 2)}
