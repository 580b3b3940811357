import random
import re

import numpy as np

from tessella.llm import op9_minhash as m


def shingles(text, width):
    w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda x: x[0].lower(), (text or "").encode()))
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def brute(rows, width, percent):
    sets = [shingles(t, width) for _, t in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[top(i)] = min(least.get(top(i), d), d)
    return sorted((d, len(sets[i]), least[top(i)]) for i, (d, _) in enumerate(rows))


def corpus(rng, groups=25, size=12, spread=6):
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(4)) for _ in range(400)]
    rows = []
    for _ in range(groups):
        base = [rng.choice(vocabulary) for _ in range(rng.randrange(30, 160))]
        for _ in range(rng.randrange(1, size)):
            w = list(base)
            for _ in range(rng.randrange(spread)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(w)))
    rng.shuffle(rows)
    return rows


def test_components_match_brute_force(spark):
    rng = random.Random(9)
    rows = corpus(rng) + [(900, None), (901, ""), (902, " \n"), (903, "One"), (904, "one"), (905, "one two"), (906, "one two"), (907, "Ünï CODE"), (3, dict(corpus(random.Random(9)))[3])]
    docs = spark.createDataFrame([(a, b, 1) for a, b in rows], "doc_id long, text string, cls int")
    out = sorted((r.k1, r.n, r.root) for r in m.near_classes(docs).collect())
    assert out == brute(rows, 3, 85)


def test_large_groups_of_near_copies(spark):
    rows = corpus(random.Random(6), groups=3, size=400, spread=14)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows, 3, 85)
    assert sorted((r.k1, r.n, r.root) for r in m.near_classes(docs).collect()) == want
    assert len({c for *_, c in want}) > 3


def test_regions_are_held_against_themselves(spark):
    """Without trees' help beyond one pair a region still gives all its links, in slices of any size."""
    words = [f"w{i}" for i in range(60)]
    texts = {i: " ".join(words[: 40 + i]) for i in range(12)}
    sets = {i: np.array(sorted(hash(x) & (2**63 - 1) for x in shingles(t, 3)), np.uint64) for i, t in texts.items()}
    table = spark.createDataFrame([(i, bytearray(v.tobytes())) for i, v in sets.items()], "cls long, words binary")
    pairs = spark.createDataFrame([(i, i + 1) for i in range(11)], "a long, b long")
    none = spark.createDataFrame([(i, i) for i in range(12)], "v long, root long")
    for size in (2, 5, 100):
        links = m.across_regions(pairs, none, table, 85, size)
        assert {(r.v, r.root) for r in m.components(links).collect()} == {(i, 0) for i in range(12)}


def test_dedup_keeps_one_of_each(spark):
    rows = [(5, "a b c d e f g h"), (2, "a b c d e f g h"), (7, "other words in here now"), (8, None), (8, None), (9, ""), (7, "other words in here now")]
    docs = spark.createDataFrame([(a, b, "__n") for a, b in rows], "doc_id long, text string, n string")
    out = m.dedup(docs)
    assert out.columns == docs.columns
    assert sorted((r.doc_id, r.text or "") for r in out.collect()) == [(2, "a b c d e f g h"), (7, "other words in here now"), (8, ""), (8, ""), (9, "")]
    assert m.dedup(docs.limit(0)).count() == 0


def test_components_of_a_path(spark):
    n = 60
    order = list(range(n))
    random.Random(1).shuffle(order)
    links = spark.createDataFrame([(min(a, b), max(a, b)) for a, b in zip(order, order[1:])], "a long, b long")
    assert {r.root for r in m.components(links).collect()} == {0}


def test_minhash_estimates(spark):
    words = [f"w{i}" for i in range(300)]
    a, b = " ".join(words[:250]), " ".join(words[25:275])
    import pyarrow as pa

    (_, _, buf, offs), = m.text_buffers(pa.array([a, b]))
    sets, at = m.shingle_sets(buf, offs, 3)
    sig = m.minhash(sets, at)
    x, y = shingles(a, 3), shingles(b, 3)
    assert abs((sig[0] == sig[1]).mean() - len(x & y) / len(x | y)) < 0.15 and np.diff(at).tolist() == [248, 248]
