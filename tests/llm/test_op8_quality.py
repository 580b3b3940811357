import itertools
import math
import random

import numpy as np
import pyarrow as pa
import pytest

from tessella.llm import op8_quality as m


def brute_marginals(emission, move):
    """Sum over all paths of one chain."""
    n, top = len(emission), 0.0
    good = np.zeros(n)
    for path in itertools.product((0, 1), repeat=n):
        p = math.exp(sum(e * s for e, s in zip(emission, path)) + sum(move[a, b] for a, b in zip(path, path[1:])))
        top += p
        good += p * np.array(path)
    return good / top


def test_marginals_match_enumeration():
    rng = np.random.default_rng(8)
    rows = np.repeat([0, 1, 2], [1, 5, 9])
    e, move = rng.normal(size=15) * 3, rng.normal(size=(2, 2))
    got = m.chain(e, move, rows)
    for r in range(3):
        assert np.allclose(got[rows == r], brute_marginals(e[rows == r], move))


def test_gradient_of_transitions_is_expected_minus_seen():
    _, gap = m.chain(np.zeros(4), np.zeros((2, 2)), np.zeros(4, int), np.array([0, 1, 1, 0]))
    assert np.allclose(gap, 0.75 - np.array([[0, 1], [1, 1]]))


def test_features_do_not_cross_rows():
    column = pa.array(["aa bb\n\ncc", None, "", "aa bb\n\ncc"])
    (_, _, buf, offs), = m.text_buffers(column)
    x, size, rows = m.features(buf, offs)
    assert rows.tolist() == [0, 0, 1, 2, 3, 3] and np.array_equal(x[:2], x[4:]) and size[2] == 0


def corpus(n, seed=0):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(2, 9)))
    out = []
    for i in range(n):
        lines = [" ".join(word() for _ in range(rng.randrange(4, 15))) + "." for _ in range(rng.randrange(1, 12))]
        if i % 3 == 0:
            lines = [" | ".join(l.upper().split()) + " $$$ ###" for l in lines]
        out.append((i, "\n".join(lines), int(i % 3 != 0)))
    return out


def test_learns_and_covers_edges(spark):
    rows = corpus(400)
    extra = [(1000, None, 1), (1001, "", 1), (1002, "\n\n", None), (1003, "word " * 200000, None), (None, "some text", 1), (1003, "word " * 200000, None)]
    docs = spark.createDataFrame([(a, b, "x", 9.0) for a, b, _ in rows + extra], "doc_id long, text string, quality string, score double")
    labels = spark.createDataFrame([(a, c) for a, _, c in rows + extra], "doc_id long, quality int")
    model = m.train(docs, labels)
    out = m.score(docs, model).withColumn("held", m.held_out(m.F.col("doc_id"))).collect()
    assert len(out) == len(rows) + len(extra) and all(0 <= r.score <= 1 for r in out)
    truth = {a: c for a, _, c in rows}
    held = [(r.score >= m.THRESHOLD) == truth[r.doc_id] for r in out if r.held and r.doc_id in truth]
    assert len(held) > 40 and np.mean(held) > 0.95
    twice = [r.score for r in out if r.doc_id == 1003]
    assert twice[0] == twice[1]
    assert m.score(docs.limit(0), model).count() == 0


def test_labels_of_one_kind(spark):
    docs = spark.createDataFrame([(2, "a b c")], "doc_id long, text string")
    one = m.train(docs, spark.createDataFrame([(2, 1)], "doc_id long, quality int"))
    none = m.train(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert m.score(docs, one).first().score == 1.0 and m.score(docs, none).first().score == 0.5


def test_trains_on_whole_chains_in_shards(spark, tmp_path):
    """Every line of every chosen document is in one shard's chains, as neighbours; the order of rows does not show."""
    texts = ["\n".join(f"{w} {i} words" for i in range(n)) for w, n in (("Good", 150), ("bad!", 90), ("Fine", 3))]
    docs = spark.createDataFrame([(i, texts[i % 3]) for i in range(30)], "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 3 <> 1 as int) as quality")
    rows = docs.selectExpr("doc_id as key", "1 as quality", "text").mapInArrow(m._featured, m._FEATURED).toArrow()
    assert sorted(len(x) for x in m.Chains.of(rows).x) == [3] * 10 + [90] * 10 + [150] * 10
    (x, size, r, y), *more = m.Chains.of(rows).batches()
    (_, _, buf, offs), = m.text_buffers(pa.array([texts[2]]))
    own, _, one = m.features(buf, offs)
    assert not more and len(y) == 30 and np.array_equal(x[:3], m.with_neighbours(own, one))
    models = [m.train(d, labels, shard_docs=4, rounds=2) for d in (docs, docs.orderBy(m.F.desc("doc_id")).repartition(3))]
    assert np.allclose(models[0].weights, models[1].weights) and models[0].slope == pytest.approx(models[1].slope)
    scores = {r.doc_id % 3: r.score for r in m.score(docs, models[0]).collect()}
    assert scores[1] < 0.3 < scores[0]
    fewer = m.train(docs, labels, limit=2)
    assert fewer.constant is not None or np.isfinite(fewer.weights).all()


def test_mixing_learns_as_one_shard_does(spark):
    rows = corpus(600, 3)
    docs = spark.createDataFrame([(a, b) for a, b, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(a, c) for a, _, c in rows], "doc_id long, quality int")
    truth = {a: c for a, _, c in rows}
    for size in (10_000, 60):
        out = m.score(docs, m.train(docs, labels, shard_docs=size)).withColumn("held", m.held_out(m.F.col("doc_id"))).where("held").collect()
        assert np.mean([(r.score >= 0.5) == truth[r.doc_id] for r in out]) > 0.97
