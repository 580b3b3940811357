import random

import duckdb
import pytest

from tessella.llm import op6_mixing as m


def shares(sizes, weights, cap):
    """Targets by the loop of the definition: share by weight, stop at the cap, share the excess again."""
    total, left, out = sum(sizes.values()), dict(weights), {}
    while left:
        free = total - sum(out.values())
        level = free / sum(left.values())
        over = [s for s in left if level * left[s] > cap * sizes[s]]
        if not over:
            return out | {s: level * left[s] for s in left}
        for s in over:
            out[s] = cap * sizes[s]
            del left[s]
    return out


@pytest.mark.parametrize("seed", range(6))
def test_targets(spark, seed):
    rng = random.Random(seed)
    names = [f"s{i:02d}" for i in range(rng.randrange(1, 12))] + [None]
    sizes = {s: rng.choice([0, 1, 5, 40, 1000]) for s in names}
    weights = {s: 1 + i % 3 for i, s in enumerate(names)}
    got = m.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
    want = shares(sizes, weights, 3)
    assert len(got) == len(names) and all(abs(r.target - want[r.source]) < 1e-6 for r in got)


def corpus():
    rng = random.Random(3)
    rows = [(i, "w " * rng.randrange(60), "hot" if i % 3 else rng.choice(["b", "c", None]), 1.0) for i in range(600)]
    return rows + [(600, None, "hot", 1.0), (601, "", "b", 1.0), (602, "x", "tiny", 1.0), (5, rows[5][1], rows[5][2], 1.0), (None, "a b", "hot", 1.0), (603, "long " * 20000, "b", 1.0)]


def test_mix(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, target double")
    out = m.mix(docs).collect()
    assert len(out) == len(rows)
    by = {}
    for r in out:
        by.setdefault(r.source, []).append(r)
    for source, found in by.items():
        size, target = found[0].source_size, found[0].target
        assert size == sum(r.size for r in found)
        assert abs(sum(r.taken for r in found) - target) <= 0.5 and all(0 <= r.taken <= 3 * r.size for r in found)
        epochs = int(target // size)
        # Whole epochs come first, and of the rest only one document is cut.
        assert all(r.taken >= epochs * r.size for r in found)
        assert sum(epochs * r.size < r.taken < (epochs + 1) * r.size for r in found) <= 1
    again = m.mix(docs.repartition(7), bins=3).collect()
    assert sorted(map(tuple, again), key=str) == sorted(map(tuple, out), key=str)


def test_quality_decides_what_is_taken(spark):
    rows = [(i, "w w w w", "a") for i in range(3000)] + [(9000 + i, "w " * 40, "b") for i in range(1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    good = m.F.when(m.F.col("doc_id") % 2 == 0, 4.0).otherwise(0.25)
    out = [r for r in m.mix(docs, weights=(1, 99), max_epochs=100, weight=good).collect() if r.source == "a"]
    taken = [sum(r.taken for r in out if r.doc_id % 2 == k) for k in (0, 1)]
    assert taken[0] > 2 * taken[1] > 0


def test_no_rows(spark):
    assert m.mix(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0


def test_against_its_sql(spark, tmp_path):
    """The whole mix, with odd signs, marks and letters beyond ASCII in the quality weight, against DuckDB."""
    rng = random.Random(6)
    bits = ["wörter", "été", "###", "a", "é", "日本", "$$", "don't", "(x)", "12", "\t"]
    rows = [(i, " ".join(rng.choice(bits) for _ in range(rng.randrange(30))), rng.choice(["a", "b", "c", None])) for i in range(400)] + [(400, None, "a"), (401, "", None)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = con.sql(m.ORACLE)
    got = m.op6_mixing(spark, str(tmp_path)).select(*want.columns).collect()
    assert sorted((tuple(r) for r in got), key=str) == sorted(want.fetchall(), key=str)


def test_columns_that_are_kept(spark):
    docs = spark.createDataFrame([(1, "a b", "s", 9, "x"), (2, None, "s", 8, "y")], "doc_id long, text string, source string, size int, rank_key string")
    out = m.mix(docs, keep=tuple(docs.columns)).collect()
    assert {(r.doc_id, r.text, r.source, r.size, r.rank_key, r.taken) for r in out} == {(1, "a b", "s", 2, "x", 2), (2, None, "s", 0, "y", 0)}
