"""Every query of the registry on sf0.001, against its SQL where it has one."""

import math
import os
import subprocess
import sys

import duckdb
import pytest

from tessella.plans import registry

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def plain(v):
    return f"{v:.9g}" if isinstance(v, float) and math.isfinite(v) else str(v)


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query(spark, con, name):
    df = registry.QUERIES[name](spark, SF)
    rows, columns = df.collect(), sorted(df.columns)
    if name not in registry.ORACLES:
        assert name == "scattered_edits"
        return
    found = con.sql(registry.ORACLES[name])
    assert sorted(found.columns) == columns
    at = [found.columns.index(c) for c in columns]
    assert sorted([plain(r[c]) for c in columns] for r in rows) == sorted([plain(r[i]) for i in at] for r in found.fetchall())


#: Run in a process of its own: every import of the training-data subpackage fails as if its folder were gone.
HIDDEN = """
import sys

class Gone:
    def find_spec(self, name, path=None, target=None):
        if name in HIDE or name.startswith("tessella.llm."):
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)

sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
from tessella.plans import registry
assert set(e.queries()) == set(registry.QUERIES) and set(e.oracle_sql()) == set(registry.ORACLES)
"""


@pytest.mark.parametrize("hide", [("tessella.llm",), ("tessella.llm", "corpus_pipeline")])
def test_entry_needs_no_training_data_operators(hide):
    subprocess.run([sys.executable, "-c", f"HIDE = {hide!r}\n{HIDDEN}"], cwd=ROOT, env={**os.environ, "PYTHONPATH": ROOT}, check=True)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 5
    assert set(registry.QUERIES) <= set(__spark_entry__.queries()) and set(registry.ORACLES) <= set(__spark_entry__.oracle_sql())


def test_scattered_edits_against_whole_tables(spark):
    """The one query that SQL cannot say: its runs by a script that is traced in a table kept whole."""
    from .test_source_text import whole_table

    tables = [{r[0]: r[1] for r in spark.read.parquet(f"{SF}/{t}.parquet").select(*c).collect()} for t, c in (("supplier", ("s_suppkey", "s_name")), ("part", ("p_partkey", "p_name")))]
    rows = registry.QUERIES["scattered_edits"](spark, SF).collect()
    assert len(rows) == len(tables[0])
    for r in rows:
        a, b = (t[r.s_suppkey] for t in tables)
        lo = len(os.path.commonprefix([a, b]))
        hi = len(os.path.commonprefix([a[lo:][::-1], b[lo:][::-1]]))
        ops = whole_table(a[lo : len(a) - hi], b[lo : len(b) - hi])
        runs = []
        for op in ops:
            last = runs[-1][-1] if runs else None
            if last and op[0] == last[0] and op[1] - last[1] == (op[0] != "i") and op[2] - last[2] == (op[0] != "d"):
                runs[-1].append(op)
            else:
                runs.append([op])
        few = sum(len(x) for x in runs if len(x) == 1)
        assert (r.scattered, r.blocks, r.total) == (few, sum(len(x) > 1 for x in runs), len(ops))
        plain = [t.replace(" ", "") for t in (a, b)]
        assert r.good in (True, False) and (r.good is False or plain[0] != plain[1])
