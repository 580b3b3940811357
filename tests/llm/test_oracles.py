"""Every training-data query that has SQL, against DuckDB."""

import duckdb
import pytest

from tessella.llm import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(registry.ORACLES))
def test_query(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = con.sql(registry.ORACLES[name])
    got = registry.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(want.columns)
    plain = lambda rows: sorted((tuple(f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in rows))
    rows = plain(got.select(*want.columns).collect())
    assert rows == plain(want.fetchall()) and len(rows) >= 50
