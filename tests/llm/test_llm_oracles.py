"""Queries of this package that SQL can express equal their SQL."""

import duckdb
import pytest

from docloom.llm import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = registry.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    want = con.sql(registry.ORACLE_SQL[name])
    assert sorted(want.columns) == columns
    plain = lambda r: tuple(f"{v:.6f}" if isinstance(v, float) else str(v) for v in r)
    assert sorted(plain(r) for r in df.select(*columns).collect()) == sorted(plain(r) for r in want.project(", ".join(f'"{c}"' for c in columns)).fetchall())
