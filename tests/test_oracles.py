"""Every query that has an oracle equals it on the small tables; the others run."""

import duckdb
import pytest

from docloom.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return f"{v:.6f}"
    if isinstance(v, (list, tuple)):
        return str([plain(y) for y in v])
    return str(v)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, sf, name):
    df = catalogue.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted(tuple(map(plain, r)) for r in df.select(*columns).collect())
    if name not in catalogue.ORACLE_SQL:
        return
    want = duck.sql(catalogue.ORACLE_SQL[name])
    assert sorted(want.columns) == columns
    kinds = {"bigint": "bigint", "integer": "int", "varchar": "string", "double": "double", "boolean": "boolean"}
    theirs = {c: kinds.get(str(t).lower()) for c, t in zip(want.columns, want.types)}
    assert all(theirs[c] in (None, k) for c, k in df.dtypes)
    assert got == sorted(tuple(map(plain, r)) for r in want.project(", ".join(f'"{c}"' for c in columns)).fetchall())


def test_flagship(spark, sf):
    rows = catalogue.flagship(spark, sf).collect()
    assert rows and max(r["rank"] for r in rows) <= 10
