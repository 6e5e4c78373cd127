"""Every query with SQL equals DuckDB's answer on the same tables; every other one runs."""

import math

import duckdb
import pytest

from seqloom.plans.queries import ORACLE_SQL, QUERIES

TABLES = "documents events embeddings".split()


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(rows):
    def cell(v):
        if v is None or isinstance(v, str):
            return v
        return float("nan") if isinstance(v, float) and math.isnan(v) else round(float(v), 5) + 0.0

    return sorted((tuple(cell(v) for v in r) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, sf, db, name):
    got = QUERIES[name](spark, sf)
    want = db.sql(ORACLE_SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    a = plain(map(tuple, got.select(*[f"`{c}`" for c in columns]).collect()))
    b = plain(want.select(*[duckdb.ColumnExpression(c) for c in columns]).fetchall())
    assert len(a) == len(b) > 0
    assert a == b


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0
