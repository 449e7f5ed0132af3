"""Every query with SQL against DuckDB on the small tables."""

import glob
import math
import os

import pytest

from tracklattice.queries import QUERIES, SQL


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float)) or hasattr(v, "as_integer_ratio"):
        return round(float(v), 4) + 0.0
    return str(v)


@pytest.fixture(scope="module")
def duck(sf):
    import duckdb

    con = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, sf, name):
    got = QUERIES[name](spark, sf)
    columns = sorted(got.columns)
    want = duck.execute(SQL[name])
    names = [d[0] for d in want.description]
    assert columns == sorted(names)
    key = lambda r: tuple("" if x is None else str(x) for x in r)
    left = sorted((tuple(cell(r[c]) for c in columns) for r in got.collect()), key=key)
    right = sorted((tuple(cell(r[names.index(c)]) for c in columns) for r in want.fetchall()), key=key)
    assert len(left) == len(right)
    for a, b in zip(left, right):
        for x, y in zip(a, b):
            assert x == y or (isinstance(x, float) and isinstance(y, float) and abs(x - y) <= 2e-4 * max(1, abs(x))), (a, b)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
