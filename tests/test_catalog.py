"""Every query with SQL gives what DuckDB gives, on the smallest tables."""

import math
import os

import duckdb
import pytest

from cladespark.plans import catalog

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{DIR}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 8) + 0.0
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


def rows(found, cols, order):
    return sorted((tuple(plain(r[order.index(c)]) for c in cols) for r in found), key=repr)


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables")
@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, DIR)
    cur = duck.execute(catalog.oracle_sql()[name])
    order = [c[0] for c in cur.description]
    cols = sorted(df.columns)
    assert sorted(order) == cols
    assert rows(df.collect(), cols, df.columns) == rows(cur.fetchall(), cols, order)


def test_entry_points():
    import __spark_entry__ as e

    assert set(catalog.queries()) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
