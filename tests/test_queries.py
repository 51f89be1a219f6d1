"""Every registered query with SQL against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from quillgrid.plans.queries import QUERIES, SQL


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"create view {f.split('.')[0]} as select * from '{sf_dir}/{f}'")
    return con


def plain(value):
    if value is None or value != value:
        return None
    return round(value, 9) if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted((tuple(map(plain, r)) for r in df.select(*cols).collect()), key=repr)
    cursor = duck.execute(SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == cols
    want = sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in cursor.fetchall()), key=repr)
    assert got == want
    spark.catalog.clearCache()


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)
