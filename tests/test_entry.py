"""The driver contract on the smallest tables, with SQL results from DuckDB."""

import collections
import os

import duckdb
import pytest

import __spark_entry__ as entry
from graphloom import plans

DATA = os.environ.get("TEST_DATA", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def value(x):
    if isinstance(x, float):
        return float(f"{x:.9g}")
    if isinstance(x, (list, tuple)):
        return tuple(map(value, x))
    return x


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    df = plans.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    got = collections.Counter(repr(tuple(value(r[c]) for c in columns)) for r in df.collect())
    want = duck.sql(plans.oracle_sql()[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert got == collections.Counter(repr(tuple(value(r[i]) for i in at)) for r in want.fetchall())


def test_entry_and_names(spark):
    if DATA == "/root/testdata/sf0.001":
        assert entry.entry(spark).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
