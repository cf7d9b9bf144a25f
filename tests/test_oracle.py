"""Every query with SQL gives what DuckDB gives, over the smallest tables."""

import datetime
import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from threadlake import oracle, queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the test tables aren't here")


def plain(value):
    if isinstance(value, float):
        return round(value, 9)
    return value.isoformat() if isinstance(value, datetime.datetime) else value


def agree(spark, name, query, sql):
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    df = query(spark, DATA)
    columns = sorted(df.columns)
    expected = con.sql(sql)
    assert sorted(expected.columns) == columns
    at = [expected.columns.index(c) for c in columns]
    got = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    assert got == sorted(repr([plain(r[i]) for i in at]) for r in expected.fetchall())


@pytest.mark.parametrize("name", sorted(oracle.oracle_sql()))
def test_query(spark, name):
    agree(spark, name, queries.queries()[name], oracle.oracle_sql()[name])


def test_every_query_has_sql():
    assert set(queries.queries()) == set(oracle.oracle_sql())
    assert set(queries.queries()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
