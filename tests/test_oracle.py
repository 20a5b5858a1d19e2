"""Every query with SQL against DuckDB, over the whole small tables."""

import datetime
import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(path)[:-8]} as from '{path}'")
    return c


def plain(x):
    return x.isoformat() if isinstance(x, datetime.datetime) else x


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_oracle(spark, duck, name):
    got = entry.queries()[name](spark, SF)
    want = duck.sql(entry.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = sorted((tuple(map(plain, r)) for r in got.select(*columns).collect()), key=repr)
    place = [want.columns.index(c) for c in columns]
    assert rows == sorted((tuple(plain(r[k]) for k in place) for r in want.fetchall()), key=repr)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
