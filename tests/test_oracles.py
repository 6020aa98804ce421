"""Every query with a SQL oracle equals it on the smallest tables."""

import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry

ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for f in os.listdir(small):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{small}/{f}'")
    return con


def test_names_match():
    assert set(ORACLES) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_oracle(spark, small, duck, name):
    result = entry.queries()[name](spark, small)
    expected = duck.sql(ORACLES[name])
    assert sorted(result.columns) == sorted(expected.columns)
    columns = sorted(result.columns)
    got = Counter(tuple(r[c] for c in columns) for r in result.collect())
    at = [expected.columns.index(c) for c in columns]
    want = Counter(tuple(float(r[i]) if type(r[i]).__name__ == "Decimal" else r[i] for i in at)
                   for r in expected.fetchall())
    assert got == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0
