"""Every registered query of the engine against DuckDB, on the smallest tables."""

import math
import os

import duckdb
import pytest

from lakewright.plans import registry

QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "~"
    if isinstance(value, (bool, int, str)):
        return str(value)
    return f"{float(value):.5f}" if hasattr(value, "__float__") else str(value)


@pytest.fixture(scope="module")
def duck(sf):
    connection = duckdb.connect()
    for name in os.listdir(sf):
        connection.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{name}'")
    return connection


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_agrees_with_duckdb(spark, duck, sf, name):
    frame = QUERIES[name](spark, sf)
    columns = sorted(frame.columns)
    rows = sorted(tuple(plain(r[c]) for c in columns) for r in frame.collect())
    result = duck.sql(ORACLES[name])
    assert sorted(result.columns) == columns
    place = [result.columns.index(c) for c in columns]
    assert rows == sorted(tuple(plain(r[i]) for i in place) for r in result.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).columns
