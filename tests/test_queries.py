"""Every registered query: against DuckDB on the same tables where SQL expresses it, else that it runs and keeps its schema."""

import datetime as dt
import decimal
import os

import duckdb
import pytest

from brindle import registry
from brindle.catalog import TABLES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


@pytest.fixture(scope="module")
def duck():
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF}/{name}.parquet')")
    return db


def plain(value):
    """One form of a value for both engines."""
    if value is None or isinstance(value, (bool, str)):
        return value
    if isinstance(value, (float, decimal.Decimal)):
        return float(f"{float(value):.9g}") + 0.0
    if isinstance(value, int):
        return float(value)
    if isinstance(value, (dt.date, dt.datetime)):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((str(k), plain(v)) for k, v in value.items()))
    return str(value)


def in_order(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_equals_sql(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    got = in_order(df.columns, [tuple(r) for r in df.collect()])
    found = duck.execute(registry.oracle_sql()[name])
    want = in_order([c[0] for c in found.description], found.fetchall())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    assert got[1] == want[1]


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs(spark, name):
    df = registry.queries()[name](spark, "/root/testdata/sf0.001")
    assert df.count() >= 0 and len(set(df.columns)) == len(df.columns)


def test_every_oracle_has_its_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())
