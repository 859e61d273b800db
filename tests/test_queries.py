"""Every registered query with SQL gives the rows that DuckDB gives; the entry runs."""

import datetime
import math

import duckdb
import pytest

import __spark_entry__ as spark_entry
from pagewake.plans import registry
from pagewake.sources.tables import NAMES


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for name in NAMES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


def plain(v):
    if hasattr(v, "asDict"):
        v = list(v)
    if isinstance(v, dict):
        v = list(v.values())
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v.isoformat() if isinstance(v, (datetime.date, datetime.datetime)) else v


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_is_its_sql(spark, duck, sf, name):
    got = registry.queries()[name](spark, sf)
    want = duck.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    have = sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=repr)
    assert have == sorted((tuple(map(plain, r)) for r in want.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_without_sql_runs(spark, sf, name):
    assert registry.queries()[name](spark, sf).count() > 0


def test_entry(spark):
    assert spark_entry.entry(spark).count() > 0
    assert set(spark_entry.oracle_sql()) <= set(spark_entry.queries())
