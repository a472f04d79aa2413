"""Every query with SQL against DuckDB at the smallest scale, and what the entry points promise."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__
from tessera.plans import registry

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"create view {f[:-8]} as select * from '{DATA}/{f}'")
    return con


def plain(v):
    """One form for numbers that pandas holds as floats on one side where a column has nulls."""
    if pd.isna(v):
        return None
    v = v.item() if hasattr(v, "item") else v
    return float(v) if isinstance(v, int | float) and not isinstance(v, bool) else v


def same(a: pd.DataFrame, b: pd.DataFrame) -> bool:
    cols = sorted(b.columns)
    assert sorted(a.columns) == cols
    key = lambda d: sorted(repr(tuple(map(plain, r))) for r in d[cols].astype(object).itertuples(index=False))
    return key(a) == key(b)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_matches_sql(spark, con, name):
    got = registry.QUERIES[name](spark, DATA).toPandas()
    assert same(got, con.sql(registry.ORACLE_SQL[name]).df())


def test_entry_points(spark):
    assert __spark_entry__.entry(spark).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES)
