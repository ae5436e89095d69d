"""Queries with SQL give the same rows in DuckDB; the others give rows."""

import math

import duckdb
import pandas as pd
import pytest

from glossaria.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


def plain(x):
    if hasattr(x, "tolist") and not isinstance(x, str):
        x = x.tolist()
    if x is None or x is pd.NaT or (isinstance(x, float) and math.isnan(x)):
        return None
    if isinstance(x, float):
        return round(x, 6)
    if isinstance(x, pd.Timestamp):
        return str(x.tz_localize(None) if x.tzinfo else x)
    return tuple(plain(y) for y in x) if isinstance(x, (list, tuple)) else x


def rows(df, columns):
    return sorted((tuple(plain(y) for y in r) for r in df[columns].astype(object).itertuples(index=False, name=None)), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(name, spark, sf, duck):
    ours, theirs = QUERIES[name](spark, sf).toPandas(), duck.sql(SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    columns = sorted(ours.columns)
    assert rows(ours, columns) == rows(theirs, columns)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(name, spark, sf):
    found = QUERIES[name](spark, sf).toPandas()
    assert len(found) and found.notna().any(axis=None)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
