"""Every registered query of the reference's operators against its SQL in DuckDB, on the smallest tables."""

from __future__ import annotations

import datetime

import duckdb
import pandas as pd
import pytest

from helixlake.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


def cell(x):
    if x is None or x is pd.NA or x is pd.NaT or (isinstance(x, float) and x != x):
        return "null"
    if isinstance(x, (str, bool, datetime.datetime)):
        return repr(x)
    try:
        return repr(float(x))
    except (TypeError, ValueError):
        return repr(x)


def rows(df: pd.DataFrame) -> list[str]:
    return sorted(repr([cell(x) for x in r]) for r in df[sorted(df.columns)].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, sf, duck, name):
    got = catalog.queries()[name](spark, sf).toPandas()
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert len(got.columns)
        return
    want = duck.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
