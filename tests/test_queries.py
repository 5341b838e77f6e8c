"""Every query of the market domain against its SQL in DuckDB on the smallest tables."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from wagerlake import registry

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="the given tables are not here")


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for f in os.listdir(DIR):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DIR}/{f}'")
    return con


def text(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
        return "~"
    if isinstance(v, (bool, np.bool_)):
        return str(bool(v))
    if isinstance(v, (float, np.floating)):
        return f"{float(v):.9g}"
    if isinstance(v, (int, np.integer)):
        return f"{int(v):.9g}" if abs(int(v)) < 10**9 else str(int(v))
    return "[" + ",".join(map(text, v)) + "]" if isinstance(v, (list, tuple, np.ndarray)) else str(v)


def rows(df):
    df = df[sorted(df.columns)]
    return list(df.columns), sorted("|".join(map(text, r)) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.oracles()))
def test_query_equals_its_sql(spark, con, name):
    assert rows(registry.queries()[name](spark, DIR).toPandas()) == rows(con.sql(registry.oracles()[name]).df())


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracles())))
def test_query_without_sql_runs(spark, name):
    assert registry.queries()[name](spark, DIR).count() > 0
