"""Every query with a SQL twin against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from skyledger.plans import reference

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return c


def _plain(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and np.isnan(v)):
        return None
    for kinds, cast in (((np.bool_, bool), bool), ((np.floating, float), float), ((np.integer, int), int)):
        if isinstance(v, kinds):
            return cast(v)
    return str(v)


def _rows(df, columns):
    return sorted((tuple(map(_plain, r)) for r in df[columns].values.tolist()), key=str)


@pytest.mark.parametrize("name", list(reference.SQL))
def test_twin(spark, duck, name):
    got, want = reference.QUERIES[name](spark, DATA).toPandas(), duck.sql(reference.SQL[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert _rows(got, columns) == _rows(want, columns)
