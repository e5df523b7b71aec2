"""The queries of the other plans against DuckDB on the smallest tables, as test_reference does for its own."""

import os

import pytest
from test_reference import DATA, _rows, duck  # noqa: F401

from skyledger.plans import archive, calibration, edits, facts, listing, moves, reference, sky  # noqa: F401

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
SQL = {n: reference.SQL[n] for n, f in reference.QUERIES.items() if n in reference.SQL and f.__module__ != reference.__name__} | archive.SQL
QUERIES = reference.QUERIES | archive.QUERIES


@pytest.mark.parametrize("name", list(SQL))
def test_twin(spark, duck, name):  # noqa: F811
    got, want = QUERIES[name](spark, DATA).toPandas(), duck.sql(SQL[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert _rows(got, columns) == _rows(want, columns)
