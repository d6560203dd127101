"""Every query outside the text package beside its SQL, over the smallest data."""

import glob
import importlib.util
import numbers
import os

import pandas as pd
import pytest

from threadloom.plans import analytics, observing, problems

DATA = "/root/testdata/sf0.001"
QUERIES = {**problems.QUERIES, **analytics.QUERIES, **observing.QUERIES}
SQL = {**problems.SQL, **analytics.SQL, **observing.SQL}

pytestmark = pytest.mark.skipif(
    not os.path.isdir(DATA) or importlib.util.find_spec("duckdb") is None, reason="needs the test tables and DuckDB"
)


@pytest.fixture(scope="module")
def con():
    import duckdb

    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return c


def plain(frame):
    def cell(v):
        if not isinstance(v, str) and pd.api.types.is_scalar(v) and pd.isna(v):
            return "null"
        if isinstance(v, numbers.Number) and not isinstance(v, bool):
            return str(round(float(v), 6) + 0.0)
        return str(v)

    return sorted(tuple(map(cell, row)) for row in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    got = QUERIES[name](spark, DATA).toPandas()
    assert len(got.columns) == len(set(got.columns))
    if name in SQL:
        want = con.sql(SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert plain(got) == plain(want)
