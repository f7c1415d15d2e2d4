"""Each query of the reference's own operators against its SQL, on the smallest tables."""

import math
import os

import duckdb
import pandas as pd
import pytest

from fissure.jobs.registry import ORACLES, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{SF}/lineitem.parquet'")
    return con


def _plain(x):
    if x is None or x is pd.NA or (isinstance(x, float) and math.isnan(x)):
        return None
    if isinstance(x, bool) or str(type(x)).find("bool") >= 0:
        return bool(x)
    return float(x) if not isinstance(x, str) else x


def _rows(frame, columns):
    return sorted((tuple(map(_plain, r)) for r in frame[columns].astype(object).values.tolist()), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    assert _rows(got, columns) == _rows(want, columns)


def test_every_query_without_sql_is_tested_elsewhere():
    assert set(QUERIES) - set(ORACLES) == {"greedy_clusters", "breakpoint_calls"}
