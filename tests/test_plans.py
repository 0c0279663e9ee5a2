"""Every bound query against its SQL oracle on the smallest tables."""

import math
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from pkgloom.plans import ORACLE_SQL, QUERIES


def cell(x):
    if x is None or x is pd.NA or x is pd.NaT or (isinstance(x, float) and math.isnan(x)):
        return "~"
    if isinstance(x, (float, np.floating)):
        return str(int(x)) if x == int(x) else repr(round(float(x), 9))
    if isinstance(x, pd.Timestamp):
        return x.strftime("%Y-%m-%d")
    return str(x).replace(" 00:00:00", "")


def rows(frame, columns):
    return sorted(tuple(map(cell, r)) for r in frame[columns].astype(object).values.tolist())


@pytest.fixture(scope="module")
def oracle(data):
    c = duckdb.connect()
    for f in os.listdir(data):
        c.sql(f"create view {f.removesuffix('.parquet')} as select * from '{data}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, data, oracle):
    got = QUERIES[name](spark, data).toPandas()
    if name not in ORACLE_SQL:
        assert len(got)
        return
    want = oracle.sql(ORACLE_SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert rows(got, columns) == rows(want, columns)
