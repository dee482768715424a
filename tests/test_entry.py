"""The driver's contract: every query runs, and those with SQL give its rows."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from arcwise.plans import catalog

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    import glob
    import os

    c = duckdb.connect()
    for f in glob.glob(f"{DIR}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def key(row):
    return tuple((0, 0.0, "") if v is None else (1, round(v, 5), "") if isinstance(v, float) else (2, 0.0, str(v)) for v in row)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", [n for n in catalog.QUERIES if not n.endswith("_equilibrium")])
def test_query(spark, con, name):
    got = entry.queries()[name](spark, DIR)
    cols = sorted(got.columns)
    rows = sorted(key(r[c] for c in cols) for r in got.collect())
    res = con.execute(catalog.ORACLES[name])
    at = [[c[0] for c in res.description].index(c) for c in cols]
    want = sorted(key(r[i] for i in at) for r in res.fetchall())
    assert len(rows) == len(want)
    for a, b in zip(rows, want, strict=True):
        assert all(x[0] == y[0] and x[2] == y[2] and math.isclose(x[1], y[1], rel_tol=1e-9, abs_tol=2e-4) for x, y in zip(a, b, strict=True)), (a, b)
