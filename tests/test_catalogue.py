"""Every query with SQL gives DuckDB's rows."""

import glob
import math
import os

import duckdb
import pytest

from pulseloom.plans import calibrations, catalogue, spectra

DIR = "/root/testdata/sf0.01"
QUERIES, SQL = catalogue.QUERIES | calibrations.QUERIES | spectra.QUERIES, catalogue.SQL | calibrations.SQL | spectra.SQL


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{DIR}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    return v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DIR)
    names = sorted(df.columns)
    got = sorted((tuple(map(plain, r)) for r in df.select(*names).collect()), key=repr)
    if name not in SQL:
        assert got
        return
    found = duck.sql(SQL[name])
    assert sorted(found.columns) == names
    want = sorted((tuple(map(plain, r)) for r in found.select(*(f'"{n}"' for n in names)).fetchall()), key=repr)
    assert got == want
