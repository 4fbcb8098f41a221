import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return bytes(v) if isinstance(v, bytearray) else v


from crateforge.plans import catalogue  # noqa: E402


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query_equals_sql(spark, db, name):
    df = entry.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(_norm(r[c]) for c in cols)) for r in df.collect())
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return
    rel = db.sql(sql)
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    assert got == sorted(repr(tuple(_norm(r[i]) for i in at)) for r in rel.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
