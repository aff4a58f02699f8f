"""Every named query against its DuckDB SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from kinlattice.plans import catalogue

DIR = "/root/testdata/sf0.001"


def rows(df):
    df = df[sorted(df.columns)].astype(object)
    df = df.where(df.notna(), None)
    return sorted(tuple("nan" if isinstance(v, float) and v != v else repr(float(v)) if isinstance(v, float) else str(v) for v in r) for r in df.itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{DIR}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    got = catalogue.QUERIES[name](spark, DIR).toPandas()
    if name in catalogue.ORACLES:
        want = duck.sql(catalogue.ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)
    else:
        assert len(got) > 0


def test_entry(spark):
    assert set(catalogue.QUERIES) <= set(entry.queries()) and set(catalogue.ORACLES) <= set(entry.oracle_sql())
    assert all(isinstance(v, str) for v in entry.oracle_sql().values())
    assert entry.entry(spark).count() > 0
