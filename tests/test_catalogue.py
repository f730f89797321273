import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from corpusloom.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def plain(row):
    return tuple(round(x, 6) if isinstance(x, float) else str(x) if not isinstance(x, (int, str, bool, type(None))) else x for x in row)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_equals_oracle(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    got = duck.sql(catalogue.ORACLES[name])
    names = sorted(df.columns)
    assert names == sorted(got.columns)
    at = [got.columns.index(c) for c in names]
    have = sorted((plain(r[c] for c in names) for r in df.collect()), key=str)
    assert have == sorted((plain(r[i] for i in at) for r in got.fetchall()), key=str)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_runs(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
