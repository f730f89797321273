import glob
import os

import duckdb
import pytest

from corpusloom.llm import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_equals_oracle(spark, name):
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    df, got = registry.QUERIES[name](spark, SF), con.sql(registry.ORACLES[name])
    names = sorted(df.columns)
    assert names == sorted(got.columns)
    at = [got.columns.index(c) for c in names]
    plain = lambda row: tuple(round(x, 6) if isinstance(x, float) else x for x in row)
    assert sorted((plain(r[c] for c in names) for r in df.collect()), key=str) == sorted((plain(r[i] for i in at) for r in got.fetchall()), key=str)


def test_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 11))
