import os

import duckdb
import pytest

import __spark_entry__ as e
from colloquy.llm import registry as R

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")


def rows(df):
    df = df[sorted(df.columns)].astype(object)
    return sorted(map(str, df.where(df.notna(), None).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(R.ORACLES))
def test_query_against_sql(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "conversations", "benchmark"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got, want = e.queries()[name](spark, DATA).toPandas(), duck.execute(R.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def test_all_queries_are_there():
    assert sorted(int(n[2:].split("_")[0]) for n in R.QUERIES) == list(range(1, 14))
    assert "pipeline" in e.queries()
