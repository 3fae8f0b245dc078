import os

import duckdb
import pytest

import __spark_entry__ as e
from colloquy.plans import queries as Q

DATA = "/root/testdata/sf0.001"
TABLES = "events documents embeddings pages benchmark labels conversations"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for t in TABLES.split():
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return connection


def rows(df):
    df = df[sorted(df.columns)].astype(object)
    return sorted(map(str, df.where(df.notna(), None).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_query_against_sql(spark, duck, name):
    got, want = e.queries()[name](spark, DATA).toPandas(), duck.execute(e.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_every_transcript_query_has_sql():
    assert set(Q.ORACLES) == set(Q.QUERIES)


def test_entry(spark):
    assert e.entry(spark).count() > 0
