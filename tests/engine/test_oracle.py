"""Every query with SQL against DuckDB on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from quillon.plans import catalogue

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    return con


def _rows(df: pd.DataFrame) -> list[tuple]:
    def show(v):
        if pd.isna(v):
            return "NULL"
        return repr(float(v)) if isinstance(v, int | float) and not isinstance(v, bool) else str(v)

    return sorted(tuple(map(show, r)) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query(spark, duck, name):
    got = catalogue.queries()[name](spark, FOLDER).toPandas()
    want = duck.execute(catalogue.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert _rows(got) == _rows(want)


def test_every_query_runs(spark):
    for name in set(catalogue.queries()) - set(catalogue.oracle_sql()):
        catalogue.queries()[name](spark, FOLDER).count()
