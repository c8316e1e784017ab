"""Where queries register with their DuckDB counterpart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


class Tables:
    """Attribute access to the tables of a folder."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(sql: str | None = None):
    """Register ``f(tables)`` under its name."""

    def wrap(f):
        QUERIES[f.__name__] = lambda spark, folder: f(Tables(spark, folder))
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return wrap
