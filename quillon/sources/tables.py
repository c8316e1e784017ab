"""Tables on shared storage: scans, partitioned writes, export and import."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quillon.sources.storage import fresh


def scan(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of a folder of Parquet tables."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


@dataclass(frozen=True)
class Partitioning:
    """RANGE (split points), HASH (number) or LIST partitioning on a column.

    Rows go to directories by a derived column ``_part``; a predicate on the
    column gives a predicate on the directories, so other ones are not read.
    """

    kind: str
    column: str
    splits: tuple = ()
    parts: int = 0

    def part(self) -> Column:
        c = F.col(self.column)
        if self.kind == "list":
            return c.cast("string")
        if self.kind == "hash":
            return F.pmod(F.xxhash64(c), F.lit(self.parts)).cast("int")
        out = F.lit(0)
        for s in self.splits:
            out = out + F.when(c >= F.lit(s), 1).otherwise(0)
        return F.when(c.isNotNull(), out).cast("int")

    def write(self, df: DataFrame, uri: str) -> None:
        df.withColumn("_part", self.part()).repartition("_part").write.partitionBy("_part").parquet(uri)

    def equals(self, df: DataFrame, value) -> DataFrame:
        """Rows whose column equals a value, from the one directory that can hold them."""
        at = df.sparkSession.range(1).select(F.lit(value).cast(df.schema[self.column].dataType).alias(self.column)).select(self.part()).first()[0]
        return df.filter((F.col("_part") == F.lit(at)) & (F.col(self.column) == F.lit(value)))

    def between(self, df: DataFrame, low, high) -> DataFrame:
        """Rows in a closed range; RANGE partitioning reads only what overlaps."""
        keep = (F.col(self.column) >= F.lit(low)) & (F.col(self.column) <= F.lit(high))
        if self.kind == "range":
            first, last = sum(low >= s for s in self.splits), sum(high >= s for s in self.splits)
            keep = F.col("_part").between(first, last) & keep
        return df.filter(keep)


def bucketed(df: DataFrame, name: str, keys: list[str], buckets: int) -> DataFrame:
    """A table laid out by hash of its keys, sorted in each bucket.

    Joins and aggregations of such tables on their keys go bucket by bucket,
    without an exchange.
    """
    spark = df.sparkSession
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    df.write.bucketBy(buckets, *keys).sortBy(*keys).option("path", fresh(spark, name)).saveAsTable(name)
    return spark.table(name)


def export(tables: dict[str, DataFrame], uri: str) -> None:
    """Write tables and, last, the list that seals the export."""
    spark = None
    for name, df in tables.items():
        spark = df.sparkSession
        df.write.parquet(f"{uri}/{name}")
    if spark is None:
        raise ValueError("nothing to export")
    seal = json.dumps({n: json.loads(df.schema.json()) for n, df in tables.items()})
    spark.createDataFrame([(seal,)], "value string").coalesce(1).write.text(f"{uri}/_sealed")


def load(spark: SparkSession, uri: str) -> dict[str, DataFrame]:
    """Tables of a sealed export."""
    seal = json.loads(spark.read.text(f"{uri}/_sealed", wholetext=True).first()[0])
    return {n: spark.read.parquet(f"{uri}/{n}") for n in seal}
