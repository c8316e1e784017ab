"""Reciprocal rank fusion of ranked retrievers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from quillon.sources.storage import keep

RRF_K = 60
#: Rows that one task may sort to rank them; more are ranked by ranges.
ONE_TASK = 100_000


def numbered(rows: DataFrame, order: list, name: str, count: int) -> DataFrame:
    """``rows`` (written) with their rank from 1 in a total order.

    Beyond ``ONE_TASK`` rows are dealt out by ranges of the order, ranked in
    each range, and shifted by the rows of the ranges before (one number for
    each range).
    """
    if count <= ONE_TASK:
        return rows.withColumn(name, F.row_number().over(Window.orderBy(*order)))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = keep(rows.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "ranged")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return ranged.withColumn(name, own).join(F.broadcast(base), "_part").withColumn(name, F.col(name) + F.col("_base")).drop("_part", "_base")


def ranks(ranked: DataFrame, order: list, pk: tuple[str, ...], depth: int | None) -> DataFrame:
    """Primary key and rank (from 1) of the first ``depth`` rows in an order."""
    if depth is not None:
        best = ranked.orderBy(*order, *pk).limit(depth)
        return best.select(*pk, F.row_number().over(Window.orderBy(*order, *pk)).alias("_rank"))  # depth rows
    held = keep(ranked, "ranked")
    return numbered(held, [*order, *pk], "_rank", held.count()).select(*pk, "_rank")


def fuse(channels: list[DataFrame], pk: tuple[str, ...], k: int | None = 10, required: int | None = None) -> DataFrame:
    """Sum of 1 / (60 + rank) over the channels that rank a row, best first.

    ``required`` is the channel that a row must be in, if any.
    """
    parts = [c.select(*pk, F.col("_rank").alias(f"_r{i}")) for i, c in enumerate(channels)]
    joined = reduce(lambda a, b: a.join(b, list(pk), "full"), parts)
    if required is not None:
        joined = joined.filter(F.col(f"_r{required}").isNotNull())
    score = reduce(lambda a, b: a + b, (F.coalesce(1.0 / (RRF_K + F.col(f"_r{i}")), F.lit(0.0)) for i in range(len(channels))))
    out = joined.select(*pk, score.alias("_score")).orderBy(F.col("_score").desc(), *pk)
    return out if k is None else out.limit(k)


def fuse_scored(rows: DataFrame, pk: tuple[str, ...], channels: list[Column], k: int | None = 10) -> DataFrame:
    """``fuse`` of channels that are columns of one table (less is better, null is unranked).

    The rows are made once; only keys and channel values are written and sorted.
    """
    held = keep(rows.select(*pk, *(c.cast("double").alias(f"_c{i}") for i, c in enumerate(channels))), "channels")
    count = held.count()
    for i in range(len(channels)):
        held = numbered(held, [F.col(f"_c{i}").asc_nulls_last(), *pk], f"_r{i}", count)
    parts = (F.when(F.col(f"_c{i}").isNotNull(), 1.0 / (RRF_K + F.col(f"_r{i}"))).otherwise(0.0) for i in range(len(channels)))
    out = held.select(*pk, reduce(lambda a, b: a + b, parts).alias("_score")).filter("_score > 0").orderBy(F.col("_score").desc(), *pk)
    return out if k is None else out.limit(k)
