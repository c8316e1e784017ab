"""Connected components of a graph that is only held distributed.

Alternating large-star and small-star steps: every node's neighbours are
linked to the least of them, until the edges are stars. Minima come from
aggregations that combine before the exchange, and go back by joins that
adaptive execution can split (``apart``), so a hub with very many neighbours
is no single task's group. Each round is written to
the shared folder; nothing but two sums comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quillon.llm.storage import materialise


def apart(df: DataFrame) -> DataFrame:
    """An aggregate dealt out anew before a join on its own key.

    Otherwise the join would use the aggregation's exchange for both, and a
    hot key's rows on the other side could not be split.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _state(edges: DataFrame) -> tuple:
    mark = F.xxhash64("u", "v").cast("decimal(20,0)")
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(mark)).first())


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``node, root`` for each node of ``edges`` (u, v); root is the least node.

    Loops and repeated edges do no harm; no edges give no rows.
    """
    e = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()
    e = materialise(e, "edges")
    state = _state(e)
    for _ in range(rounds):
        if not state[0]:
            break
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(apart(least), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(apart(low), "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = materialise(small.union(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        new = _state(e)
        if new == state:
            break
        state = new
    else:
        raise RuntimeError("the components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
