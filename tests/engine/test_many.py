"""Vector indexes under many queries."""

import os
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.plans import catalogue
from quillon.retrieval import graph, many, nearest, vectorindex


def _vectors(spark, n, copies=0):
    """Vectors in a few clouds; the last ``copies`` are all those of key 7."""
    rng = np.random.default_rng(3)
    x = (rng.normal(size=(8, 16))[rng.integers(8, size=n)] + 0.3 * rng.normal(size=(n, 16))).astype(np.float32)
    x[n - copies :] = x[7]
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<float>")


@pytest.mark.parametrize("kind", ["I8", "NONE"])
def test_shards_are_searched_for_many_queries_at_once(spark, kind):
    """As one by one, with the first of many copies of a vector, in one pass over the graphs."""
    rows = _vectors(spark, 1500, copies=200)
    index = vectorindex.Shards.build(rows, "v", ("id",), quantisation=kind, shard=800)
    asked = rows.filter("id % 100 = 7").select(F.col("id").alias("q"), "v")
    found = index.search_many(asked, "q", 10)
    assert found.rdd.getNumPartitions() <= 8
    got = {}
    for r in found.orderBy("q", "_distance", "id").collect():
        got.setdefault(r.q, []).append(r.id)
    assert got[7] == [7, *range(1300, 1309)]
    for r in asked.collect():
        assert got[r.q] == [h.id for h in index.search(r.v, 10).collect()]
    share = vectorindex.recall(found, many.nearest(rows, "v", ("id",), asked, "q"), "q", ("id",))
    assert share.agg(F.avg("recall")).first()[0] >= 0.95


@pytest.mark.parametrize("subspaces", [None, 8])
def test_lists_are_searched_for_many_queries_at_once(spark, subspaces):
    """As one by one, with the first of many copies of a vector."""
    rows = _vectors(spark, 900, copies=100)
    index = vectorindex.Lists.build(rows, "v", ("id",), lists=6, probes=3, subspaces=subspaces, codes=32)
    asked = rows.filter("id % 100 = 7").select(F.col("id").alias("q"), "v")
    got = {}
    for r in index.search_many(asked, "q", 10).orderBy("q", "_distance", "id").collect():
        got.setdefault(r.q, []).append(r.id)
    assert got[7] == [7, *range(800, 809)]
    for r in asked.collect():
        assert got[r.q] == [h.id for h in index.search(r.v, 10).collect()]


def test_graphs_of_thousands_of_vectors_are_built_in_seconds():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(4000, 32)).astype(np.float32)
    began = time.process_time()
    g = graph.Graph(x, "l2", "I8")
    assert time.process_time() - began < 25
    assert all(len(links[0]) <= 2 * g.m for links in g.links)
    want = np.argsort(((x[:50, None] - x[None]) ** 2).sum(axis=2), axis=1)[:, :10]
    found = [g.search(q, 10, 200) for q in x[:50]]
    assert sum(len(set(a) & set(b)) for a, b in zip(found, want.tolist(), strict=True)) >= 450


@pytest.mark.parametrize("metric", ["cosine", "l2", "l1", "inner_product", "hamming"])
def test_many_queries_find_what_one_does(spark, metric):
    rows = _vectors(spark, 400, copies=50).unionByName(spark.createDataFrame([(1000, [0.0] * 16), (1001, None)], "id long, v array<float>"))
    asked = rows.filter("id IN (7, 30, 399, 1000, 1001)").select(F.col("id").alias("q"), "v")
    got = many.nearest(rows, "v", ("id",), asked, "q", metric, 12).collect()
    assert {r.q for r in got} == {7, 30, 399, 1000}
    for r in asked.filter("v IS NOT NULL").collect():
        want = [(h.id, h._distance) for h in nearest.nearest(rows, "v", r.v, ("id",), metric, 12).collect()]
        assert sorted((h.id, h._distance) for h in got if h.q == r.q) == sorted(want)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables here")
@pytest.mark.parametrize("name", ["hnsw_i8_recall", "hnsw_recall", "ivf_recall", "ivfpq_recall"])
def test_recall_queries_search_their_index_once(spark, name):
    """Not once for each query vector."""
    plan = catalogue.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and plan.count("MapInArrow") == 2
