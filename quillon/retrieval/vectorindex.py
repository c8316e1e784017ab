"""Stored vector indexes: IVF and IVF-PQ lists, HNSW shards, sparse postings.

Each is a table of files of its own with the primary keys. A search reads the
lists, shards or postings it needs, gives candidates, and ranks these by their
exact distance; the rest of a row is joined by primary key.

Centres and codebooks are fitted on at most ``nearest.SAMPLE`` vectors, chosen
by hash; every vector is in the index.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, FloatType, IntegerType, StructField, StructType

from quillon.functions import vectors
from quillon.retrieval import many
from quillon.retrieval.graph import Graph
from quillon.retrieval.many import matrix as _matrix, unit as _unit
from quillon.retrieval.nearest import SAMPLE, ProductQuantiser, closest, kmeans
from quillon.sources.storage import fresh, ship

SHARD = 20_000  # vectors of a graph that one task builds and walks
RERANK = 4


def _sample(rows: DataFrame, column: str, pk: tuple[str, ...], unit: bool) -> np.ndarray:
    x = np.array([r[0] for r in rows.orderBy(F.xxhash64(*pk)).limit(SAMPLE).select(column).collect()], dtype=float)
    return _unit(x) if unit and len(x) else x


def _ranked(rows: DataFrame, column: str, target, pk: tuple[str, ...], metric: str, k: int | None) -> DataFrame:
    """Candidates by exact distance, then key."""
    out = rows.withColumn("_distance", vectors.distance(metric, F.col(column), vectors.literal(target))).select(*pk, "_distance").orderBy("_distance", *pk)
    return out if k is None else out.limit(k)


@dataclass
class Lists:
    """IVF and IVF-PQ: files by list; a probe reads only its lists' folders."""

    uri: str
    column: str
    pk: tuple[str, ...]
    metric: str
    centres: np.ndarray
    probes: int
    quantiser: ProductQuantiser | None
    schema: StructType
    spark: object

    @classmethod
    def build(cls, rows: DataFrame, column: str, pk: tuple[str, ...], metric: str = "cosine", lists: int = 16, probes: int | None = None, subspaces: int | None = None, codes: int = 256) -> Lists:
        spark = rows.sparkSession
        ship(spark)
        rows = rows.filter(F.col(column).isNotNull()).select(*pk, F.col(column).cast("array<float>").alias(column))
        unit = metric == "cosine"
        x = _sample(rows, column, pk, unit)
        centres = kmeans(x, lists) if len(x) else np.zeros((1, 1))
        each = lambda f, parts: spark.sparkContext.parallelize(parts, len(parts)).map(f).collect()  # noqa: E731  a task fits a book
        quantiser = ProductQuantiser(x, subspaces, min(codes, max(len(x), 1)), each) if subspaces and len(x) else None
        schema = StructType([*rows.schema.fields, StructField("_code", BinaryType()), StructField("_list", IntegerType())])

        def op(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                v = _matrix(b.column(column)).astype(float)
                v = _unit(v) if unit and len(v) else v
                near = closest(v, centres).astype(np.int32) if len(v) else np.zeros(0, np.int32)
                code = [c.tobytes() for c in quantiser.encode(v)] if quantiser is not None and len(v) else [None] * len(v)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(code, pa.binary()), pa.array(near)], names=[*b.schema.names, "_code", "_list"])

        uri = fresh(spark, "lists")
        # a list with very many vectors is dealt out over several files
        dealt = rows.mapInArrow(op, schema).repartition("_list", F.pmod(F.xxhash64(*pk), F.lit(8)))
        dealt.write.partitionBy("_list").parquet(uri)
        probes = probes or max(1, -(-len(centres) // 10))
        return cls(uri, column, pk, metric, centres, probes, quantiser, schema, spark)

    def rows(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.uri)

    def probed(self, target, probes: int | None = None) -> list[int]:
        t = np.array(target, dtype=float)
        t = _unit(t) if self.metric == "cosine" else t
        return np.argsort(((self.centres - t) ** 2).sum(axis=1), kind="stable")[: probes or self.probes].tolist()

    def search(self, target, k: int | None, probes: int | None = None) -> DataFrame:
        """Primary key and exact distance of the nearest rows of the probed lists."""
        rows = self.rows().filter(F.col("_list").isin(*self.probed(target, probes)))
        if self.quantiser is None or k is None:
            return _ranked(rows, self.column, target, self.pk, self.metric, k)
        t = np.array(target, dtype=float)
        table = np.array(_padded(self.quantiser.table(_unit(t) if self.metric == "cosine" else t)))
        pk = self.pk

        def op(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                codes = np.frombuffer(b"".join(b.column("_code").to_pylist()), np.uint8).reshape(b.num_rows, -1)
                far = table[np.arange(codes.shape[1]), codes].sum(axis=1) if b.num_rows else np.zeros(0)
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in pk), b.column(self_column), pa.array(far)], names=[*pk, self_column, "_approx"])

        self_column = self.column
        fields = [f for f in rows.schema if f.name in (*pk, self_column)]
        near = rows.select(*pk, self_column, "_code").mapInArrow(op, StructType([*fields, StructField("_approx", DoubleType())]))
        near = near.orderBy("_approx", *pk).limit(k * RERANK)
        return _ranked(near, self.column, target, pk, self.metric, k)

    def search_many(self, queries: DataFrame, query: str, k: int, probes: int | None = None) -> DataFrame:
        """``search`` for all vectors of ``queries`` (columns ``query`` and this index's): each list is read once."""
        column, pk, metric, quantiser = self.column, self.pk, self.metric, self.quantiser
        most = k if quantiser is None else k * RERANK
        order = "_distance" if quantiser is None else "_approx"

        def task(targets: np.ndarray) -> Callable:
            probed = np.zeros((len(targets), len(self.centres)), bool)
            for q, t in enumerate(targets):
                probed[q, self.probed(t, probes)] = True
            tables = None
            if quantiser is not None:
                tables = np.array([_padded(quantiser.table(_unit(t) if metric == "cosine" else t)) for t in targets])

            def made(batches: Iterator[pa.RecordBatch]) -> many.Best:
                best = many.Best(metric, targets, most, pk, order)
                for b in batches:
                    lists = b.column("_list").to_numpy()
                    for one in np.unique(lists):
                        part = b.take(pa.array(np.nonzero(lists == one)[0]))
                        approx = None if tables is None else _by_code(tables, part.column("_code"))
                        best.add(pa.Table.from_batches([part]).select(list(pk)), _matrix(part.column(column)), np.nonzero(probed[:, one])[0], approx)
                return best

            return made

        kinds = [self.schema[c] for c in pk]
        return many.over(self.rows(), queries, query, column, pk, kinds, k, task, None if quantiser is None else most)


def _by_code(tables: np.ndarray, column: pa.Array) -> Callable:
    """Asymmetric distances of queries to rows, from their codes."""
    codes = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)

    def approx(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
        out = np.zeros((len(queries), len(rows)))
        for s in range(codes.shape[1]):
            out += tables[queries, s][:, codes[rows, s]]
        return out

    return approx


def _padded(table: list[np.ndarray]) -> list[np.ndarray]:
    most = max(len(t) for t in table)
    return [np.pad(t, (0, most - len(t))) for t in table]


@dataclass
class Shards:
    """HNSW: a graph for every shard of at most ``SHARD`` vectors; hits are merged by distance.

    Copies of a vector are one node of a graph; its rows stand by key between
    two of ``starts``.
    """

    uri: str
    column: str
    pk: tuple[str, ...]
    metric: str
    schema: StructType
    spark: object

    @classmethod
    def build(cls, rows: DataFrame, column: str, pk: tuple[str, ...], metric: str = "cosine", quantisation: str = "NONE", shard: int = SHARD) -> Shards:
        spark = rows.sparkSession
        ship(spark)
        rows = rows.filter(F.col(column).isNotNull()).select(*pk, F.col(column).cast("array<float>").alias(column))
        count = rows.count()
        shards = max(1, -(-count // shard), min(spark.sparkContext.defaultParallelism, -(-count // 1000)))
        dealt = rows.repartition(shards, F.pmod(F.xxhash64(*pk), F.lit(shards)))
        keys = StructType([f for f in rows.schema if f.name in pk])
        schema = StructType([StructField("keys", ArrayType(keys)), StructField("vectors", ArrayType(ArrayType(FloatType()))), StructField("starts", ArrayType(IntegerType())), StructField("graph", BinaryType())])

        def op(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[pa.RecordBatch] = []

            def built() -> pa.RecordBatch:
                t = pa.Table.from_batches(held)
                t = t.take(pa.compute.sort_indices(t, sort_keys=[(c, "ascending") for c in pk])).combine_chunks()
                order, starts = _nodes(_matrix(t[column].chunk(0)))
                t = t.take(pa.array(order)).combine_chunks()
                x = _matrix(t[column].chunk(0))[starts[:-1]]
                key = pa.StructArray.from_arrays([t[c].chunk(0) for c in pk], names=list(pk))
                n = pa.array([0, t.num_rows], pa.int32())
                return pa.RecordBatch.from_arrays(
                    [pa.ListArray.from_arrays(n, key), pa.ListArray.from_arrays(n, t[column].chunk(0)), pa.array([starts], pa.list_(pa.int32())), pa.array([Graph(x, metric, quantisation).pack()], pa.binary())],
                    names=["keys", "vectors", "starts", "graph"],
                )

            for batch in batches:
                for a in range(0, batch.num_rows, shard):
                    part = batch.slice(a, shard)
                    if held and sum(b.num_rows for b in held) + part.num_rows > shard:
                        yield built()
                        held.clear()
                    if part.num_rows:
                        held.append(part)
            if held:
                yield built()

        uri = fresh(spark, "shards")
        dealt.mapInArrow(op, schema).write.parquet(uri)
        return cls(uri, column, pk, metric, schema, spark)

    def search(self, target, k: int, ef: int | None = None) -> DataFrame:
        """Primary key and exact distance of the nearest rows of all shards."""
        ship(self.spark)
        t = np.array(target, dtype=np.float32)
        column = self.column
        kinds = [f for f in self.schema["keys"].dataType.elementType]
        schema = StructType([*kinds, StructField(column, ArrayType(FloatType()))])

        def op(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for r in range(b.num_rows):
                    at = pa.array(_Shard(b, r).candidates(t, k, ef), pa.int64())
                    keys, held = b.column("keys")[r].values.take(at), b.column("vectors")[r].values.take(at)
                    yield pa.RecordBatch.from_arrays([*(keys.field(i) for i in range(keys.type.num_fields)), held], names=[*(f.name for f in kinds), column])

        found = self.spark.read.schema(self.schema).parquet(self.uri).mapInArrow(op, schema)
        return _ranked(found, column, target, self.pk, self.metric, k)

    def search_many(self, queries: DataFrame, query: str, k: int, ef: int | None = None) -> DataFrame:
        """``search`` for all vectors of ``queries`` (columns ``query`` and this index's): each graph is read once."""
        metric, pk = self.metric, self.pk
        kinds = [f for f in self.schema["keys"].dataType.elementType]

        def task(targets: np.ndarray) -> Callable:
            def made(batches: Iterator[pa.RecordBatch]) -> many.Best:
                best = many.Best(metric, targets, k, pk)
                for b in batches:
                    for r in range(b.num_rows):
                        shard = _Shard(b, r)
                        at = [np.array(shard.candidates(t, k, ef), dtype=np.int64) for t in targets]
                        rows = np.concatenate(at)
                        keys = b.column("keys")[r].values.take(pa.array(rows))
                        named = pa.table([keys.field(i) for i in range(keys.type.num_fields)], names=[f.name for f in kinds])
                        best.pairs(np.repeat(np.arange(len(targets)), [len(x) for x in at]), named, _matrix(b.column("vectors")[r].values)[rows])
                return best

            return made

        return many.over(self.spark.read.schema(self.schema).parquet(self.uri), queries, query, self.column, pk, kinds, k, task)


def _nodes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows that puts copies together, each in its given order, and where each begins (and the last ends)."""
    raw = np.ascontiguousarray(x).view(np.dtype((np.void, x.itemsize * x.shape[1]))).ravel()
    _, group = np.unique(raw, return_inverse=True)
    shuffled = np.random.default_rng(5).permutation(int(group.max()) + 1)  # vectors in order would make a worse graph
    order = np.argsort(shuffled[group], kind="stable")
    return order, np.r_[np.nonzero(np.r_[True, np.diff(shuffled[group][order]) > 0])[0], len(x)]


class _Shard:
    """A shard as it is searched."""

    def __init__(self, batch: pa.RecordBatch, r: int) -> None:
        self.graph = Graph.unpack(batch.column("graph")[r].as_py())
        self.starts = batch.column("starts")[r].values.to_numpy(zero_copy_only=False)

    def candidates(self, target: np.ndarray, k: int, ef: int | None) -> list[int]:
        """Rows of about the nearest vectors; of copies the ``k`` first. The walk is wider in a larger graph."""
        wide = ef or max(64, 2 * k, int(1.5 * len(self.starts) ** 0.5))
        nodes = self.graph.search(target, k * RERANK, max(wide, k * RERANK))
        return [i for n in nodes for i in range(self.starts[n], min(self.starts[n] + k, self.starts[n + 1]))]


@dataclass
class Sparse:
    """Inverted lists of ``struct<idx, val>`` vectors: rows (idx, key, val) sorted by idx."""

    uri: str
    pk: tuple[str, ...]
    schema: StructType
    spark: object

    @classmethod
    def build(cls, rows: DataFrame, column: str, pk: tuple[str, ...]) -> Sparse:
        spark = rows.sparkSession
        pairs = rows.filter(F.col(column).isNotNull()).select(*pk, F.explode(F.arrays_zip(F.col(f"{column}.idx").alias("idx"), F.col(f"{column}.val").alias("val"))).alias("e"))
        norm = F.sqrt(F.aggregate(F.transform(F.col(f"{column}.val"), lambda x: x.cast("double") * x), F.lit(0.0), lambda a, x: a + x)).alias("norm")
        norms = rows.filter(F.col(column).isNotNull()).select(*pk, norm)
        lists = pairs.select(*pk, F.col("e.idx").alias("idx"), F.col("e.val").cast("double").alias("val")).join(norms, list(pk))
        uri = fresh(spark, "sparse")
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        lists.repartitionByRange(parts, "idx", *pk).sortWithinPartitions("idx").write.parquet(uri)
        return cls(uri, pk, lists.schema, spark)

    def search(self, target: dict[int, float], k: int | None, metric: str = "inner_product") -> DataFrame:
        """Exact: only the query's own lists are read."""
        wanted = F.create_map(*(x for i, w in target.items() for x in (F.lit(int(i)), F.lit(float(w)))))
        rows = self.spark.read.schema(self.schema).parquet(self.uri).filter(F.col("idx").isin(*target))
        dot = F.sum(F.col("val") * F.try_element_at(wanted, "idx"))
        size = float(np.sqrt(sum(w * w for w in target.values())))
        value = -dot if metric == "inner_product" else 1 - dot / (F.max("norm") * size)
        out = rows.groupBy(*self.pk).agg(dot.alias("_dot"), value.alias("_distance")).filter("_dot <> 0").drop("_dot").orderBy("_distance", *self.pk)
        return out if k is None else out.limit(k)


def recall(found: DataFrame, exact: DataFrame, query: str, pk: tuple[str, ...]) -> DataFrame:
    """Share of exact neighbours that an index found, for each query and in all."""
    hits = exact.join(found.select(query, *pk).withColumn("_hit", F.lit(1)), [query, *pk], "left")
    return hits.groupBy(query).agg((F.count("_hit") / F.count(F.lit(1))).alias("recall"))


def top(rows: DataFrame, query: str, pk: tuple[str, ...], k: int) -> DataFrame:
    """The k nearest of each query."""
    w = Window.partitionBy(query).orderBy("_distance", *pk)
    return rows.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= k)
