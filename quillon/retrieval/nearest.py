"""NEAREST: exact vector search, IVF and IVF-PQ, sparse vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from quillon.functions import vectors

SAMPLE = 20_000  # most vectors that a quantiser is trained on


def nearest(rows: DataFrame, column: str, target, pk: tuple[str, ...], metric: str = "cosine", k: int | None = None, where: Column | None = None) -> DataFrame:
    """Rows by distance, then primary key; null vectors are left out. Exact.

    A projection and a top-k: each task keeps its k best.
    """
    out = rows.filter(F.col(column).isNotNull())
    if where is not None:
        out = out.filter(where)
    out = out.withColumn("_distance", vectors.distance(metric, F.col(column), vectors.literal(target)))
    out = out.orderBy("_distance", *pk)
    return out if k is None else out.limit(k)


def kmeans(x: np.ndarray, lists: int, rounds: int = 20, seed: int = 7) -> np.ndarray:
    """Centres by k-means++ and Lloyd rounds (sums, no BLAS)."""
    rng = np.random.default_rng(seed)
    centres = [x[int(rng.integers(len(x)))]]
    gap = ((x - centres[0]) ** 2).sum(axis=1)
    while len(centres) < min(lists, len(x)):
        total = gap.sum()
        pick = int(rng.integers(len(x))) if total <= 0 else int(np.searchsorted(np.cumsum(gap), rng.random() * total))
        centres.append(x[min(pick, len(x) - 1)])
        gap = np.minimum(gap, ((x - centres[-1]) ** 2).sum(axis=1))
    c = np.array(centres)
    for _ in range(rounds):
        near = closest(x, c)
        held = np.bincount(near, minlength=len(c))[:, None]
        sums = np.stack([np.bincount(near, weights=x[:, j], minlength=len(c)) for j in range(x.shape[1])], axis=1)
        new = np.where(held > 0, sums / np.maximum(held, 1), c)
        if np.allclose(new, c):
            break
        c = new
    return c


def closest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    if 0 < x.shape[1] <= 8 and len(x):  # parts of vectors: element by element, as sums along a short axis are slow
        c = np.ascontiguousarray(centres.T)
        return np.concatenate([sum(np.square(x[i : i + 256, j, None] - c[j]) for j in range(x.shape[1])).argmin(axis=1) for i in range(0, len(x), 256)])
    return np.concatenate([((x[i : i + 256, None, :] - centres[None]) ** 2).sum(axis=2).argmin(axis=1) for i in range(0, len(x), 256)]) if len(x) else np.zeros(0, np.int64)


@dataclass
class IVF:
    """Inverted lists: every row carries the list of its nearest centre.

    Centres are fitted on at most ``SAMPLE`` vectors; all rows are assigned.
    """

    rows: DataFrame
    column: str
    pk: tuple[str, ...]
    metric: str
    centres: np.ndarray

    @classmethod
    def build(cls, rows: DataFrame, column: str, pk: tuple[str, ...], lists: int, metric: str = "cosine") -> IVF:
        rows = rows.filter(F.col(column).isNotNull())
        sample = rows.orderBy(F.xxhash64(*pk)).limit(SAMPLE).select(column).collect()
        x = np.array([r[0] for r in sample], dtype=float)
        if metric == "cosine":
            x = x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-12)
        centres = kmeans(x, lists)
        unit = metric == "cosine"

        @F.pandas_udf("int")
        def assign(v):
            x = np.array(v.tolist(), dtype=float).reshape(len(v), -1)
            if unit:
                x = x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-12)
            import pandas as pd

            return pd.Series(closest(x, centres).astype(np.int32))

        return cls(rows.withColumn("_list", assign(F.col(column))), column, pk, metric, centres)

    def search(self, target, k: int, probes: int) -> DataFrame:
        """The k nearest rows of the ``probes`` nearest lists."""
        t = np.array(target, dtype=float)
        if self.metric == "cosine":
            t = t / max(np.sqrt((t * t).sum()), 1e-12)
        lists = np.argsort(((self.centres - t) ** 2).sum(axis=1), kind="stable")[:probes].tolist()
        return nearest(self.rows.filter(F.col("_list").isin(*lists)), self.column, target, self.pk, self.metric, k).drop("_list")


def sparse_distance(column: str, target: dict[int, float], metric: str = "inner_product") -> Column:
    """What NEAREST orders ``struct<idx, val>`` vectors by: minus the inner product, or one minus the cosine."""
    wanted = F.create_map(*(x for i, w in target.items() for x in (F.lit(int(i)), F.lit(float(w)))))
    pairs = F.zip_with(F.col(f"{column}.idx"), F.col(f"{column}.val"), lambda i, v: F.coalesce(F.try_element_at(wanted, i), F.lit(0.0)) * v.cast("double"))
    dot = F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)
    if metric == "inner_product":
        return -dot
    if metric != "cosine":
        raise ValueError("a sparse column is ranked by COSINE or INNER_PRODUCT")
    size = vectors.norm(F.col(f"{column}.val")) * float(np.sqrt(sum(w * w for w in target.values())))
    return 1 - F.when(size == 0, F.lit(0.0)).otherwise(dot / size)


def sparse_nearest(rows: DataFrame, column: str, target: dict[int, float], pk: tuple[str, ...], k: int | None = None) -> DataFrame:
    """Inner product of ``struct<idx, val>`` vectors with a sparse query, best first."""
    out = rows.filter(F.col(column).isNotNull()).withColumn("_distance", sparse_distance(column, target))
    out = out.filter("_distance <> 0").orderBy("_distance", *pk)
    return out if k is None else out.limit(k)


class ProductQuantiser:
    """Codes of ``subspaces`` bytes; distances from one table for each query.

    ``each`` maps a function over the subspaces' parts of the sample.
    """

    def __init__(self, sample: np.ndarray, subspaces: int, codes: int = 256, each: Callable = map) -> None:
        self.width = sample.shape[1] // subspaces
        if sample.shape[1] % subspaces:
            raise ValueError("SUBSPACES must divide the dimension")
        self.books = list(each(lambda part: kmeans(part, codes), [sample[:, i * self.width : (i + 1) * self.width] for i in range(subspaces)]))

    def encode(self, x: np.ndarray) -> np.ndarray:
        return np.stack([closest(x[:, i * self.width : (i + 1) * self.width], b) for i, b in enumerate(self.books)], axis=1).astype(np.uint8)

    def table(self, target: np.ndarray) -> list[np.ndarray]:
        return [((b - target[i * self.width : (i + 1) * self.width]) ** 2).sum(axis=1) for i, b in enumerate(self.books)]


def ivf_pq_search(ivf: IVF, quantiser: ProductQuantiser, target, k: int, probes: int, rerank: int = 4) -> DataFrame:
    """Candidates by asymmetric code distances, reranked exactly."""
    t = np.array(target, dtype=float)
    unit = ivf.metric == "cosine"
    if unit:
        t = t / max(np.sqrt((t * t).sum()), 1e-12)
    lists = np.argsort(((ivf.centres - t) ** 2).sum(axis=1), kind="stable")[:probes].tolist()
    table, column = quantiser.table(t), ivf.column
    rows = ivf.rows.filter(F.col("_list").isin(*lists))
    schema = StructType([*rows.schema.fields, StructField("_approx", DoubleType())])

    def op(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array(b.column(column).to_pylist(), dtype=float).reshape(b.num_rows, -1)
            if unit and len(x):
                x = x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-12)
            codes = quantiser.encode(x) if len(x) else np.zeros((0, len(table)), np.uint8)
            far = np.sum([table[i][codes[:, i]] for i in range(len(table))], axis=0) if len(x) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(far, pa.float64())], names=[*b.schema.names, "_approx"])

    near = rows.mapInArrow(op, schema).orderBy("_approx", *ivf.pk).limit(k * rerank)
    return nearest(near.drop("_list", "_approx"), column, target, ivf.pk, ivf.metric, k)
