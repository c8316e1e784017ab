"""Packing of tokenised documents by cutting-stock column generation.

A document's ids (with its end id) are cut at multiples of the sequence
length; each full piece is a sequence of its own without padding. The rests
are the stock problem: their lengths are counted in classes of ``GRAIN``
tokens, a linear program over patterns (multisets of classes that fit in a
sequence) finds how often to use each pattern, and a knapsack dynamic program
over the current dual prices finds new columns until none helps. Patterns are
rounded down; what is left is packed by first-fit decreasing. Documents are
ranked in their class and dealt to the places of the patterns by rank.

Scale: texts are tokenised once, without a shuffle, to one row for each piece
(ids stay where they are; a piece carries their crc32). Only the length
histogram, at most ``length / GRAIN`` counts, goes to the driver. Ranks come
from prefix sums of class counts over partitions, places from arithmetic on
the bounded pattern table, offsets from a window over one sequence.

Padding: a sequence that is not full is padded to the sequence length, or not
at all if its length is a power of two.

Edge cases: null and empty texts are one end id; repeated rows are documents
of their own; null ids are ordinary documents. Other columns are ignored.
"""

from __future__ import annotations

import warnings
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from quillon.llm import kernels as K, tokenize
from quillon.llm.storage import materialise, ship

LENGTH = 2048
GRAIN = 8
END_ID = 1

_PIECES = "part int, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, class int"


def pieces(docs: DataFrame, path: str, length: int = LENGTH, end_id: int = END_ID, grain: int = GRAIN, cache_words: int | None = None) -> DataFrame:
    """Pieces of at most ``length`` ids of every document: ``_PIECES``.

    ``class`` is 0 for a full piece, else its length in grains, rounded up.
    """

    def op(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokenize.encoder(path)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            out: list[list[int]] = [[] for _ in range(6)]
            for a in range(0, batch.num_rows, 512):
                for doc_id, found in zip(ids[a : a + 512], encoder.arrays(batch.column("text").slice(a, 512), cache_words), strict=True):
                    packed = found.tobytes() + end
                    total = len(packed) // 4
                    for s in range(0, total, length):
                        n = min(length, total - s)
                        row = (doc_id, s, n, zlib.crc32(packed[4 * s : 4 * (s + n)]), total, 0 if n == length else -(-n // grain))
                        for column, value in zip(out, row, strict=True):
                            column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in out[:5]] + [pa.array(out[5], pa.int32())], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "class"]
            )

    schema = _PIECES.removeprefix("part int, ")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(K.lean(op), schema)


def knapsack(prices: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The dearest multiset of sizes 1..len(prices) within a capacity."""
    best, choice = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for c in range(1, capacity + 1):
        m = min(c, len(prices))
        value = prices[:m] + best[c - 1 :: -1][:m]
        k = int(value.argmax())
        best[c], choice[c] = (value[k], k + 1) if value[k] > best[c - 1] else (best[c - 1], 0)
    pattern, c = np.zeros(len(prices), np.int64), capacity
    while c > 0:
        if choice[c]:
            pattern[choice[c] - 1] += 1
            c -= choice[c]
        else:
            c -= 1
    return float(best[capacity]), pattern


def column_generation(demand: np.ndarray, capacity: int, rounds: int = 5000) -> tuple[np.ndarray, np.ndarray]:
    """Patterns and how often to use each (fractional) to cover a demand.

    ``demand[i]`` pieces of size i + 1. Revised simplex: the basis starts with
    one-size patterns; each round prices columns by ``knapsack`` and pivots.
    """
    sizes = np.flatnonzero(demand > 0)
    m = len(sizes)
    if not m:
        return np.zeros((0, len(demand)), np.int64), np.zeros(0)
    # sums of products instead of BLAS, whose threads don't get on with forks
    times = lambda a, b: (a * b).sum(axis=1)
    basis = np.diag(capacity // (sizes + 1)).astype(float)
    inverse = np.diag(1 / np.diag(basis))
    x = times(inverse, demand[sizes])
    value = 0.0
    for step in range(rounds):
        duals = inverse.sum(axis=0)
        prices = np.zeros(len(demand))
        prices[sizes] = np.maximum(duals, 0)
        value, pattern = knapsack(prices, capacity)
        if value <= 1 + 1e-7:
            break
        column = pattern[sizes].astype(float)
        direction = times(inverse, column)
        up = direction > 1e-9
        ratio = np.full(m, np.inf)
        ratio[up] = x[up] / direction[up]
        out = int(ratio.argmin())
        theta = ratio[out]
        x = np.maximum(x - theta * direction, 0)
        x[out] = theta
        basis[:, out] = column
        inverse[out] /= direction[out]
        factor = direction.copy()
        factor[out] = 0
        inverse -= np.outer(factor, inverse[out])
        if step % 200 == 199:  # a Newton step takes back the rounding errors
            error = np.eye(m) - np.einsum("ij,jk->ik", basis, inverse)
            inverse += np.einsum("ij,jk->ik", inverse, error)
            x = np.maximum(times(inverse, demand[sizes]), 0)
    else:
        warnings.warn(f"column generation stopped after {rounds} rounds; at most a share of {1 - 1 / value:.2g} of the sequences could be saved", stacklevel=2)
    patterns = np.zeros((m, len(demand)), np.int64)
    patterns[:, sizes] = np.rint(basis).astype(np.int64).T
    return patterns, x


def plan(demand: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Whole patterns and their counts that take exactly the demand."""
    patterns, x = column_generation(demand, capacity)
    use = np.floor(x + 1e-6).astype(np.int64)
    taken = lambda: (patterns * use[:, None]).sum(axis=0)
    while (over := taken() > demand).any():  # rounding errors only
        use[int(np.argmax((patterns[:, over].sum(axis=1) > 0) & (use > 0)))] -= 1
    left = demand - taken()
    rest, room, bins = left.copy(), [], []
    for size in range(len(demand), 0, -1):
        while rest[size - 1]:
            free = next((b for b, r in enumerate(room) if r >= size), None)
            if free is None:
                room.append(capacity)
                bins.append(np.zeros(len(demand), np.int64))
                free = len(bins) - 1
            take = int(min(rest[size - 1], room[free] // size))
            bins[free][size - 1] += take
            room[free] -= take * size
            rest[size - 1] -= take
    keep = use > 0
    all_patterns = np.concatenate([patterns[keep], np.array(bins).reshape(-1, len(demand))]) if bins else patterns[keep]
    return all_patterns, np.concatenate([use[keep], np.ones(len(bins), np.int64)])


def places(patterns: np.ndarray, use: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each class: cumulative places, places per sequence, first sequence."""
    first = np.cumsum(use) - use
    out = []
    for c in range(patterns.shape[1]):
        j = np.flatnonzero(patterns[:, c])
        each = patterns[j, c]
        out.append((np.cumsum(each * use[j]), each, first[j]))
    return out


def pack(docs: DataFrame, path: str, length: int = LENGTH, end_id: int = END_ID, grain: int = GRAIN, cache_words: int | None = None) -> DataFrame:
    """Assign all pieces of all documents to sequences.

    Returns one row for each piece: doc_id, start, length, ids_crc32,
    doc_tokens, sequence_id, offset, padding (of its sequence).
    ``cache_words`` bounds the word cache of a worker (time against memory).
    """
    if length % grain:
        raise ValueError("the grain must divide the sequence length")
    ship(docs.sparkSession)
    spark = docs.sparkSession
    cut = materialise(pieces(docs, path, length, end_id, grain, cache_words), "pieces")
    capacity = length // grain
    counts = {r["class"]: r["n"] for r in cut.groupBy("class").agg(F.count(F.lit(1)).alias("n")).collect()}
    demand = np.array([counts.get(c, 0) for c in range(1, capacity + 1)], np.int64)
    patterns, use = plan(demand, capacity)
    table = places(patterns, use)
    mixed = int(use.sum())

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    ranged = cut.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    ranged = materialise(ranged, "ranked")
    before = Window.partitionBy("class").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = ranged.groupBy("class", "part").agg(F.count(F.lit(1)).alias("n")).withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    local = Window.partitionBy("part", "class").orderBy(*order)
    rows = ranged.join(base, ["class", "part"]).withColumn("rank", F.row_number().over(local) - 1 + F.col("base"))

    def op(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind, ranks = batch.column("class").to_numpy(), batch.column("rank").to_numpy()
            sequence, slot = mixed + ranks, np.zeros(len(kind), np.int64)
            for c in np.unique(kind[kind > 0]).tolist():
                at = np.flatnonzero(kind == c)
                ends, each, first = table[c - 1]
                j = np.searchsorted(ends, ranks[at], "right")
                inside = ranks[at] - np.where(j > 0, ends[j - 1], 0)
                sequence[at] = first[j] + inside // each[j]
                slot[at] = (capacity - c) * (length + 1) + inside % each[j]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in order] + [pa.array(sequence), pa.array(slot)], names=[*order, "sequence_id", "slot"])

    dealt = rows.select("class", "rank", *order).mapInArrow(K.lean(op), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, slot long")
    one = Window.partitionBy("sequence_id")
    ahead = one.orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("length").over(one)
    power = F.pow(F.lit(2.0), F.round(F.log2(total.cast("double")))).cast("long") == total
    return dealt.select(
        *order, "sequence_id", F.coalesce(F.sum("length").over(ahead), F.lit(0)).alias("offset"), F.when(power, 0).otherwise(length - total).cast("long").alias("padding")
    )
