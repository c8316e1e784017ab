"""Repeated spans by winnowed runs; shared by the word and byte operators.

Every window of ``k + w - 1`` units selects one k-gram, its *anchor* (see
``kernels.winnow``). Consecutive windows with one anchor form a *run*, whose
content is the text all its windows cover. Two documents that share a window
share its anchor, so only runs under one anchor need to be compared, and runs
of equal content (copies, however many) are compared once.

A document row is known by ``ROW``: ``row_id``, its id (or, without one, a
hash of its text), and ``row_key``, a hash of id and text. Repeated rows and
null ids need no special case, and rows of different ids never meet, however
many there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quillon.llm import kernels as K

ROW = ["row_id", "row_key"]
RUNS = "anchor long, run long, row_id long, row_key long, start int, n int"
_RUN_NAMES = ["anchor", "run", *ROW, "start", "n"]


def keyed(docs: DataFrame, *also: str) -> DataFrame:
    """doc_id, text and the key of the row (and the columns ``also``)."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), *also)
    return d.withColumn("row_id", F.coalesce("doc_id", F.xxhash64("text"))).withColumn("row_key", F.xxhash64("doc_id", "text"))


def units(data: np.ndarray, offs: np.ndarray, words: bool):
    """Prefix sums, powers, first unit of each document and byte spans of units."""
    prefix = K.byte_prefix(data)
    if not words:
        return prefix, K.BYTES, offs, None, None
    starts, ends, first = K.word_spans(data, offs, K.NON_SPACE)
    return K.word_prefix(K.span_hash(prefix, starts, ends)), K.WORDS, first, starts, ends


def runs_of(docs: DataFrame, k: int, w: int, words: bool) -> DataFrame:
    """One row for each run of each document: ``RUNS``."""

    def op(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, keys = batch.column("row_id").to_numpy(), batch.column("row_key").to_numpy()
            data, offs = K.text_buffer(batch.column("text"))
            for i, j in K.slices(offs):
                prefix, powers, first, _, _ = units(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], words)
                n = len(prefix) - 1
                if n < k + w - 1:
                    continue
                at = np.arange(n - k + 1)
                grams = K.span_hash(prefix, at, at + k, powers)
                starts, chosen = K.winnow(grams, first, k, w)
                rows = K.row_of(first, starts)
                a, b = K.runs(starts, chosen, rows)
                if not len(a):
                    continue
                s, e, row = starts[a], starts[b - 1] + k + w - 1, rows[a]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(grams[chosen[a]].view(np.int64)),
                        pa.array(K.span_hash(prefix, s, e, powers).view(np.int64)),
                        pa.array(own[i + row]),
                        pa.array(keys[i + row]),
                        pa.array((s - first[row]).astype(np.int32)),
                        pa.array((b - a).astype(np.int32)),
                    ],
                    names=_RUN_NAMES,
                )

    return docs.select(*ROW, "text").mapInArrow(K.lean(op), RUNS)


def by_document(marks: DataFrame, *fields: str) -> DataFrame:
    """Rows of one document gathered in one array (no longer than its text)."""
    return marks.groupBy(*ROW).agg(F.collect_list(F.struct(*fields)).alias("marks"))


def list_rows(column: pa.Array) -> tuple[np.ndarray, dict[str, np.ndarray | pa.Array]]:
    """Offsets and flat fields of a list-of-struct column without nulls in it."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = column.value_lengths().fill_null(0).to_numpy()
    flat = column.flatten()
    out = {flat.type.field(i).name: flat.field(i) for i in range(flat.type.num_fields)}
    return np.concatenate([[0], np.cumsum(lengths)]), out


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], weight) -> Iterator[pa.Table]:
    """Tables of whole groups from batches sorted by ``keys``."""
    held: list[pa.RecordBatch] = []
    load = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        load += weight(batch)
        if load < 1:
            continue
        t = pa.Table.from_batches(held)
        last = np.ones(t.num_rows, dtype=bool)
        for k in keys:
            v = t[k].to_numpy()
            last &= v == v[-1]
        cut = int(np.argmax(last))
        if cut:
            yield t.slice(0, cut).combine_chunks()
            held = t.slice(cut).to_batches()
            load = 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()
