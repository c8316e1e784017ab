"""Suffix-array dedup: hash-compared suffix sort over repeated-span candidates.

Every byte covered by a string of ``threshold`` bytes that also starts
anywhere else goes. Suffixes are compared by their longest common extension,
found by binary search on prefix polynomial hashes, in a mergesort; adjacent
suffixes that agree on ``threshold`` bytes are compared byte by byte before
they count (collision verification).

Scale: a suffix array of the whole corpus does not fit a cluster's budget, so
the suffixes are dealt out first. Equal strings of ``threshold`` bytes select
the same winnowed anchor at the same place, so suffixes are sorted only
against those of the same anchor and offset. Contexts of equal content
(copies) collapse by partial aggregation before any sort, and anchors with a
single context need none. An anchor with more than ``bucket`` differing
contexts is not sorted in one task: its windows are counted by hash in a
shuffled aggregation, which is exact up to 128-bit hash equality.

Edge cases: null and empty texts have no bytes; texts shorter than the
threshold lose nothing; repeated rows are repeats of each other; null ids are
ordinary rows. Columns other than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quillon.llm import kernels as K, repeats
from quillon.llm.storage import materialise, ship
from quillon.llm.substring_dedup import mask_of

THRESHOLD = 200
BUCKET = 4096
_K = 64
_CHUNK = 1 << 19


def common_extension(data: np.ndarray, prefix: np.ndarray, p: np.ndarray, q: np.ndarray, limit: int) -> np.ndarray:
    """Length of the common extension of the suffixes at p and q, at most ``limit``.

    Binary search on prefix hashes; both suffixes have ``limit`` bytes.
    """
    lo, hi = np.zeros(len(p), np.int64), np.full(len(p), limit, np.int64)
    _, inverse = K.BYTES.upto(len(prefix))
    inv_p, inv_q, at_p, at_q = inverse[p], inverse[q], prefix[p], prefix[q]
    while True:
        open_ = lo < hi
        if not open_.any():
            return lo
        mid = (lo + hi + 1) >> 1
        same = (prefix[p + mid] - at_p) * inv_p == (prefix[q + mid] - at_q) * inv_q
        lo = np.where(open_ & same, mid, lo)
        hi = np.where(open_ & ~same, mid - 1, hi)


def _less(data: np.ndarray, prefix: np.ndarray, p: np.ndarray, q: np.ndarray, limit: int, or_equal: np.ndarray) -> np.ndarray:
    length = common_extension(data, prefix, p, q, limit)
    differ = length < limit
    out = or_equal.copy()
    at = np.flatnonzero(differ)
    out[at] = data[p[at] + length[at]] < data[q[at] + length[at]]
    return out


def suffix_sort(data: np.ndarray, prefix: np.ndarray, group: np.ndarray, pos: np.ndarray, limit: int) -> np.ndarray:
    """Order that sorts suffixes by (group, first ``limit`` bytes), stably.

    A bottom-up mergesort, all groups and all pairs of runs at once: each
    element finds its place in the sibling run by binary search.
    """
    order = np.argsort(group, kind="stable")
    g = group[order]
    begin = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
    size = np.diff(np.append(begin, len(g)))
    base, total = np.repeat(begin, size), np.repeat(size, size)
    index = np.arange(len(g)) - base
    width, most = 1, int(size.max()) if len(size) else 0
    while width < most:
        live = np.flatnonzero(total > width)
        at, n, b = index[live], total[live], base[live]
        side = (at // width) & 1
        pair = at // (2 * width) * (2 * width)
        s0 = np.where(side == 0, pair + width, pair)
        s1 = np.minimum(np.where(side == 0, pair + 2 * width, pair + width), n)
        s0 = np.minimum(s0, n)
        lo, hi, mine = s0.copy(), s1.copy(), pos[order[b + at]]
        while True:
            todo = np.flatnonzero(lo < hi)
            if not len(todo):
                break
            mid = (lo[todo] + hi[todo]) >> 1
            other = pos[order[b[todo] + mid]]
            # the sibling stands first if it is less, or equal and the left run
            first = _less(data, prefix, other, mine[todo], limit, side[todo] == 1)
            lo[todo] = np.where(first, mid + 1, lo[todo])
            hi[todo] = np.where(first, hi[todo], mid)
        own = at - (pair + side * width)
        target = b + pair + own + (lo - s0)
        moved = order[b + at]
        order = order.copy()
        order[target] = moved
        width *= 2
    return order


def repeated_starts(data: np.ndarray, prefix: np.ndarray, group: np.ndarray, pos: np.ndarray, limit: int) -> np.ndarray:
    """Mask of suffixes whose first ``limit`` bytes occur twice in their group."""
    out = np.zeros(len(pos), dtype=bool)
    if len(pos) < 2:
        return out
    order = suffix_sort(data, prefix, group, pos, limit)
    a, b = order[:-1], order[1:]
    near = np.flatnonzero(group[a] == group[b])
    a, b = a[near], b[near]
    equal = common_extension(data, prefix, pos[a], pos[b], limit) == limit
    a, b = a[equal], b[equal]
    span = np.arange(limit)
    for i in range(0, len(a), 1 << 14):
        x, y = a[i : i + (1 << 14)], b[i : i + (1 << 14)]
        true = (data[pos[x][:, None] + span] == data[pos[y][:, None] + span]).all(axis=1)
        out[x[true]] = True
        out[y[true]] = True
    return out


def _contexts(docs: DataFrame, unclear: DataFrame, threshold: int) -> DataFrame:
    """Bytes of each unclear context, cut from its representative document."""
    by_doc = unclear.groupBy(*repeats.ROW).agg(F.collect_list(F.struct("anchor", "run", "start", "n", "lone", "hot")).alias("marks"))
    both = docs.join(by_doc, repeats.ROW).select("text", "marks")

    def op(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = K.text_buffer(batch.column("text"))
            moffs, marks = repeats.list_rows(batch.column("marks"))
            m = int(moffs[-1])
            if not m:
                continue
            row = np.searchsorted(moffs, np.arange(m), "right") - 1
            start = offs[row] + marks["start"].to_numpy()
            end = start + marks["n"].to_numpy() + threshold - 1
            raw = data.tobytes()
            texts = [raw[s:e] for s, e in zip(start.tolist(), end.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [marks[c] for c in ("anchor", "run", "n", "lone", "hot")] + [pa.array(texts, pa.binary())],
                names=["anchor", "run", "n", "lone", "hot", "context"],
            )

    return both.mapInArrow(K.lean(op), "anchor long, run long, n int, lone boolean, hot boolean, context binary")


def _sort_buckets(contexts: DataFrame, threshold: int) -> DataFrame:
    """anchor, run, ats: the offsets of repeated windows, by suffix sort."""

    def solve(t: pa.Table) -> pa.RecordBatch:
        t = t.combine_chunks()
        data, offs = K.text_buffer(t["context"])
        anchor, n = t["anchor"].to_numpy(), t["n"].to_numpy()
        gram = _anchor_place(data, offs, n, threshold)
        prefix = K.byte_prefix(data)
        of = np.repeat(np.arange(len(n)), n)
        at = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        _, bucket = np.unique(anchor, return_inverse=True)
        group = bucket[of] * (2 * threshold) + (gram[of] - at)
        hit = repeated_starts(data, prefix, group, offs[of] + at, threshold)
        keep = hit & t["lone"].to_numpy(zero_copy_only=False)[of]
        counts = np.bincount(of[keep], minlength=len(n))
        some = np.flatnonzero(counts)
        lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(counts[some])]).astype(np.int32), pa.array(at[keep].astype(np.int32)))
        return pa.RecordBatch.from_arrays([t["anchor"].chunk(0).take(pa.array(some)), t["run"].chunk(0).take(pa.array(some)), lists], names=["anchor", "run", "ats"])

    def op(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        windows = 0
        for batch in batches:
            held.append(batch)
            windows += int(np.sum(batch.column("n").to_numpy()))
            if windows < _CHUNK:
                continue
            t = pa.Table.from_batches(held)
            a = t["anchor"].to_numpy()
            cut = int(np.searchsorted(a, a[-1]))  # sorted: the last anchor may go on
            if cut:
                done = t.slice(0, cut)
                yield from _pieces(done, solve)
            held, windows = t.slice(cut).to_batches(), 0
        if held:
            yield from _pieces(pa.Table.from_batches(held), solve)

    near = contexts.filter("NOT hot").repartition("anchor").sortWithinPartitions("anchor").select("anchor", "run", "n", "lone", "context")
    return near.mapInArrow(K.lean(op), "anchor long, run long, ats array<int>")


def _pieces(t: pa.Table, solve) -> Iterator[pa.RecordBatch]:
    """Whole anchors of about _CHUNK windows at a time."""
    a = t["anchor"].to_numpy()
    ends = np.append(np.flatnonzero(a[1:] != a[:-1]) + 1, len(a))
    load = np.cumsum(t["n"].to_numpy())[ends - 1]
    done = since = 0
    for k, e in enumerate(ends.tolist()):
        if load[k] - since >= _CHUNK or k == len(ends) - 1:
            yield solve(t.slice(done, e - done))
            done, since = e, load[k]


def _anchor_place(data: np.ndarray, offs: np.ndarray, n: np.ndarray, threshold: int) -> np.ndarray:
    """Offset of the anchor in each context: the k-gram its first window selects."""
    prefix = K.byte_prefix(data)
    at = np.arange(len(data) - _K + 1)
    grams = K.span_hash(prefix, at, at + _K)
    starts, chosen = K.winnow(grams, offs, _K, threshold - _K + 1)
    where = np.searchsorted(starts, offs[:-1])
    return chosen[where] - offs[:-1]


def _count_windows(contexts: DataFrame, threshold: int) -> DataFrame:
    """anchor, run, ats for hot anchors: windows counted by hash, without a bucket."""

    def op(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = K.text_buffer(batch.column("context"))
            n = batch.column("n").to_numpy()
            prefix = K.byte_prefix(data)
            of = np.repeat(np.arange(len(n)), n)
            at = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
            win = K.span_hash(prefix, offs[of] + at, offs[of] + at + threshold)
            take = pa.array(of)
            yield pa.RecordBatch.from_arrays(
                [batch.column(c).take(take) for c in ("anchor", "run", "lone")] + [pa.array(at.astype(np.int32)), pa.array(win.view(np.int64))],
                names=["anchor", "run", "lone", "at", "win"],
            )

    rows = contexts.filter("hot").select("anchor", "run", "n", "lone", "context").mapInArrow(K.lean(op), "anchor long, run long, lone boolean, at int, win long")
    rows = materialise(rows, "hot-windows")
    twice = rows.groupBy("anchor", "win").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").drop("c")
    return rows.filter("lone").join(twice, ["anchor", "win"]).groupBy("anchor", "run").agg(F.collect_set("at").alias("ats"))


def repeat_spans(docs: DataFrame, threshold: int = THRESHOLD, bucket: int = BUCKET) -> DataFrame:
    """Byte spans to remove: the row (``repeats.ROW``) and ``marks``, as in ``substring_dedup``."""
    found = repeats.runs_of(docs, _K, threshold - _K + 1, words=False)
    contexts = materialise(
        found.groupBy("anchor", "run").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("row_id", "row_key", "start")).alias("rep"), F.max("n").alias("n")), "contexts"
    )
    differing = materialise(contexts.groupBy("anchor").agg(F.count(F.lit(1)).alias("contexts")).filter("contexts > 1"), "differing")
    unclear = contexts.join(differing, "anchor").select(
        "anchor", "run", "rep.row_id", "rep.row_key", "rep.start", "n", (F.col("c") == 1).alias("lone"), (F.col("contexts") > bucket).alias("hot")
    )
    cut = materialise(_contexts(docs, unclear, threshold), "unclear")
    partly = _sort_buckets(cut, threshold).unionByName(_count_windows(cut, threshold))
    whole = contexts.filter("c > 1").select("anchor", "run", F.lit(None).cast("array<int>").alias("ats"))
    verdict = materialise(whole.unionByName(partly), "verdict")
    return repeats.by_document(found.join(verdict, ["anchor", "run"]), "start", "n", "ats")


def suffix_dedup(docs: DataFrame, threshold: int = THRESHOLD, bucket: int = BUCKET) -> DataFrame:
    """Remove every byte of a string of ``threshold`` bytes that occurs twice.

    Returns one row for each row of ``docs``: doc_id, n_bytes, n_removed,
    n_spans (maximal removed stretches), kept_sha256 and kept_bytes.
    """
    ship(docs.sparkSession)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = repeats.keyed(docs).repartition(parts, *repeats.ROW)
    spans = repeat_spans(repeats.keyed(docs), threshold, bucket)
    both = rows.join(spans, repeats.ROW, "left").select("doc_id", "text", "marks")

    def op(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = K.text_buffer(batch.column("text"))
            moffs, marks = repeats.list_rows(batch.column("marks"))
            size, removed, spans_, digest, kept = [], [], [], [], []
            for r in range(batch.num_rows):
                own = data[offs[r] : offs[r + 1]]
                gone = mask_of(len(own), moffs, r, marks, threshold)
                size.append(len(own))
                removed.append(int(gone.sum()))
                spans_.append(int(np.count_nonzero(gone[1:] & ~gone[:-1]) + (len(gone) > 0 and bool(gone[0]))))
                rest = (own[~gone] if removed[-1] else own).tobytes()
                digest.append(hashlib.sha256(rest).hexdigest())
                kept.append(rest)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans_, pa.int64()), pa.array(digest, pa.string()), pa.array(kept, pa.binary())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_bytes"],
            )

    return both.mapInArrow(K.lean(op), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_bytes binary")
