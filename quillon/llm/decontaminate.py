"""Benchmark decontamination by winnowing.

Every window of 10 words of a test item selects its least k-gram; so does
every window of a training text. A shared span of at least 10 words therefore
shares a fingerprint, whatever stands around it. Windows of training texts
whose fingerprint is a test fingerprint are extended to the whole window and
compared word by word (as 64-bit word hashes). Items of fewer than 10 words
are one window of their own length; these lengths, at most nine, are looked
up directly.

Scale: up to ``block_bytes`` of item text are one index that goes to all
tasks, and training texts are read once, without a shuffle. More test items
are joined: their distinct fingerprints with those of the training texts (one
row for each run of windows with one fingerprint), and the windows of what
meets with the items' windows. Windows with the same items share one list of
items, and documents with the same lists one digest, so a window of very many
items meets many documents without a row for each pair. Only items of fewer
than 10 words stay in indexes of ``block_bytes``, each of which reads the
training texts once more. Nothing that grows with either side goes to the
driver.

Edge cases: null and empty texts have no words; items without words are
skipped; repeated items count once by id; an item without an id counts as the
id ''. Columns other than doc_id, text, item_id are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from quillon.llm import kernels as K, repeats
from quillon.llm.components import apart
from quillon.llm.storage import materialise, ship

SPAN = 10
_K = 5
BLOCK_BYTES = 8 << 20

_HITS = "row_id long, row_key long, doc_id long, n_words long, starts array<int>, ends array<int>, items array<string>"
_LISTS = ("starts", "ends", "items")
_NAMES = [*repeats.ROW, "doc_id", "n_words", *_LISTS]


def _words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words, and each document's first word."""
    data = K.LOWER[data]
    starts, ends, first = K.word_spans(data, offs, K.ALNUM)
    return K.span_hash(K.byte_prefix(data), starts, ends), first


def _fingerprints(hashes: np.ndarray, first: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word prefix sums, window starts and each window's fingerprint."""
    prefix = K.word_prefix(hashes)
    n = len(hashes)
    if n < span:
        return prefix, np.zeros(0, np.int64), np.zeros(0, K.U64)
    at = np.arange(n - _K + 1)
    grams = K.span_hash(prefix, at, at + _K, K.WORDS)
    starts, chosen = K.winnow(grams, first, _K, span - _K + 1)
    return prefix, starts, grams[chosen]


class Index:
    """Fingerprints and windows of a block of test items."""

    def __init__(self, items: list[tuple[str, str]], span: int = SPAN) -> None:
        self.span, self.ids = span, [i for i, _ in items]
        texts = pa.array([t for _, t in items], pa.string())
        hashes, first = _words(*K.text_buffer(texts))
        prefix, starts, marks = _fingerprints(hashes, first, span)
        self.fingerprints = np.unique(marks)
        self.tables: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        lengths = np.diff(first)
        found = {span: (starts, K.row_of(first, starts))}
        for size in range(1, span):
            rows = np.flatnonzero(lengths == size)
            found[size] = (first[:-1][rows], rows)
        for size, (at, rows) in found.items():
            if len(at):
                keys = K.span_hash(prefix, at, at + size, K.WORDS)
                order = np.lexsort((rows, keys))
                words = hashes[at[order][:, None] + np.arange(size)]
                self.tables[size] = (keys[order], rows[order], words)

    def hits(self, hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word start, length and item row of every occurrence of a window."""
        prefix, starts, marks = _fingerprints(hashes, first, self.span)
        out = []
        for size, (keys, rows, words) in self.tables.items():
            if size == self.span:
                at = np.minimum(np.searchsorted(self.fingerprints, marks), len(self.fingerprints) - 1)
                where = starts[self.fingerprints[at] == marks] if len(marks) else starts
            else:
                where = K.window_starts(first, size)
            own = K.span_hash(prefix, where, where + size, K.WORDS)
            lo, hi = np.searchsorted(keys, own, "left"), np.searchsorted(keys, own, "right")
            n = hi - lo
            pos = np.repeat(where, n)
            entry = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            same = (hashes[pos[:, None] + np.arange(size)] == words[entry]).all(axis=1)
            out.append((pos[same], np.full(int(same.sum()), size), rows[entry[same]]))
        if not out:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _find(docs: DataFrame, index: Index, also: tuple[str, ...] = ()) -> DataFrame:
    """Per row of ``docs`` (``repeats.keyed``): hit spans and items of one block, and the columns ``also``."""
    fields = [docs.schema[c] for c in also]
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def op(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            data, offs = K.text_buffer(batch.column("text"))
            for i, j in K.slices(offs):
                hashes, first = _words(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                pos, size, item = index.hits(hashes, first)
                row = K.row_of(first, pos)
                order = np.argsort(row, kind="stable")
                pos, size, item, row = pos[order], size[order], item[order], row[order]
                edge = np.searchsorted(row, np.arange(j - i + 1))
                starts, ends, items = [], [], []
                for r, (a, b) in enumerate(zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)):
                    if a == b:
                        for x in (starts, ends, items):
                            x.append([])
                        continue
                    s, e = _merge(pos[a:b] - first[r], pos[a:b] - first[r] + size[a:b])
                    starts.append(s)
                    ends.append(e)
                    items.append(sorted({index.ids[x] for x in np.unique(item[a:b]).tolist()}))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(i, j - i) for c in (*repeats.ROW, "doc_id")), pa.array(np.diff(first), pa.int64()), pa.array(starts, pa.list_(pa.int32())), pa.array(ends, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))]
                    + [batch.column(c).slice(i, j - i) for c in also],
                    names=[*_NAMES, *also],
                )

    needed = dict.fromkeys([*repeats.ROW, "doc_id", "text", *also])
    return docs.select(*needed).mapInArrow(K.lean(op), StructType([*StructType.fromDDL(_HITS).fields, *fields]))


def _long_windows(items: DataFrame, span: int) -> DataFrame:
    """Distinct windows of items of at least ``span`` words: id, fp, key, check."""

    def op(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = K.text_buffer(batch.column("text"))
            for i, j in K.slices(offs):
                hashes, first = _words(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                prefix, at, marks = _fingerprints(hashes, first, span)
                ids = batch.column("id").take(pa.array(i + K.row_of(first, at)))
                yield pa.RecordBatch.from_arrays([ids, pa.array(marks.view(np.int64)), *_window_keys(hashes, prefix, at, span)], names=["id", "fp", "key", "check"])

    return items.select("id", "text").mapInArrow(K.lean(op), "id string, fp long, key long, check long").distinct()


def _window_keys(hashes: np.ndarray, prefix: np.ndarray, at: np.ndarray, span: int) -> list[pa.Array]:
    """Two independent hashes of windows, in place of their words."""
    other = K.word_prefix(K.mix(hashes ^ K.U64(0x9FB21C651E98DF25)))
    return [pa.array(K.span_hash(x, at, at + span, K.WORDS).view(np.int64)) for x in (prefix, other)]


def _runs(rows: DataFrame, span: int) -> DataFrame:
    """Runs of windows with one fingerprint: fp, row, first window, number."""

    def op(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = K.text_buffer(batch.column("text"))
            keys = [batch.column(c) for c in repeats.ROW]
            for i, j in K.slices(offs):
                hashes, first = _words(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                _, at, marks = _fingerprints(hashes, first, span)
                row = K.row_of(first, at)
                a, b = K.runs(at, marks, row)
                take = pa.array(i + row[a])
                yield pa.RecordBatch.from_arrays([pa.array(marks[a].view(np.int64)), *(k.take(take) for k in keys), pa.array((at[a] - first[row[a]]).astype(np.int32)), pa.array((b - a).astype(np.int32))], names=["fp", *repeats.ROW, "start", "n"])

    return rows.select(*repeats.ROW, "text").mapInArrow(K.lean(op), "fp long, row_id long, row_key long, start int, n int")


def _marked_windows(rows: DataFrame, marks: DataFrame, span: int) -> DataFrame:
    """Windows of marked runs: row, at, key, check."""

    def op(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = K.text_buffer(batch.column("text"))
            moffs, found = repeats.list_rows(batch.column("marks"))
            start, n = (found[c].to_numpy().astype(np.int64) for c in ("start", "n"))
            keys = [batch.column(c) for c in repeats.ROW]
            for i, j in K.slices(offs):
                a, b = moffs[i], moffs[j]
                hashes, first = _words(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                row = np.searchsorted(moffs, np.arange(a, b), "right") - 1 - i
                of = np.repeat(row, n[a:b])
                at = np.repeat(start[a:b] - np.cumsum(n[a:b]) + n[a:b], n[a:b]) + np.arange(n[a:b].sum())
                take = pa.array(i + of)
                yield pa.RecordBatch.from_arrays([*(k.take(take) for k in keys), pa.array(at.astype(np.int32)), *_window_keys(hashes, K.word_prefix(hashes), first[of] + at, span)], names=[*repeats.ROW, "at", "key", "check"])

    return rows.join(marks, repeats.ROW).select(*repeats.ROW, "text", "marks").mapInArrow(K.lean(op), "row_id long, row_key long, at int, key long, check long")


def _joined(rows: DataFrame, items: DataFrame, span: int) -> DataFrame:
    """Hits of items of at least ``span`` words, by joins: row, starts, ends, items."""
    windows = materialise(_long_windows(items, span), "item-windows")
    fps = windows.select("fp").distinct()
    near = _runs(rows, span).join(apart(fps), "fp", "left_semi").groupBy(*repeats.ROW).agg(F.collect_list(F.struct("start", "n")).alias("marks"))
    seen = _marked_windows(rows, near, span)
    # a window's items are known by their number and two sums of hashes, whatever their order
    wide = lambda *salt: F.sum(F.xxhash64("id", *salt).cast("decimal(20,0)"))
    known = windows.groupBy("key", "check").agg(F.xxhash64(F.count(F.lit(1)), wide()).alias("list"), F.xxhash64(F.count(F.lit(1)), wide(F.lit(1))).alias("list2"))
    known = materialise(known, "item-lists")
    hit = materialise(seen.join(apart(known), ["key", "check"]).select(*repeats.ROW, "at", "list", "list2"), "hits")
    chosen = known.groupBy("list", "list2").agg(F.min(F.struct("key", "check")).alias("w")).select("list", "list2", "w.*")
    members = windows.join(chosen, ["key", "check"]).select("list", "list2", "id")
    spans = hit.groupBy(*repeats.ROW).agg(F.sort_array(F.collect_set("at")).alias("starts"), F.sort_array(F.collect_set(F.struct("list", "list2"))).alias("lists"))
    spans = materialise(spans.withColumn("digest", F.sha2(F.to_json("lists"), 256)), "row-lists")
    sets = spans.select("digest", "lists").dropDuplicates(["digest"]).select("digest", F.explode("lists").alias("l")).select("digest", "l.*")
    named = sets.join(members, ["list", "list2"]).groupBy("digest").agg(F.collect_set("id").alias("items"))
    out = spans.join(apart(named), "digest")
    return out.select(*repeats.ROW, "starts", F.transform("starts", lambda x: x + span).alias("ends"), "items")


def _merge(starts: np.ndarray, ends: np.ndarray) -> tuple[list[int], list[int]]:
    """Maximal unions of overlapping or touching spans."""
    order = np.argsort(starts, kind="stable")
    s, e = starts[order], np.maximum.accumulate(ends[order])
    new = np.flatnonzero(np.concatenate([[True], s[1:] > e[:-1]]))
    return s[new].tolist(), e[np.append(new[1:], len(s)) - 1].tolist()


def _words_in(text: Column) -> Column:
    """Number of words of an item."""
    return F.size(F.regexp_extract_all(text, F.lit("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"), F.lit(0)))


def _blocks(items: DataFrame, block_bytes: int) -> Iterator[list[tuple[str, str]]]:
    """Test items in blocks that a driver and a task can hold; one at least."""
    size = items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    count = max(1, -(-int(size) // block_bytes))
    for b in range(count):
        part = items if count == 1 else items.filter(F.pmod(F.xxhash64("id", "text"), F.lit(count)) == b)
        yield [(r.id, r.text) for r in part.collect()]


def contamination(docs: DataFrame, items: DataFrame, span: int = SPAN, block_bytes: int = BLOCK_BYTES, pass_through: tuple[str, ...] = ()) -> DataFrame:
    """Benchmark passages in training texts.

    Returns one row for each row of ``docs``: doc_id, n_words, n_hit (words
    inside any occurrence of an item's window), n_items, items (sorted as
    strings), items_sha256 (of the comma-joined items), contaminated, and the
    maximal hit spans as word ranges (starts, ends). Columns named in
    ``pass_through`` come along unchanged.
    """
    ship(docs.sparkSession)
    rows = repeats.keyed(docs, *(c for c in pass_through if c != "text"))
    items = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("id"), F.col("text").cast("string").alias("text"))
    items = items.filter(F.col("text").isNotNull()).distinct()
    found = more = None
    if (items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0) > block_bytes:
        items = materialise(items.withColumn("short", _words_in(F.col("text")) < span), "items")
        more = _joined(rows, items.filter("NOT short"), span).select(*repeats.ROW, *_LISTS)
        items = items.filter("short").drop("short")
    for block in _blocks(items, block_bytes):
        if found is None:
            found = _find(rows, Index(block, span), pass_through)
        else:
            one = _find(rows, Index(block, span)).filter("size(items) > 0").select(*repeats.ROW, *_LISTS).dropDuplicates(repeats.ROW)
            more = one if more is None else more.unionByName(one)
    if more is not None:
        more = more.groupBy(*repeats.ROW).agg(*(F.flatten(F.collect_list(c)).alias(f"more_{c}") for c in _LISTS))
        found = found.join(more, repeats.ROW, "left")
        found = found.select(*repeats.ROW, "doc_id", "n_words", *(F.concat(c, F.coalesce(f"more_{c}", F.array().cast(found.schema[c].dataType))).alias(c) for c in _LISTS), *pass_through)

    def op(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [batch.column(c).to_pylist() for c in _LISTS]
            for r in [r for r, x in enumerate(lists[0]) if len(x) > 1]:
                lists[0][r], lists[1][r] = _merge(np.array(lists[0][r]), np.array(lists[1][r]))
                lists[2][r] = sorted(set(lists[2][r]))
            hit = [sum(e) - sum(s) for s, e in zip(lists[0], lists[1], strict=True)]
            digest = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in lists[2]]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_words"), pa.array(hit, pa.int64()), pa.array([len(x) for x in lists[2]], pa.int64()), pa.array(digest, pa.string()), pa.array([h > 0 for h in hit], pa.bool_()), pa.array(lists[2], pa.list_(pa.string())), pa.array(lists[0], pa.list_(pa.int32())), pa.array(lists[1], pa.list_(pa.int32())), *(batch.column(c) for c in (*repeats.ROW, *pass_through))],
                names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items", "starts", "ends", *repeats.ROW, *pass_through],
            )

    schema = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<string>, starts array<int>, ends array<int>, row_id long, row_key long"
    return found.mapInArrow(K.lean(op), StructType([*StructType.fromDDL(schema).fields, *(found.schema[c] for c in pass_through)]))
