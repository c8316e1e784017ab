"""Substring dedup: seed and extend over winnowed anchors.

Every window of the threshold length selects a winnowed anchor (a k-gram of
words); documents that share a passage share its anchor. Seeds: contexts of
one anchor are joined with the earliest context that shares a window with
them. Extension: from the anchor, both ways, word by word, to the first words
that differ. What is at least the threshold long is a maximal repeat, and
the words that it covers go from the later document. A word so goes exactly
if a window that covers it also starts in a document of smaller id.

Scale: one row for each anchor and document leaves the scan (about a
twentieth of the words). Equal contexts collapse in a partial aggregation, so
a passage in a third of all documents is extended once; only the words of
differing contexts of one anchor are cut out (some 84 at most). A context is
joined with the earliest context of each of its windows, at most 35, never
with all others, so pairs grow with the contexts. Contexts of an anchor meet
in one task up to ``BUCKET`` of them; those of a hotter anchor are dealt out
by window, the earliest ones come from an aggregation that is combined before
the exchange, and seeds are joined with words by (anchor, context), which
adaptive execution can split. Both ways join and extend the same seeds.

Words are compared as 64-bit hashes; equal contexts rest on the hashes of
their anchor and content together.

Edge cases: null and empty texts have no words; documents shorter than the
threshold lose nothing; repeated rows (equal id and text) get equal results;
a row without id keeps all its words and counts as no one's predecessor.
Columns other than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from quillon.llm import kernels as K, repeats
from quillon.llm.storage import materialise, ship

THRESHOLD = 50
_K = 16
_CHUNK = 1 << 17
BUCKET = 10_000  # contexts of an anchor, at most some 7 MB of words

_RESULT = "n_words long, n_removed long, kept_sha256 string, kept_text string"


def repeat_spans(docs: DataFrame, dealt: DataFrame, threshold: int = THRESHOLD, k: int = _K, bucket: int = BUCKET) -> DataFrame:
    """Word spans to remove: the row (``repeats.ROW``) and ``marks``, an array of (start, n, mask).

    ``start`` is the first window of a run and ``n`` its number of windows;
    ``mask`` has a byte for each of them (null: all match). ``docs`` is what
    ``repeats.keyed`` gives, ``dealt`` the same rows partitioned by ``ROW``.
    """
    w = threshold - k + 1
    named = docs.filter(F.col("doc_id").isNotNull())
    found = repeats.runs_of(named, k, w, words=True)
    contexts = materialise(
        found.groupBy("anchor", "run").agg(
            F.min(F.struct("row_id", "row_key", "start")).alias("rep"), F.max("row_id").alias("last"), F.max("n").alias("n")
        ),
        "contexts",
    )
    differing = contexts.groupBy("anchor").agg(
        F.min("run").alias("r0"), F.max("run").alias("r1"), F.min("rep.row_id").alias("d0"), F.max("rep.row_id").alias("d1"), F.count(F.lit(1)).alias("contexts")
    )
    differing = materialise(differing.filter("r0 < r1 AND d0 < d1").select("anchor", (F.col("contexts") > bucket).alias("hot")), "differing")
    unclear = contexts.join(differing, "anchor").select("anchor", "run", "rep.row_id", "rep.row_key", "rep.start", "n", "hot")
    partly = _near_seeds(_cut(dealt, unclear.filter("NOT hot"), threshold), threshold)
    if not differing.filter("hot").isEmpty():
        partly = partly.unionByName(_far_seeds(materialise(_cut(dealt, unclear.filter("hot"), threshold), "hot-contexts"), threshold))
    repeated = contexts.filter(F.col("last") > F.col("rep.row_id")).select("anchor", "run", F.col("rep.row_id").alias("first"))
    verdict = repeated.join(partly, ["anchor", "run"], "full")
    hit = found.join(verdict, ["anchor", "run"])
    later = F.col("row_id") > F.col("first")
    marks = hit.withColumn("ats", F.when(F.coalesce(later, F.lit(False)), None).otherwise(F.coalesce("ats", F.array().cast("array<int>"))))
    marks = marks.filter("ats IS NULL OR size(ats) > 0")
    return repeats.by_document(marks, "start", "n", "ats")


def _cut(dealt: DataFrame, unclear: DataFrame, threshold: int) -> DataFrame:
    """Word hashes of each unclear context, cut from its representative document.

    Takes all columns of ``dealt``, so that the exchange of texts is that of
    the last step and is made once.
    """
    by_doc = unclear.groupBy(*repeats.ROW).agg(F.collect_list(F.struct("anchor", "run", "start", "n")).alias("marks"))
    both = dealt.join(by_doc, repeats.ROW)

    def op(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = K.text_buffer(batch.column("text"))
            moffs, marks = repeats.list_rows(batch.column("marks"))
            start, n = (marks[c].to_numpy().astype(np.int64) for c in ("start", "n"))
            ids = batch.column("row_id").to_numpy()
            for i, j in K.slices(offs):
                a, b = moffs[i], moffs[j]
                if a == b:
                    continue
                own = data[offs[i] : offs[j]]
                starts, ends, first = K.word_spans(own, offs[i : j + 1] - offs[i], K.NON_SPACE)
                hashes = K.span_hash(K.byte_prefix(own), starts, ends)
                row = np.searchsorted(moffs, np.arange(a, b), "right") - 1 - i
                count = n[a:b] + threshold - 1
                edge = np.concatenate([[0], np.cumsum(count)])
                at = np.arange(edge[-1]) - np.repeat(edge[:-1], count) + np.repeat(first[row] + start[a:b], count)
                lists = pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), pa.array(hashes[at].view(np.int64)))
                part = slice(a, b)
                yield pa.RecordBatch.from_arrays([marks["anchor"][part], marks["run"][part], pa.array(ids[i + row]), lists], names=["anchor", "run", "first", "words"])

    return both.mapInArrow(K.lean(op), "anchor long, run long, first long, words array<long>")


def _words_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and flat values of a list column."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy())]).astype(np.int64), column.flatten().to_numpy().view(np.uint64)


def _windows(cut: DataFrame, threshold: int) -> DataFrame:
    """Hash of each window of each context: anchor, run, first, at, win."""

    def op(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(a, 2000) for b in batches for a in range(0, b.num_rows, 2000)):
            offs, words = _words_of(batch.column("words"))
            pos = K.window_starts(offs, threshold)
            of = K.row_of(offs, pos)
            win = K.span_hash(K.word_prefix(words), pos, pos + threshold, K.WORDS)
            take = pa.array(of)
            yield pa.RecordBatch.from_arrays(
                [batch.column(c).take(take) for c in ("anchor", "run", "first")] + [pa.array((pos - offs[of]).astype(np.int32)), pa.array(win.view(np.int64))], names=["anchor", "run", "first", "at", "win"]
            )

    return cut.mapInArrow(K.lean(op), "anchor long, run long, first long, at int, win long")


def _equal_run(x: np.ndarray, y: np.ndarray, p: np.ndarray, q: np.ndarray, most: np.ndarray, step: int) -> np.ndarray:
    """Number of words that agree from x[p] and y[q] on, in one direction."""
    out = np.zeros(len(p), np.int64)
    live = np.flatnonzero(most > 0)
    while len(live):
        same = x[p[live] + step * out[live]] == y[q[live] + step * out[live]]
        live = live[same]
        out[live] += 1
        live = live[out[live] < most[live]]
    return out


def _extend(pairs: DataFrame, threshold: int) -> DataFrame:
    """Maximal repeat around each seed: its first and last window (a, b) in the context.

    A seed is a window at ``at`` that starts at ``other_at`` in the earlier
    context; it is extended from its first word to the left and the right.
    """

    def op(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(a, 2000) for b in batches for a in range(0, b.num_rows, 2000)):
            xo, x = _words_of(batch.column("words"))
            yo, y = _words_of(batch.column("other_words"))
            at, other = batch.column("at").to_numpy().astype(np.int64), batch.column("other_at").to_numpy().astype(np.int64)
            p, q = xo[:-1] + at, yo[:-1] + other
            right = _equal_run(x, y, p, q, np.minimum(xo[1:] - p, yo[1:] - q), 1)
            left = _equal_run(x, y, p - 1, q - 1, np.minimum(at, other), -1)
            keep = left + right >= threshold
            take = pa.array(np.flatnonzero(keep))
            a, b = (at - left)[keep], (at + right - threshold)[keep]
            yield pa.RecordBatch.from_arrays([batch.column("anchor").take(take), batch.column("run").take(take), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32))], names=["anchor", "run", "a", "b"])

    return pairs.mapInArrow(K.lean(op), "anchor long, run long, a int, b int")


def _near_seeds(cut: DataFrame, threshold: int) -> DataFrame:
    """anchor, run, ats: windows of each context inside a maximal repeat with an earlier one, whole anchors in a task."""
    dealt = cut.repartition("anchor").sortWithinPartitions("anchor", "first").select("anchor", "run", "first", "words")

    def op(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in repeats.whole_groups(batches, ["anchor"], lambda b: len(b.column("words").flatten()) / _CHUNK):
            anchor, first = t["anchor"].to_numpy(), t["first"].to_numpy()
            offs, words = _words_of(t["words"])
            pos = K.window_starts(offs, threshold)
            of = K.row_of(offs, pos)
            win = K.span_hash(K.word_prefix(words), pos, pos + threshold, K.WORDS)
            group = np.cumsum(np.concatenate([[0], anchor[1:] != anchor[:-1]]))
            order = np.lexsort((first[of], win, group[of]))
            g, w = group[of][order], win[order]
            new = np.concatenate([[True], (g[1:] != g[:-1]) | (w[1:] != w[:-1])])
            lead = order[np.flatnonzero(new)][np.cumsum(new) - 1]  # the earliest context's window
            seed = np.flatnonzero(first[of[order]] > first[of[lead]])
            mine, other = order[seed], lead[seed]
            _, once = np.unique(of[mine] * len(anchor) + of[other], return_index=True)
            mine, other = mine[once], other[once]
            p, q = pos[mine], pos[other]
            x, y = of[mine], of[other]
            right = _equal_run(words, words, p, q, np.minimum(offs[x + 1] - p, offs[y + 1] - q), 1)
            left = _equal_run(words, words, p - 1, q - 1, np.minimum(p - offs[x], q - offs[y]), -1)
            keep = left + right >= threshold
            number = np.searchsorted(pos, p[keep])  # windows are numbered through all contexts
            inside = K.covered(len(pos), number - left[keep], number + right[keep] - threshold + 1)
            counts = np.bincount(of[inside], minlength=len(anchor))
            some = np.flatnonzero(counts)
            lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(counts[some])]).astype(np.int32), pa.array((pos - offs[of])[inside].astype(np.int32)))
            take = pa.array(some)
            yield pa.RecordBatch.from_arrays([t["anchor"].combine_chunks().take(take), t["run"].combine_chunks().take(take), lists], names=["anchor", "run", "ats"])

    return dealt.mapInArrow(K.lean(op), "anchor long, run long, ats array<int>")


def _far_seeds(cut: DataFrame, threshold: int) -> DataFrame:
    """The same for anchors with very many contexts, by joins."""
    windows = _windows(cut, threshold)
    earliest = windows.groupBy("anchor", "win").agg(F.min(F.struct("first", F.col("run").alias("other"), F.col("at").alias("other_at"))).alias("lead"), F.max("first").alias("d1"))
    seeds = windows.join(earliest.filter("lead.first < d1").select("anchor", "win", "lead"), ["anchor", "win"]).filter(F.col("first") > F.col("lead.first"))
    seeds = seeds.groupBy("anchor", "run", "lead.other").agg(F.min(F.struct("at", "lead.other_at")).alias("seed"))
    words = cut.select("anchor", "run", "words")
    pairs = seeds.select("anchor", "run", "other", "seed.*").join(words, ["anchor", "run"])
    pairs = pairs.join(words.toDF("anchor", "other", "other_words"), ["anchor", "other"])
    found = _extend(pairs.select("anchor", "run", "at", "other_at", "words", "other_words"), threshold)
    return found.groupBy("anchor", "run").agg(F.array_distinct(F.flatten(F.collect_set(F.sequence("a", "b")))).alias("ats"))


def mask_of(count: int, moffs: np.ndarray, row: int, marks: dict, threshold: int) -> np.ndarray:
    """Mask of the ``count`` units of a document that its marks cover."""
    a, b = int(moffs[row]), int(moffs[row + 1])
    if a == b:
        return np.zeros(count, dtype=bool)
    start = marks["start"].to_numpy()[a:b].astype(np.int64)
    n = marks["n"].to_numpy()[a:b]
    ats = marks["ats"].slice(a, b - a)
    whole = ats.is_null().to_numpy(zero_copy_only=False)
    starts, ends = [start[whole]], [start[whole] + n[whole] + threshold - 1]
    sizes = ats.value_lengths().fill_null(0).to_numpy()
    single = np.repeat(start, sizes) + ats.flatten().to_numpy()
    starts.append(single)
    ends.append(single + threshold)
    return K.covered(count, np.concatenate(starts), np.concatenate(ends))


def substring_dedup(docs: DataFrame, threshold: int = THRESHOLD, k: int = _K, pass_through: tuple[str, ...] = (), bucket: int = BUCKET) -> DataFrame:
    """Remove repeated spans of at least ``threshold`` words.

    Returns one row for each row of ``docs``: doc_id, n_words, n_removed,
    kept_sha256 (of the kept words joined by one space) and kept_text (the
    text as it was if nothing goes; else what stands from each kept word to
    the next unit kept in place, so line breaks survive; null stays null).
    Columns named in ``pass_through`` come along unchanged.
    """
    ship(docs.sparkSession)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = repeats.keyed(docs, *pass_through).repartition(parts, *repeats.ROW)
    spans = repeat_spans(repeats.keyed(docs), rows, threshold, k, bucket)
    both = rows.join(spans, repeats.ROW, "left").select("doc_id", "text", "marks", *pass_through)
    also = [rows.schema[c] for c in pass_through]
    schema = StructType([*StructType.fromDDL(f"doc_id long, {_RESULT}").fields, *also])

    def op(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = K.text_buffer(batch.column("text"))
            texts, raw = batch.column("text"), data.tobytes()
            moffs, marks = repeats.list_rows(batch.column("marks"))
            starts, ends, first = K.word_spans(data, offs, K.NON_SPACE)
            words, removed, digest, kept = [], [], [], []
            for r in range(batch.num_rows):
                f, g = int(first[r]), int(first[r + 1])
                gone = mask_of(g - f, moffs, r, marks, threshold)
                stay = np.flatnonzero(~gone) + f
                words.append(g - f)
                removed.append(int(gone.sum()))
                s, e = starts[stay].tolist(), ends[stay].tolist()
                digest.append(hashlib.sha256(b" ".join([raw[x:y] for x, y in zip(s, e, strict=True)])).hexdigest())
                if not removed[-1]:
                    kept.append(texts[r].as_py())
                else:
                    kept.append(_kept(raw, starts, ends, ~gone, f, g).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(words, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest, pa.string()), pa.array(kept, pa.string())] + [batch.column(c) for c in pass_through],
                names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text", *pass_through],
            )

    return both.mapInArrow(K.lean(op), schema)


def _kept(raw: bytes, starts: np.ndarray, ends: np.ndarray, keep: np.ndarray, f: int, g: int) -> bytes:
    """Stretches of kept words with the white space between them, joined by a space."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], keep, [False]]).astype(np.int8)))
    return b" ".join(raw[starts[f + a] : ends[f + b - 1]] for a, b in edge.reshape(-1, 2).tolist())
