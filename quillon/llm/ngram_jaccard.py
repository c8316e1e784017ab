"""N-gram Jaccard self-join with Bayesian candidate pruning.

Documents are sets of word shingles. Words are runs of letters, digits and
non-ASCII characters of the lower-cased text (sharp s as ss), so copies that
only move sentence borders stay equal; a text of other characters only has
its white-space words. Documents with equal sets collapse to one
representative. Candidates share a band of MinHash values. MinHash values are
compared incrementally (one bit of each, as b-bit MinHash has it, a block of
bits at a time), and a pair is dropped as soon as the posterior probability
that its similarity reaches the threshold falls below a tolerance. Pairs that
stay tie representatives into candidate groups. Within a group the pairs that
the pruning leaves, and only they, are verified exactly on whole shingle sets,
so links are never estimated.

Scale: no pair is ever a row. A bucket or group yields at most one row for
each member (a spanning forest, or a count of links). Buckets and groups of
more than ``block`` members or ``BLOCK_BYTES`` of text are dealt out as pairs
of blocks to different tasks, each pair of members being judged in one of
them; nothing is capped. Signatures are made once; only representatives that
have a candidate are joined to their text. Joins on what a hot class shares
have exchanges of their own, which adaptive execution can split.

What can be missed: a pair of similarity s shares no band with probability
(1 - s**4)**32, 5e-8 at 0.8, and is pruned wrongly with about the tolerance.

Edge cases: a text of fewer than five words, but not none, is one shingle;
null, empty and blank texts are no one's duplicate; repeated rows and rows
with equal sets are of one class. Columns other than doc_id and text are
ignored; a class whose rows all lack an id has none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from quillon.llm import kernels as K, repeats
from quillon.llm.components import apart, components
from quillon.llm.storage import materialise, ship

THRESHOLD = 0.8
SHINGLE = 5
BANDS, ROWS = 32, 4
TOLERANCE = 1e-6
BLOCK = 1024
BLOCK_BYTES = 16 << 20  # of text on each side of a pair of blocks
_STEP = 32  # bits compared at a time
_COLUMNS = 1 << 15  # shingles in a bit row
_CHUNK = 1 << 16


def normal_text(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buffer of the lower-cased texts."""
    return K.text_buffer(pc.replace_substring(pc.utf8_lower(column), "ß", "ss"))


def _other_words(data: np.ndarray, offs: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, with the white-space words of documents that have no others."""
    s, e, f = K.word_spans(data, offs, K.NON_SPACE)
    bare = np.flatnonzero((first[1:] == first[:-1]) & (f[1:] > f[:-1]))
    if not len(bare):
        return starts, ends, first
    take = np.isin(K.row_of(f, np.arange(len(s))), bare)
    starts, ends = np.concatenate([starts, s[take]]), np.concatenate([ends, e[take]])
    order = np.argsort(starts, kind="stable")
    return starts[order], ends[order], np.searchsorted(starts[order], offs)


def shingle_sets(data: np.ndarray, offs: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of the distinct shingles of each document, in order."""
    starts, ends, first = K.word_spans(data, offs, K.ALNUM)
    if (first[1:] == first[:-1]).any():
        starts, ends, first = _other_words(data, offs, starts, ends, first)
    prefix = K.word_prefix(K.span_hash(K.byte_prefix(data), starts, ends))
    at = K.window_starts(first, size)
    rows, grams = K.row_of(first, at), K.span_hash(prefix, at, at + size, K.WORDS)
    count = np.diff(first)
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        rows = np.concatenate([rows, short])
        grams = np.concatenate([grams, K.span_hash(prefix, first[:-1][short], first[1:][short], K.WORDS)])
    order = np.lexsort((grams, rows))
    rows, grams = rows[order], grams[order]
    new = np.ones(len(rows), dtype=bool)
    new[1:] = (rows[1:] != rows[:-1]) | (grams[1:] != grams[:-1])
    return rows[new], grams[new]


def _seeds(n: int) -> tuple[np.ndarray, np.ndarray]:
    mixed = K.mix(np.arange(1, 2 * n + 1, dtype=K.U64) * K.U64(0x9E3779B97F4A7C15))
    return (mixed[:n] >> K.U64(32)).astype(np.uint32) | np.uint32(1), (mixed[n:] >> K.U64(32)).astype(np.uint32)


def signatures(rows: np.ndarray, grams: np.ndarray, n: int = BANDS * ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Documents that have shingles, and their MinHash values (documents x n)."""
    begin = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]])) if len(rows) else np.zeros(0, np.int64)
    low = (grams >> K.U64(32)).astype(np.uint32)
    out = np.empty((len(begin), n), dtype=np.uint32)
    if len(begin):
        for i, (a, b) in enumerate(zip(*_seeds(n), strict=True)):
            h = low * a
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x2C1B3C6D)
            h += b
            out[:, i] = np.minimum.reduceat(h, begin)
    return rows[begin], out


def sketch_bits(values: np.ndarray) -> np.ndarray:
    """One well-mixed bit of each MinHash value, 64 to a word."""
    bits = (K.mix(values.astype(K.U64)) & K.U64(1)).astype(np.uint8)
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64)


def least_agreement(n: int, threshold: float, tolerance: float) -> int:
    """Fewest agreeing bits of ``n`` that leave the pair a candidate.

    Bits of similar sets agree with probability c = (1 + s) / 2. With a
    uniform prior on s the posterior of c after m of n agree is proportional
    to c**m (1 - c)**(n - m) on [1/2, 1].
    """
    c = np.linspace(0.5, 1, 20001)[1:-1]
    border = (1 + threshold) / 2
    for m in range(n + 1):
        logs = m * np.log(c) + (n - m) * np.log1p(-c)
        weight = np.exp(logs - logs.max())
        if weight[c >= border].sum() / weight.sum() >= tolerance:
            return m
    return n


class Pruner:
    """Incremental comparison of sketches, a block of bits at a time."""

    def __init__(self, bits: int, threshold: float, tolerance: float) -> None:
        self.steps = [(end, least_agreement(end, threshold, tolerance)) for end in range(_STEP, bits + 1, _STEP)]

    def keep(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which pairs of sketches (rows of u4 blocks) stay candidates."""
        alive = np.arange(len(a))
        agree = np.zeros(len(a), np.int64)
        for k, (_, least) in enumerate(self.steps):
            differ = np.bitwise_count(a[alive, k] ^ b[alive, k])
            agree[alive] += _STEP - differ.astype(np.int64)
            alive = alive[agree[alive] >= least]
        out = np.zeros(len(a), dtype=bool)
        out[alive] = True
        return out


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least member of the component of each of n nodes under edges (a, b)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while True:
            jump = new[new]
            if (jump == new).all():
                break
            new = jump
        if (new == label).all():
            return label
        label = new


def _pairs(begin: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs inside groups, about _CHUNK at a time (a large group by itself)."""
    small = np.flatnonzero((size > 1) & (size <= 64))
    for s in np.unique(size[small]).tolist():
        i, j = np.triu_indices(s, 1)
        rows = begin[small][size[small] == s]
        each = max(1, _CHUNK // len(i))
        for at in range(0, len(rows), each):
            r = rows[at : at + each, None]
            yield (r + i).ravel(), (r + j).ravel()
    for g in np.flatnonzero(size > 64).tolist():
        r = np.arange(begin[g], begin[g] + size[g])
        for at in range(len(r) - 1):
            yield np.full(len(r) - at - 1, r[at]), r[at + 1 :]


def candidate_edges(key: np.ndarray, node: np.ndarray, sketch: np.ndarray, pruner: Pruner) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the unpruned pairs of whole buckets (``key`` sorted)."""
    names, who = np.unique(node, return_inverse=True)
    begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.append(begin, len(key)))
    label = np.arange(len(names))
    for a, b in _pairs(begin, size):
        open_ = label[who[a]] != label[who[b]]  # already tied: no need to look
        a, b = a[open_], b[open_]
        ok = pruner.keep(sketch[a], sketch[b])
        if ok.any():
            label = forest(len(names), np.concatenate([np.arange(len(names)), who[a[ok]]]), np.concatenate([label, who[b[ok]]]))
    moved = np.flatnonzero(label != np.arange(len(names)))
    return names[moved], names[label[moved]]


def verified(rows: np.ndarray, grams: np.ndarray, n: int, side: np.ndarray, cross: bool, threshold: float, sketch: np.ndarray, pruner: Pruner) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i < j) of n sets whose Jaccard similarity reaches the threshold.

    ``side`` is the block of each set; with ``cross`` only pairs across two
    blocks are judged. Pairs that sizes and the pruning leave are counted
    exactly, on bit rows over the shingles that two share, ``_COLUMNS`` bits
    at a time, so memory does not grow with the length of the texts.
    """
    size = np.bincount(rows, minlength=n)
    by_size = np.argsort(size, kind="stable")
    own, part, marks = size[by_size], side[by_size], sketch[by_size]
    left: list[np.ndarray] = []
    for i in range(n):
        j = np.arange(i + 1, int(np.searchsorted(own, own[i] / threshold + 1e-9, "right")))
        if cross:
            j = j[part[j] != part[i]]
        if len(j):
            j = j[pruner.keep(np.broadcast_to(marks[i], (len(j), marks.shape[1])), marks[j])]
        left.append(j)
    if not any(map(len, left)):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    place = np.empty(n, np.int64)
    place[by_size] = np.arange(n)
    _, column, count = np.unique(grams, return_inverse=True, return_counts=True)
    shared = count[column] > 1
    number = np.cumsum(count > 1) - 1
    column, where = number[column[shared]], place[rows[shared]]
    order = np.argsort(column, kind="stable")
    column, where = column[order], where[order]
    both = [np.zeros(len(j), np.int64) for j in left]
    for c in range(0, int(column[-1]) + 1 if len(column) else 0, _COLUMNS):
        a, b = np.searchsorted(column, [c, c + _COLUMNS])
        bits = np.zeros((n, _COLUMNS // 8), dtype=np.uint8)
        np.bitwise_or.at(bits, (where[a:b], (column[a:b] - c) >> 3), (1 << ((column[a:b] - c) & 7)).astype(np.uint8))
        words = bits.view(np.uint64)
        for i, j in enumerate(left):
            for k in range(0, len(j), 256):
                both[i][k : k + 256] += np.bitwise_count(words[j[k : k + 256]] & words[i]).sum(axis=1, dtype=np.int64)
    a_out, b_out = [], []
    for i, j in enumerate(left):
        hit = j[both[i] * (1 + threshold) >= threshold * (own[i] + own[j]) - 1e-9]
        a_out.append(np.full(len(hit), by_size[i]))
        b_out.append(by_size[hit])
    a, b = np.concatenate(a_out), np.concatenate(b_out)
    return np.minimum(a, b), np.maximum(a, b)


def _blocks(rows: DataFrame, key: str, block: int, size: Column | None = None) -> DataFrame:
    """Deal out the members of large groups as pairs of blocks.

    Adds ``lo``, ``hi`` (the pair) and ``side`` (the member's block). A group
    of at most ``block`` members, and ``BLOCK_BYTES`` of ``size``, is the one
    pair (0, 0).
    """
    weight = F.lit(0) if size is None else F.sum(size)
    counted = rows.groupBy(key).agg(F.ceil(F.greatest(F.count(F.lit(1)) / F.lit(block), weight / F.lit(BLOCK_BYTES))).cast("int").alias("blocks"))
    out = rows.join(apart(counted.filter("blocks > 1")), key, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    out = out.withColumn("side", F.pmod(F.xxhash64("node", F.lit(7)), F.col("blocks")).cast("int"))
    out = out.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return out.withColumn("lo", F.least("side", "other")).withColumn("hi", F.greatest("side", "other")).drop("blocks", "other")


def _profile(docs: DataFrame) -> DataFrame:
    """Per row: key of its shingle set, sketch and band keys (null without words)."""

    def op(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        band = np.arange(BANDS, dtype=K.U64) * K.U64(0xA0761D6478BD642F)
        for batch in (b.slice(a, 1000) for b in batches for a in range(0, b.num_rows, 1000)):
            data, offs = normal_text(batch.column("text"))
            for i, j in K.slices(offs):
                rows, grams = shingle_sets(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                who, values = signatures(rows, grams)
                begin = np.searchsorted(rows, who)
                key = np.zeros((len(who), 2), np.uint64)
                if len(who):
                    key[:, 0] = np.add.reduceat(K.mix(grams ^ K.U64(0x5851F42D4C957F2D)), begin)
                    key[:, 1] = np.add.reduceat(K.mix(grams + K.U64(0x14057B7EF767814F)), begin)
                joined = np.zeros((len(who), BANDS), np.uint64)
                for r in range(ROWS):
                    joined = K.mix(joined + band + values[:, r::ROWS].astype(K.U64) * K.U64(0xE7037ED1A0B428DB))
                bits = sketch_bits(values)
                at = np.full(j - i, -1)
                at[who] = np.arange(len(who))
                take = pa.array(at, pa.int64(), mask=at < 0)
                column = lambda x: pa.array(x.view(np.int64)).take(take)  # noqa: B023, E731
                lists = pa.FixedSizeListArray.from_arrays(pa.array(joined.ravel().view(np.int64)), BANDS).cast(pa.list_(pa.int64())).take(take)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c).slice(i, j - i) for c in (*repeats.ROW, "doc_id")] + [column(np.ascontiguousarray(key[:, c])) for c in (0, 1)] + [column(np.ascontiguousarray(bits[:, c])) for c in range(bits.shape[1])] + [pa.array(np.diff(offs[i : j + 1])), lists],
                    names=[*repeats.ROW, "doc_id", "key", "check", "bits0", "bits1", "size", "bands"],
                )

    return docs.select(*repeats.ROW, "doc_id", "text").mapInArrow(K.lean(op), "row_id long, row_key long, doc_id long, key long, check long, bits0 long, bits1 long, size long, bands array<long>"
    )


def _candidates(sets: DataFrame, threshold: float, tolerance: float, block: int) -> DataFrame:
    """Edges (u, v) of a forest that ties the unpruned candidates."""
    pruner = Pruner(BANDS * ROWS, threshold, tolerance)
    rows = sets.select(F.explode("bands").alias("band"), "node", "bits0", "bits1")
    dealt = _blocks(rows, "band", block * 4).repartition("band", "lo", "hi").sortWithinPartitions("band", "lo", "hi", "node")

    def op(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in repeats.whole_groups(batches, ["band", "lo", "hi"], lambda b: b.num_rows / _CHUNK):
            band, lo, hi = (t[c].to_numpy() for c in ("band", "lo", "hi"))
            new = np.concatenate([[True], (band[1:] != band[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])])
            sketch = np.stack([t["bits0"].to_numpy(), t["bits1"].to_numpy()], axis=1).view(np.uint32)
            u, v = candidate_edges(np.cumsum(new), t["node"].to_numpy(), sketch, pruner)
            if len(u):
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    return dealt.select("band", "lo", "hi", "node", "bits0", "bits1").mapInArrow(K.lean(op), "u long, v long").distinct()


def _links(docs: DataFrame, sets: DataFrame, groups: DataFrame, threshold: float, tolerance: float, block: int) -> DataFrame:
    """Per member and task: node, group, root of its verified links, linked rows, whole."""
    members = groups.select("node", F.col("root").alias("group")).join(sets.select("node", "rep.*", "copies", "bits0", "bits1", "size"), "node")
    dealt = _blocks(members, "group", block, F.col("size")).drop("size")
    pruner = Pruner(BANDS * ROWS, threshold, tolerance)
    texts = docs.select(*repeats.ROW, "text").join(dealt, repeats.ROW)
    keys = ["group", "lo", "hi"]
    texts = texts.repartition(*keys).sortWithinPartitions(*keys, "node").select(*keys, "side", "node", "copies", "bits0", "bits1", "text")

    def op(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in repeats.whole_groups(batches, keys, lambda b: b.get_total_buffer_size() / (4 << 20)):
            group, lo, hi, node = (t[c].to_numpy() for c in (*keys, "node"))
            new = np.concatenate([[True], (group[1:] != group[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1]) | (node[1:] != node[:-1])])
            if not new.all():  # repeated rows of one representative
                t = t.filter(pa.array(new)).combine_chunks()
                group, lo, hi, node = (t[c].to_numpy() for c in (*keys, "node"))
            border = np.flatnonzero(np.concatenate([[True], (group[1:] != group[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])]))
            data, offs = normal_text(t["text"].combine_chunks())
            sets = [(i, shingle_sets(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])) for i, j in K.slices(offs)]
            rows, grams = np.concatenate([i + r for i, (r, _) in sets]), np.concatenate([g for _, (_, g) in sets])
            edge = np.searchsorted(rows, np.append(border, len(node)))
            copies, side = t["copies"].to_numpy(), t["side"].to_numpy()
            sketch = np.stack([t["bits0"].to_numpy(), t["bits1"].to_numpy()], axis=1).view(np.uint32)
            linked, root = np.zeros(len(node), np.int64), np.arange(len(node))
            for g, (x, y) in enumerate(zip(border, np.append(border[1:], len(node)), strict=True)):
                own = slice(edge[g], edge[g + 1])
                a, b = verified(rows[own] - x, grams[own], int(y - x), side[x:y], bool(lo[x] != hi[x]), threshold, sketch[x:y], pruner)
                np.add.at(linked, a + x, copies[b + x])
                np.add.at(linked, b + x, copies[a + x])
                root[x:y] = forest(int(y - x), a, b) + x
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (node, node[root], linked)], names=["node", "root", "linked"])

    return texts.mapInArrow(K.lean(op), "node long, root long, linked long")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE, block: int = BLOCK) -> DataFrame:
    """Classes of documents linked by a Jaccard similarity of ``threshold``.

    Returns one row for each row of ``docs``: doc_id, class_id (the smallest
    doc_id of its class), n_links (other rows of at least that similarity,
    copies counted) and the row (``repeats.ROW``).
    """
    ship(docs.sparkSession)
    rows = repeats.keyed(docs)
    profile = materialise(_profile(rows), "profile")
    members = profile.drop("bits0", "bits1", "size", "bands")
    seen = profile.filter("key IS NOT NULL").groupBy("key", "check")
    sets = seen.agg(
        F.count(F.lit(1)).alias("copies"), F.min(F.struct(*repeats.ROW)).alias("rep"), F.first("bits0").alias("bits0"), F.first("bits1").alias("bits1"), F.max("size").alias("size"), F.first("bands").alias("bands")
    )
    sets = materialise(sets.withColumn("node", F.monotonically_increasing_id()), "sets")  # written once, so no two sets share a number
    groups = components(_candidates(sets, threshold, tolerance, block))
    found = materialise(_links(rows, sets, groups, threshold, tolerance, block), "links")
    classes = components(found.filter("node <> root").select(F.col("node").alias("u"), F.col("root").alias("v")))
    linked = found.groupBy("node").agg(F.sum("linked").alias("linked"))
    known = sets.select("key", "check", "node", "copies").join(apart(linked), "node", "left").join(classes, "node", "left")
    known = known.select("key", "check", F.coalesce("root", "node").alias("root"), (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    known = materialise(members.join(known, ["key", "check"], "left"), "classes")
    first = known.filter("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("class_id"))
    out = known.join(apart(first), "root", "left")
    return out.select("doc_id", F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), *repeats.ROW)
