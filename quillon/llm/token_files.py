"""Token-ID files: fixed-width bit packing with block offsets.

A file holds the ids of many documents, each in the fewest bits that hold the
vocabulary. Layout, little-endian, offsets from the start of the file:

    magic "QTOK" | version u16 | bits u16 | block ids u32 | documents u64 |
    ids u64 | offset of document table u64 | offset of block table u64
    packed ids, in blocks of ``block ids`` ids, each block from a byte border
    document table: doc_id i64 and first id u64 for each document
    block table: offset u64 for each block

The block table gives random access; a block is unpacked by numpy at once.

Writing: documents are dealt by ranges of doc_id and sorted in them, so file
n holds smaller ids than file n + 1; texts are encoded after the exchange, in
the task that writes the file. A file is moved to its name when whole, so
retried tasks leave the same file. Only the list of files (one row each)
comes to the driver, for the number of ids before each file. Reading goes by
ranges of documents of a file, many tasks to a large file.

Edge cases: null and empty texts are one end id; repeated rows stand side by
side; rows without id come first.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from quillon.llm import kernels as K, storage, tokenize

_HEADER = struct.Struct("<4sHHIQQQQ")
_MAGIC = b"QTOK"
BLOCK_IDS = 1 << 14
_NO_ID = -(1 << 63)
_MANIFEST = "path string, part int, documents long, ids long"


def bits_for(vocabulary: int) -> int:
    """Fewest bits that hold every id below ``vocabulary``."""
    return max(1, (vocabulary - 1).bit_length())


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    """Ids in ``bits`` bits each, least significant bit first."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    raw = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
    return np.packbits(raw[:, :bits].reshape(-1), bitorder="little").tobytes()


def unpack_bits(raw: bytes, bits: int, count: int) -> np.ndarray:
    """The first ``count`` ids that ``pack_bits`` has packed, as u4."""
    if bits in (8, 16, 32):
        return np.frombuffer(raw, f"<u{bits // 8}", count).astype("<u4")
    flat = np.unpackbits(np.frombuffer(raw, np.uint8), bitorder="little")[: bits * count].reshape(-1, bits)
    wide = np.zeros((count, 32), np.uint8)
    wide[:, :bits] = flat
    return np.packbits(wide.reshape(-1), bitorder="little").view("<u4")


class Writer:
    """Writes one file to a stream; holds one block and the tables."""

    def __init__(self, out, vocabulary: int, block_ids: int = BLOCK_IDS) -> None:
        self.out, self.bits, self.block = out, bits_for(vocabulary), block_ids
        self.docs: list[int] = []
        self.first: list[int] = []
        self.offsets: list[int] = []
        self.held: list[np.ndarray] = []
        self.waiting = self.ids = 0
        self.at = 0
        self._put(_HEADER.pack(_MAGIC, 1, self.bits, block_ids, 0, 0, 0, 0))

    def _put(self, raw: bytes) -> None:
        self.out.write(raw)
        self.at += len(raw)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append(_NO_ID if doc_id is None else doc_id)
        self.first.append(self.ids)
        self.ids += len(ids)
        self.held.append(ids)
        self.waiting += len(ids)
        if self.waiting >= self.block:
            self._flush(self.waiting // self.block * self.block)

    def _flush(self, count: int) -> None:
        flat = np.concatenate(self.held) if self.held else np.zeros(0, "<u4")
        for i in range(0, count, self.block):
            self.offsets.append(self.at)
            self._put(pack_bits(flat[i : min(i + self.block, count)], self.bits))
        self.held, self.waiting = [flat[count:]], len(flat) - count

    def close(self) -> None:
        """Write what is held, the tables and, at the end, the header again."""
        if self.waiting:
            self._flush(self.waiting)
        table = self.at
        self._put(np.array([self.docs, self.first], np.int64).T.astype("<i8").tobytes())
        blocks = self.at
        self._put(np.array(self.offsets, "<u8").tobytes())
        # streams only append: the footer repeats the header with its figures
        self._put(_HEADER.pack(_MAGIC, 1, self.bits, self.block, len(self.docs), self.ids, table, blocks))


class Reader:
    """Random access to one file."""

    def __init__(self, uri: str) -> None:
        fs, path = storage.filesystem(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        raw = self._read(size - _HEADER.size, _HEADER.size)
        magic, version, self.bits, self.block, self.documents, self.ids, self.table, self.blocks = _HEADER.unpack(raw)
        if magic != _MAGIC or version != 1:
            raise ValueError(f"{uri} is no token file")
        self.offsets = np.frombuffer(self._read(self.blocks, size - _HEADER.size - self.blocks), "<u8")

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def entries(self, a: int, b: int) -> np.ndarray:
        """doc_id and first id of documents a to b; the last row ends the last one."""
        n = min(b + 1, self.documents) - a
        rows = np.frombuffer(self._read(self.table + 16 * a, 16 * n), "<i8").reshape(-1, 2)
        return rows if b < self.documents else np.concatenate([rows, [[0, self.ids]]])

    def span(self, start: int, stop: int) -> np.ndarray:
        """Ids start to stop."""
        if stop <= start:
            return np.zeros(0, "<u4")
        b0, b1 = start // self.block, (stop - 1) // self.block
        end = int(self.offsets[b1 + 1]) if b1 + 1 < len(self.offsets) else self.table
        raw, base = self._read(int(self.offsets[b0]), end - int(self.offsets[b0])), int(self.offsets[b0])
        out = []
        for b in range(b0, b1 + 1):
            at = int(self.offsets[b]) - base
            count = min(self.block, self.ids - b * self.block)
            size = -(-count * self.bits // 8)
            out.append(unpack_bits(raw[at : at + size], self.bits, count))
        return np.concatenate(out)[start - b0 * self.block : stop - b0 * self.block]

    def close(self) -> None:
        self.file.close()


def write_token_files(docs: DataFrame, path: str, end_id: int, uri: str, block_ids: int = BLOCK_IDS) -> list[dict]:
    """Encode whole texts and write them below ``uri`` in ascending doc_id order.

    Returns the manifest, one entry for each file in order: path, part,
    documents, ids and start (ids in all files before it).
    """
    spark = docs.sparkSession
    storage.ship(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = rows.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    rows = rows.withColumn("part", F.spark_partition_id())

    def op(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        while first is not None and not first.num_rows:
            first = next(batches, None)
        if first is None:
            return
        encoder, part = tokenize.encoder(path), first.column("part")[0].as_py()
        end, made = np.array([end_id], "<u4"), {}

        def fill(out) -> None:
            w = Writer(out, max(encoder.vocabulary, end_id + 1), block_ids)
            batch = first
            while batch is not None:
                ids = batch.column("doc_id").to_pylist()
                for a in range(0, batch.num_rows, 512):
                    for doc_id, found in zip(ids[a : a + 512], encoder.arrays(batch.column("text").slice(a, 512)), strict=True):
                        w.add(doc_id, np.concatenate([found, end]))
                batch = next(batches, None)
            w.close()
            made.update(documents=len(w.docs), ids=w.ids)

        target = f"{uri}/part-{part:06d}.qtok"
        storage.publish(target, fill)
        yield pa.RecordBatch.from_pylist([{"path": target, "part": part} | made], schema=pa.schema([("path", pa.string()), ("part", pa.int32()), ("documents", pa.int64()), ("ids", pa.int64())]))

    manifest, start = [], 0
    for r in sorted(rows.mapInArrow(K.lean(op), _MANIFEST).collect(), key=lambda r: r["part"]):
        manifest.append(r.asDict() | {"start": start})
        start += r["ids"]
    return manifest


def read_token_files(spark: SparkSession, manifest: list[dict], split_documents: int = 4096) -> DataFrame:
    """One row for each document: doc_id, start, n_tokens, ids_crc32 and ids (packed u4)."""
    files = spark.createDataFrame(
        [(f["path"], f["documents"], f["start"]) for f in manifest if f["documents"]], "path string, documents long, base long"
    )
    plan = files.select("path", "base", "documents", F.explode(F.expr(f"sequence(0L, documents - 1, {split_documents}L)")).alias("a"))
    plan = plan.select("path", "a", F.least(F.col("a") + split_documents, "documents").alias("b"), "base")
    plan = plan.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))

    def op(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in batch.to_pylist():
                reader = Reader(s["path"])
                for a in range(s["a"], s["b"], 512):
                    b = min(a + 512, s["b"])
                    table = reader.entries(a, b)
                    firsts = table[:, 1].tolist()
                    flat = reader.span(firsts[0], firsts[-1])
                    packed = [flat[x - firsts[0] : y - firsts[0]].tobytes() for x, y in zip(firsts[:-1], firsts[1:], strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([None if d == _NO_ID else d for d in table[:-1, 0].tolist()], pa.int64()),
                            pa.array([s["base"] + f for f in firsts[:-1]], pa.int64()),
                            pa.array(np.diff(table[:, 1]), pa.int64()),
                            pa.array([zlib.crc32(p) for p in packed], pa.int64()),
                            pa.array(packed, pa.binary()),
                        ],
                        names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"],
                    )
                reader.close()

    return plan.mapInArrow(K.lean(op), "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")
