"""WARC records in ZIP archives: writing, and reading by range.

An archive is a ZIP file with stored (uncompressed) members, as web archive
collections have them: ``archive/data.warc.gz``, whose records are gzip
members of their own, and ``indexes/index.cdxj``, a line for each record with
its offset and length in the first. The reader parses the end of central
directory, its ZIP64 form and the central directory, finds where the bytes of
the stored members begin, reads the index and then ranges of records; nothing
is extracted.

Scale: of equal payloads one record is a response, the others are revisits
without the payload. Which one comes from digests and ids alone: an
aggregation over digests, combined before the exchange, and a join back that
adaptive execution can split where one payload is hot. Pages themselves are
dealt out by their own key, so a very common page is no single task's.
Archives are written task by task (several, if a
task has more than ``roll_bytes``) and moved to their names when whole.
Reading deals out ranges of about ``split_bytes``.

Edge cases: a null html is an empty payload; a null url has a URN in its
place; a null page_id is written and read as null and is a response only if
no equal payload has an id; rows that share the smallest page_id are all
responses. Columns other than page_id, url and html are ignored.
"""

from __future__ import annotations

import hashlib
import json
import struct
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from quillon.llm import kernels as K, storage
from quillon.llm.components import apart

DATA = "archive/data.warc.gz"
INDEX = "indexes/index.cdxj"
LEAST_REVISIT = 100
_URN = "urn:page:"
_DATE = "1970-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_FULL16, _FULL32 = 0xFFFF, 0xFFFFFFFF


@dataclass(frozen=True)
class Member:
    """A member of a ZIP archive, as its central directory has it."""

    name: str
    method: int
    flags: int
    packed: int
    size: int
    header: int
    crc32: int


class ZipDirectory:
    """The central directory of an archive of which only ranges are read."""

    def __init__(self, file) -> None:
        self.file, self.length = file, file.size()
        self.members = {m.name: m for m in self._entries()}

    def read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        raw = self.file.read(n)
        if len(raw) != n:
            raise ValueError("the archive ends too soon")
        return raw

    def _end(self) -> tuple[int, int, int]:
        """Number of entries, size and place of the central directory."""
        tail_at = max(0, self.length - 22 - _FULL16)
        tail = self.read(tail_at, self.length - tail_at)
        at = len(tail) - 22
        while at >= 0:
            at = tail.rfind(b"PK\x05\x06", 0, at + 4)
            if at < 0:
                break
            comment = struct.unpack_from("<H", tail, at + 20)[0]
            if at + 22 + comment == len(tail):
                break
            at -= 1
        if at < 0:
            raise ValueError("no end of central directory")
        entries, size, offset = struct.unpack_from("<HII", tail, at + 10)
        end = tail_at + at
        if (entries == _FULL16 or size == _FULL32 or offset == _FULL32) and end >= 20:
            locator = self.read(end - 20, 20)
            if locator[:4] == b"PK\x06\x07":
                where = struct.unpack_from("<Q", locator, 8)[0]
                record = self.read(where, 56)
                if record[:4] != b"PK\x06\x06":
                    raise ValueError("no ZIP64 end of central directory")
                entries, size, offset = struct.unpack_from("<QQQ", record, 32)
                return entries, size, offset
        return entries, size, end - size  # whatever stands before the archive

    def _entries(self) -> Iterator[Member]:
        entries, size, offset = self._end()
        raw, at = self.read(offset, size), 0
        for _ in range(entries):
            if raw[at : at + 4] != b"PK\x01\x02":
                raise ValueError("the central directory is damaged")
            flags, method = struct.unpack_from("<HH", raw, at + 8)
            crc, packed, full, names, extras, comments = struct.unpack_from("<IIIHHH", raw, at + 16)
            header = struct.unpack_from("<I", raw, at + 42)[0]
            name = raw[at + 46 : at + 46 + names].decode("utf-8" if flags & 0x800 else "cp437")
            extra = raw[at + 46 + names : at + 46 + names + extras]
            wide = [full == _FULL32, packed == _FULL32, header == _FULL32]
            while any(wide) and len(extra) >= 4:
                kind, n = struct.unpack_from("<HH", extra)
                if kind == 1:
                    values = list(struct.unpack_from(f"<{sum(wide)}Q", extra, 4))
                    full, packed, header = (values.pop(0) if w else v for w, v in zip(wide, (full, packed, header), strict=True))
                    break
                extra = extra[4 + n :]
            yield Member(name, method, flags, packed, full, header, crc)
            at += 46 + names + extras + comments

    def stored(self, name: str) -> tuple[int, int]:
        """Where the bytes of a stored member begin, and how many there are."""
        m = self.members[name]
        if m.method or m.flags & 1:
            raise ValueError(f"{name} is not stored plainly")
        local = self.read(m.header, 30)
        if local[:4] != b"PK\x03\x04":
            raise ValueError(f"{name} has no local header")
        names, extras = struct.unpack_from("<HH", local, 26)
        return m.header + 30 + names + extras, m.size


def _record(page_id, url, payload: bytes, digest: str, refers_to, revisit: bool) -> bytes:
    """One WARC record; the target's line breaks can't end its header line."""
    name = "" if page_id is None else page_id
    target = (url if url is not None else f"{_URN}{name}").replace("\r", "%0D").replace("\n", "%0A")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <{_URN}{name}>",
        f"WARC-Target-URI: {target}",
        f"WARC-Date: {_DATE}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
    ]
    if revisit:
        lines += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <{_URN}{refers_to}>"]
    block = http if revisit else http + payload
    return "\r\n".join([*lines, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """Type, ids, target, and the payload's size and digest of a record."""
    head, _, block = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogateescape").split("\r\n")
    if not lines[0].startswith("WARC/1."):
        raise ValueError("no WARC record")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    block = block[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    kind = fields["warc-type"]
    claimed = fields["warc-payload-digest"].removeprefix("sha256:")
    out = {"type": kind, "page_id": fields["warc-record-id"].strip("<>").removeprefix(_URN), "url": fields["warc-target-uri"], "refers_to": None}
    if kind == "revisit":
        sizes = [int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
        return out | {"refers_to": fields["warc-refers-to"].strip("<>").removeprefix(_URN), "bytes": sizes[0], "digest": claimed, "payload": None}
    digest = hashlib.sha256(payload).hexdigest()
    if digest != claimed:
        raise ValueError("the payload does not match its digest")
    return out | {"bytes": len(payload), "digest": digest, "payload": payload}


def write_archives(pages: DataFrame, uri: str, least: int = LEAST_REVISIT, roll_bytes: int = 1 << 30) -> DataFrame:
    """Write a record for each page below ``uri``; a row for each archive: path, records."""
    storage.ship(pages.sparkSession)
    body = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), body.alias("html"))
    # pages of different ids never meet, however many there are
    rows = rows.withColumn("row_id", F.coalesce("page_id", F.xxhash64("html"))).withColumn("row_key", F.xxhash64("page_id", "url", "html"))
    rows = rows.withColumn("digest", F.sha2("html", 256))
    narrow = rows.filter(F.octet_length("html") >= least).select("row_id", "row_key", "page_id", F.unhex("digest").alias("d"))
    narrow = storage.materialise(narrow, "digests")
    first = narrow.groupBy("d").agg(F.count(F.lit(1)).alias("n"), F.min("page_id").alias("first")).filter("n > 1").drop("n")
    marks = narrow.join(apart(first), "d").groupBy("row_id", "row_key").agg(F.min("first").alias("first"))
    parts = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    told = rows.repartition(parts, "row_id", "row_key").join(marks, ["row_id", "row_key"], "left").select("page_id", "url", "html", "digest", "first")

    def op(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        records = ((r, b) for b in batches for r in range(b.num_rows))
        number = 0
        held = next(records, None)
        while held is not None:
            count = 0

            def fill(out) -> None:
                nonlocal held, count
                index, at = [], 0
                with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
                    with z.open(DATA, "w", force_zip64=True) as data:
                        while held is not None and at < roll_bytes:
                            r, b = held
                            page_id, url, html, digest, lead = (b.column(i)[r].as_py() for i in range(5))
                            revisit = lead is not None and page_id != lead
                            packer = zlib.compressobj(1, zlib.DEFLATED, 31)
                            raw = packer.compress(_record(page_id, url, html.encode("utf-8", "surrogatepass"), digest, lead, revisit)) + packer.flush()
                            data.write(raw)
                            index.append(json.dumps({"offset": at, "length": len(raw), "page_id": page_id, "digest": digest, "type": "revisit" if revisit else "response"}))
                            at += len(raw)
                            count += 1
                            held = next(records, None)
                    z.writestr(INDEX, "".join(f"{_URN} {_DATE} {x}\n" for x in index))

            path = f"{uri}/part-{part:06d}-{number:04d}.wacz"
            storage.publish(path, fill)
            number += 1
            yield pa.RecordBatch.from_pydict({"path": [path], "records": pa.array([count], pa.int64())})

    return storage.materialise(told.mapInArrow(K.lean(op), "path string, records long"), "archives")


_ROWS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def read_archives(archives: DataFrame, split_bytes: int = 8 << 20, keep_payload: bool = False) -> DataFrame:
    """Records of archives (column ``path``), read by range: ``_ROWS``."""
    spark: SparkSession = archives.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                fs, where = storage.filesystem(path)
                with fs.open_input_file(where) as f:
                    zip_ = ZipDirectory(f)
                    at, n = zip_.stored(INDEX)
                    lines = zip_.read(at, n).decode().splitlines()
                    base, _ = zip_.stored(DATA)
                out: list[dict] = []
                for line in lines:
                    e = json.loads(line.split(" ", 2)[2])
                    if not out or out[-1]["length"] >= split_bytes or out[-1]["start"] + out[-1]["length"] != base + e["offset"]:
                        out.append({"path": path, "start": base + e["offset"], "length": 0, "sizes": []})
                    out[-1]["length"] += e["length"]
                    out[-1]["sizes"].append(e["length"])
                schema = pa.schema([("path", pa.string()), ("start", pa.int64()), ("length", pa.int64()), ("sizes", pa.list_(pa.int32()))])
                yield pa.RecordBatch.from_pylist(out, schema=schema)

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in batch.to_pylist():
                fs, where = storage.filesystem(s["path"])
                with fs.open_input_file(where) as f:
                    f.seek(s["start"])
                    raw = memoryview(f.read(s["length"]))
                rows, at = [], 0
                for n in s["sizes"]:
                    rows.append(parse_record(zlib.decompress(raw[at : at + n], 31)))
                    if not keep_payload:
                        rows[-1]["payload"] = None
                    at += n
                number = lambda k: pa.array([int(r[k]) if r[k] not in (None, "") else None for r in rows], pa.int64())  # noqa: B023, E731
                text = lambda k: pa.array([r[k] for r in rows], pa.string())  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays(
                    [number("page_id"), text("url"), number("bytes"), text("digest"), text("type"), number("refers_to"), pa.array([r["payload"] for r in rows], pa.binary())],
                    names=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"],
                )

    splits = archives.select("path").repartition(parts).mapInArrow(K.lean(locate), "path string, start long, length long, sizes array<int>")
    return splits.repartition(parts).mapInArrow(K.lean(fetch), _ROWS)
