"""Vectorised text kernels on Arrow string buffers.

All functions work on the UTF-8 bytes of many documents at once: ``data`` is
the byte buffer and ``offs`` the ``n + 1`` document offsets into it. Words,
k-grams and windows never cross a document. Hashes are polynomials modulo
2**64 (prefix sums give the hash of any span in constant time), finished by a
bijective 64-bit mixer.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_BASE_BYTES = 0x9E3779B97F4A7C15 | 1
_BASE_WORDS = 0xC2B2AE3D27D4EB4F | 1

#: Words are maximal runs of bytes that are no ASCII white space.
NON_SPACE = np.ones(256, dtype=bool)
NON_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False

#: Letters, digits and every byte of a non-ASCII character.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = True
ALNUM[0x80:] = True

#: Byte map that lower-cases A-Z only.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.pow = self.inv = np.ones(1, dtype=U64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.pow) < n:
            size = max(n, 1 << 16)
            size = 1 << (size - 1).bit_length()
            for name, b in (("pow", self.base), ("inv", self.inverse)):
                out = np.full(size, b, dtype=U64)
                out[0] = 1
                np.multiply.accumulate(out, out=out)
                setattr(self, name, out)
        return self.pow, self.inv


BYTES, WORDS = _Powers(_BASE_BYTES), _Powers(_BASE_WORDS)


def trim() -> None:
    """Give freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def lean(op):
    """An Arrow operator whose worker holds little when its task is done.

    Workers outlive their stage, so what they keep stands beside the memory
    of the next stage's.
    """

    def run(batches):
        try:
            yield from op(batches)
        finally:
            trim()

    return run


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit words (the splitmix64 constants)."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        empty = b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else ""
        column = pc.fill_null(column, empty)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def slices(offs: np.ndarray, size: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Ranges of whole documents of about ``size`` bytes (one, if longer)."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = int(np.searchsorted(offs, offs[i] + size, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def word_spans(data: np.ndarray, offs: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of words, and each document's first word (n + 1)."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    inside = table[data]
    before = np.empty(n, dtype=bool)
    before[0], before[1:] = False, inside[:-1]
    before[offs[:-1][offs[:-1] < n]] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(n, dtype=bool)
    after[-1], after[:-1] = False, inside[1:]
    last = offs[1:] - 1
    after[last[last >= 0]] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offs)


def byte_prefix(data: np.ndarray) -> np.ndarray:
    """Prefix sums from which ``span_hash`` takes the hash of any byte span."""
    power, _ = BYTES.upto(len(data) + 1)
    out = np.zeros(len(data) + 1, dtype=U64)
    np.cumsum((data.astype(U64) + U64(1)) * power[: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray, powers: _Powers = BYTES) -> np.ndarray:
    """Hash of spans; equal content gives equal hashes wherever it stands."""
    _, inverse = powers.upto(len(prefix))
    raw = (prefix[ends] - prefix[starts]) * inverse[starts]
    return mix(raw + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))


def word_prefix(hashes: np.ndarray) -> np.ndarray:
    """Prefix sums over word hashes, for ``span_hash(..., WORDS)``."""
    power, _ = WORDS.upto(len(hashes) + 1)
    out = np.zeros(len(hashes) + 1, dtype=U64)
    np.cumsum(hashes * power[: len(hashes)], out=out[1:])
    return out


def row_of(first: np.ndarray, positions: np.ndarray) -> np.ndarray:
    """Document of each position, given each document's first one (n + 1)."""
    return np.searchsorted(first, positions, "right") - 1


def window_starts(first: np.ndarray, k: int) -> np.ndarray:
    """All positions at which a span of ``k`` units stays in its document."""
    lengths = np.maximum(np.diff(first) - (k - 1), 0)
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = first[:-1] - (np.cumsum(lengths) - lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(shift, lengths)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every ``w`` consecutive values (length n - w + 1)."""
    out, have = x, 1
    while have * 2 <= w:
        out = np.minimum(out[: len(out) - have], out[have:])
        have *= 2
    if have < w:
        out = np.minimum(out[: len(x) - w + 1], out[w - have : w - have + len(x) - w + 1])
    return out


def winnow(grams: np.ndarray, first: np.ndarray, k: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows of ``k + w - 1`` units and the k-gram that each one selects.

    ``grams[i]`` is the hash of the k units from ``i`` on (whatever stands
    where that leaves the document is never read). Each window selects the
    leftmost k-gram with the least upper 32 bits, so equal windows select
    equal k-grams at equal places. Returns window starts and selected places.
    """
    starts = window_starts(first, k + w - 1)
    if not len(starts):
        return starts, starts
    packed = (grams & U64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=U64)
    least = sliding_min(packed, w)
    return starts, (least[starts] & U64(0xFFFFFFFF)).astype(np.int64)


def runs(starts: np.ndarray, chosen: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranges [a, b) of consecutive windows of a document with one choice."""
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.empty(len(starts), dtype=bool)
    new[0] = True
    new[1:] = (chosen[1:] != chosen[:-1]) | (rows[1:] != rows[:-1])
    a = np.flatnonzero(new)
    return a, np.append(a[1:], len(starts))


def covered(length: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Mask of the units in [0, length) that lie in any of the spans."""
    delta = np.zeros(length + 1, dtype=np.int64)
    np.add.at(delta, starts, 1)
    np.add.at(delta, np.minimum(ends, length), -1)
    return np.cumsum(delta[:-1]) > 0
