"""Token ids of whole texts by the tokenizers library, with a word table.

BPE merges never cross a pre-token, so the ids of a text are those of its
pre-tokens in a row. Texts of common Latin characters are cut into pre-tokens
here, many texts at once on their bytes, by rules that equal the library's
pattern; each distinct pre-token is encoded by the library once and looked up
by its bytes from then on. Any other text, and any text that holds an added
token, goes to the library as it is.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from quillon.llm import kernels as K

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

_LETTER = "A-Za-zªµºÀ-ÖØ-öø-įı-ſ"
_NUMBER = "0-9²³¹¼-¾"
#: Characters on which the pattern here and the library's surely agree.
_OTHER = re.compile(f"[^\t\n\r -~{_LETTER}{_NUMBER}¡-©«¬®-±´¶-¸»¿×÷‐-‧€]")
_ENDINGS = "'(?:s|t|re|ve|m|ll|d)"
_BYTE_LEVEL = re.compile(f"{_ENDINGS}| ?[{_LETTER}]+| ?[{_NUMBER}]+| ?[^\\s{_LETTER}{_NUMBER}]+|\\s+(?!\\S)|\\s+")
_CUT = re.compile(r"(?<=\S) (?=\S)")

#: Distinct pre-tokens in each of the two generations of a worker's table.
CACHE_WORDS = 1_000_000
_SEGMENT = 1 << 18
_LOADED: dict[str, Encoder] = {}


def segments(text: str, size: int = _SEGMENT) -> Iterator[str]:
    """Pieces of a long text, cut before a single space between two words."""
    start = 0
    while len(text) - start > size:
        m = _CUT.search(text, start + size)
        if not m:
            break
        yield text[start : m.start()]
        start = m.start()
    yield text[start:] if start else text


_SPACE, _LETTERS, _DIGITS, _REST, _FOREIGN = range(5)


def _class_of(ch: str) -> int:
    if ch in "\t\n\r ":
        return _SPACE
    if _OTHER.match(ch):
        return _FOREIGN
    return _LETTERS if re.match(f"[{_LETTER}]", ch) else _DIGITS if re.match(f"[{_NUMBER}]", ch) else _REST


#: Classes of ASCII bytes (others count as foreign until looked at), and of the characters U+0080 to U+017F.
_ONE = np.array([_class_of(chr(i)) if i < 128 else _FOREIGN for i in range(256)], np.uint8)
_TWO = np.array([_class_of(chr(i)) for i in range(0x80, 0x180)], np.uint8)


def byte_classes(data: np.ndarray) -> np.ndarray:
    """Class of the character that each byte is part of."""
    out = _ONE[data]
    high = np.flatnonzero(data >= 0x80)
    if len(high):
        wide = np.concatenate([data, np.zeros(2, np.uint8)])
        first, second, third = wide[high], wide[high + 1], wide[high + 2]
        two = (first >= 0xC2) & (first <= 0xC5)
        out[high[two]] = _TWO[(first[two].astype(np.int64) - 0xC2) * 64 + (second[two] & 0x3F)]
        marks = (first == 0xE2) & (((second == 0x80) & (third >= 0x90) & (third <= 0xA7)) | ((second == 0x82) & (third == 0xAC)))
        out[high[marks]] = _REST
        inner = high[(first & 0xC0) == 0x80]
        after = wide[inner - 1] >= 0xC0
        out[inner[after]] = out[inner[after] - 1]
        out[inner[~after]] = out[inner[~after] - 1]
    return out


def pre_tokens(data: np.ndarray, offs: np.ndarray, classes: np.ndarray, word_level: bool) -> np.ndarray:
    """Where pre-tokens start (white space of its own included).

    A run of letters, digits or other characters is one, with one space before
    it; so is a contraction ('s, 't, 're, 've, 'm, 'll, 'd) that starts a run,
    and white space up to the last character before a word. At the word level
    spaces are apart, digits single and contractions in any case.
    """
    n = len(data)
    start = np.empty(n, dtype=bool)
    start[0], start[1:] = True, classes[1:] != classes[:-1]
    border = np.zeros(n + 1, dtype=bool)
    border[offs] = True
    start |= border[:-1]
    if word_level:
        start |= (classes == _DIGITS) & ((data & 0xC0) != 0x80)
    else:
        a = np.flatnonzero(start)
        ends = np.append(a[1:], n)
        gap = classes[a] == _SPACE
        a, b = a[gap], ends[gap]
        open_ = ~border[b]
        a, b = a[open_], b[open_]
        start[b[b - a >= 2] - 1] = True
        start[b[data[b - 1] == 0x20]] = False
    at = np.flatnonzero(start[: max(n - 1, 0)] & (data[: max(n - 1, 0)] == 0x27))
    at = at[~border[at + 1]]
    if len(at):
        low = (lambda x: x | 0x20) if word_level else (lambda x: x)
        one = low(data[at + 1])
        single = np.isin(one, np.frombuffer(b"stmd", np.uint8))
        inside = at + 2 < n
        two = np.where(inside & ~border[np.minimum(at + 2, n)], low(data[np.minimum(at + 2, n - 1)]), 0)
        double = ((one == 0x72) & (two == 0x65)) | ((one == 0x76) & (two == 0x65)) | ((one == 0x6C) & (two == 0x6C))
        letter = classes[at + 1] == _LETTERS
        for hit, size in ((single & letter, 2), (double & letter, 3)):
            start[at[hit] + 1] = False
            end = at[hit] + size
            end = end[end < n]
            start[end] = True
    return np.flatnonzero(start)


_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)
_SHORT = 16


def _hash(w0: np.ndarray, w1: np.ndarray, size: np.ndarray) -> np.ndarray:
    return K.mix(K.mix(w0 + size.astype(K.U64) * K.U64(0xD6E8FEB86659FD93)) + w1)


class _Table:
    """Ids of pre-tokens by their bytes: an open-addressing table for up to 16 bytes, a dictionary beyond."""

    def __init__(self, room: int) -> None:
        slots = 1 << max(12, (2 * room - 1).bit_length())
        self.slots, self.mask = np.zeros(slots, np.int32), slots - 1
        self.first = np.zeros((room, 2), np.uint64)
        self.size = np.zeros(room, np.int64)
        self.at, self.count = np.zeros(room, np.int64), np.zeros(room, np.int64)
        self.ids = np.zeros(4 * room, np.uint32)
        self.long: dict[bytes, int] = {}
        self.room, self.used, self.stored = room, 0, 0

    def find(self, w0: np.ndarray, w1: np.ndarray, size: np.ndarray, mixed: np.ndarray) -> np.ndarray:
        """Entry of each short pre-token, or -1."""
        out = np.full(len(w0), -1, np.int64)
        todo, place = np.arange(len(w0)), (mixed & K.U64(self.mask)).astype(np.int64)
        while len(todo):
            entry = self.slots[place].astype(np.int64) - 1
            there = entry >= 0
            todo, place, entry = todo[there], place[there], entry[there]
            same = (self.first[entry, 0] == w0[todo]) & (self.first[entry, 1] == w1[todo]) & (self.size[entry] == size[todo])
            out[todo[same]] = entry[same]
            todo, place = todo[~same], (place[~same] + 1) & self.mask
        return out

    def add(self, words: list[bytes], packed: list[bytes]) -> None:
        """New pre-tokens and their packed ids."""
        ids = np.frombuffer(b"".join(packed), "<u4")
        counts = np.array([len(p) // 4 for p in packed], np.int64)
        if self.stored + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(len(ids), len(self.ids)), np.uint32)])
        new = slice(self.used, self.used + len(words))
        self.ids[self.stored : self.stored + len(ids)] = ids
        self.at[new] = self.stored + np.cumsum(counts) - counts
        self.count[new] = counts
        sizes = np.array([len(w) for w in words], np.int64)
        self.size[new] = sizes
        short = sizes <= _SHORT
        self.first[new] = np.frombuffer(b"".join(w[:_SHORT].ljust(_SHORT, b"\0") for w in words), "<u8").reshape(-1, 2)
        place = (_hash(self.first[new, 0], self.first[new, 1], sizes) & K.U64(self.mask)).astype(np.int64).tolist()
        for k, p in enumerate(place):
            if not short[k]:
                self.long[words[k]] = self.used + k
                continue
            while self.slots[p]:
                p = (p + 1) & self.mask
            self.slots[p] = self.used + k + 1
        self.used += len(words)
        self.stored += len(ids)


class Encoder:
    """Ids of texts."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.added = [t["content"] for t in spec.get("added_tokens", [])]
        self.vocabulary = max(self.tokenizer.get_vocab(with_added_tokens=True).values()) + 1
        self.word_level = self.known = False
        pre = spec.get("pre_tokenizer") or {}
        if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not spec.get("normalizer"):
            self.known = True
        elif pre.get("type") == "Sequence" and [p["type"] for p in pre["pretokenizers"]] == ["Split", "ByteLevel"]:
            split = pre["pretokenizers"][0]
            pattern = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
            steps = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
            if split["pattern"] == {"Regex": pattern} and split["behavior"] == "Removed" and split["invert"] and steps == ["NFC", "Replace", "Lowercase"]:
                self.known = self.word_level = True
        self.table: _Table | None = None
        self.old: _Table | None = None  # what the table held before it last grew full
        sep = "§" if self.word_level else "\n"
        mark = self.tokenizer.encode(sep, add_special_tokens=False).ids
        self.parted = (sep, mark[0] if len(mark) == 1 else None)

    def plain(self, text: str) -> bool:
        """Whether the rules here cut the text as the library does."""
        return self.known and not _OTHER.search(text) and not any(a in text for a in self.added)

    def words(self, text: str) -> Iterator[list[str]]:
        """Pre-tokens of a plain text at the byte level, of a long one in several lists."""
        for part in segments(text):
            yield _BYTE_LEVEL.findall(part)

    def _alone(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _learn(self, words: list[str]) -> list[bytes]:
        """Packed ids of pre-tokens: many in one text, parted by a pre-token of one id."""
        sep, mark = self.parted
        out: list[bytes | None] = [None] * len(words)
        plain = [k for k, w in enumerate(words) if sep not in w and not w.isspace()] if mark is not None else []
        for i in range(0, len(plain), 2048):
            some = plain[i : i + 2048]
            joint = f" {sep} " if self.word_level else sep
            ids = np.array(self.tokenizer.encode_batch_fast([joint + joint.join([words[k] for k in some])], add_special_tokens=False)[0].ids, dtype="<u4")
            cut = np.flatnonzero(ids == mark)
            if len(cut) != len(some):
                break
            raw, ends = ids.tobytes(), np.append(cut[1:], len(ids)).tolist()
            for k, a, b in zip(some, cut.tolist(), ends, strict=True):
                out[k] = raw[4 * a + 4 : 4 * b]
        rest = [k for k, x in enumerate(out) if x is None]
        for i in range(0, len(rest), 4096):
            for k, x in zip(rest[i : i + 4096], self._alone([words[k] for k in rest[i : i + 4096]]), strict=True):
                out[k] = x
        return out

    def _entries(self, raw: bytes, starts: np.ndarray, sizes: np.ndarray, most: int) -> np.ndarray:
        """Table entry of each pre-token; new ones are learned."""
        wide = np.ndarray((len(raw) + 1,), "<u8", raw + bytes(_SHORT), strides=(1,))
        brief = np.flatnonzero(sizes <= _SHORT)
        s, n = starts[brief], sizes[brief]
        w0 = wide[s] & _MASKS[np.minimum(n, 8)]
        w1 = np.where(n > 8, wide[np.minimum(s + 8, len(raw))] & _MASKS[np.clip(n - 8, 0, 8)], K.U64(0))
        mixed = _hash(w0, w1, n)
        lengthy = np.flatnonzero(sizes > _SHORT)
        texts = [raw[a : a + b] for a, b in zip(starts[lengthy].tolist(), sizes[lengthy].tolist(), strict=True)]
        if self.table is None:
            self.table = _Table(most)
        for _ in range(2):
            out = np.full(len(starts), -1, np.int64)
            out[brief] = self.table.find(w0, w1, n, mixed)
            out[lengthy] = [self.table.long.get(t, -1) for t in texts]
            gaps = np.flatnonzero(out < 0)
            if not len(gaps):
                return out
            new = {raw[a : a + b] for a, b in zip(starts[gaps].tolist(), sizes[gaps].tolist(), strict=True)}
            if self.table.used + len(new) > self.table.room:
                self.old, self.table = self.table, _Table(max(most, len(starts)))
                continue
            self._add(new)
        out[brief] = self.table.find(w0, w1, n, mixed)
        out[lengthy] = [self.table.long.get(t, -1) for t in texts]
        if (gaps := out < 0).any():  # the table was started anew with what is needed here
            self._add({raw[a : a + b] for a, b in zip(starts[gaps].tolist(), sizes[gaps].tolist(), strict=True)})
            out[brief] = self.table.find(w0, w1, n, mixed)
            out[lengthy] = [self.table.long.get(t, -1) for t in texts]
        return out

    def _add(self, new: set[bytes]) -> None:
        """Learn pre-tokens, or take their ids from the older table."""
        words, packed = list(new), []
        known: dict[bytes, bytes] = {}
        if self.old is not None:
            first = np.frombuffer(b"".join(w[:_SHORT].ljust(_SHORT, b"\0") for w in words), "<u8").reshape(-1, 2)
            sizes = np.array([len(w) for w in words], np.int64)
            found = self.old.find(first[:, 0], first[:, 1], sizes, _hash(first[:, 0], first[:, 1], sizes))
            for w, e in zip(words, found.tolist(), strict=True):
                e = self.old.long.get(w, -1) if len(w) > _SHORT else e
                if e >= 0:
                    at = int(self.old.at[e])
                    known[w] = self.old.ids[at : at + int(self.old.count[e])].astype("<u4").tobytes()
        learn = [w for w in words if w not in known]
        known.update(zip(learn, self._learn([w.decode() for w in learn]), strict=True))
        packed = [known[w] for w in words]
        self.table.add(words, packed)

    def arrays(self, column: pa.Array, cache_words: int | None = None) -> list[np.ndarray]:
        """Ids of each text (null: none) as unsigned 32-bit arrays, without special tokens added."""
        most = CACHE_WORDS if cache_words is None else cache_words
        data, offs = K.text_buffer(column)
        out: list[np.ndarray] = []
        for i, j in K.slices(offs):
            out += self._slice(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], most)
        return out

    def _slice(self, data: np.ndarray, offs: np.ndarray, most: int) -> list[np.ndarray]:
        docs = len(offs) - 1
        none = np.zeros(0, "<u4")
        if not len(data):
            return [none] * docs
        raw = data.tobytes()
        foreign = np.zeros(docs, dtype=bool)
        if self.known:
            classes = byte_classes(data)
            odd = np.flatnonzero(classes == _FOREIGN)
            foreign[np.searchsorted(offs, odd, "right") - 1] = True
            for mark in (a.encode() for a in self.added):
                at = raw.find(mark)
                while at >= 0:
                    foreign[np.searchsorted(offs, at, "right") - 1] = True
                    at = raw.find(mark, at + 1)
        else:
            foreign[:] = np.diff(offs) > 0
        whole = {r: np.array(self.tokenizer.encode(raw[offs[r] : offs[r + 1]].decode(), add_special_tokens=False).ids, dtype="<u4") for r in np.flatnonzero(foreign).tolist()}
        if len(whole) == docs:
            return [whole[r] for r in range(docs)]
        starts = pre_tokens(data, offs, classes, self.word_level)
        sizes = np.diff(np.append(starts, len(data)))
        use = ~foreign[np.searchsorted(offs, starts, "right") - 1]
        if self.word_level:
            use &= classes[starts] != _SPACE
        starts, sizes = starts[use], sizes[use]
        entry = self._entries(raw, starts, sizes, most)
        count = self.table.count[entry]
        ends = np.cumsum(count)
        flat = self.table.ids[np.repeat(self.table.at[entry] - (ends - count), count) + np.arange(ends[-1] if len(ends) else 0)]
        edge = np.concatenate([[0], ends])[np.searchsorted(starts, offs)].tolist()
        return [whole[r] if r in whole else flat[a:b] for r, (a, b) in enumerate(zip(edge[:-1], edge[1:], strict=True))]

    def encode(self, texts: list[str | None], cache_words: int | None = None) -> list[bytes]:
        """Packed ids of each text."""
        return [x.astype("<u4").tobytes() for x in self.arrays(pa.array(texts, pa.large_string()), cache_words)]


def encoder(path: str) -> Encoder:
    """The encoder of a vocabulary file, loaded once for each process."""
    if path not in _LOADED:
        _LOADED[path] = Encoder(path)
    return _LOADED[path]
