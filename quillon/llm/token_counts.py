"""Exact token counts of every prefix of a text, by prefix dynamic programming.

The merges of byte-level BPE never cross a pre-token. Within one, the last
token of each prefix follows from shorter prefixes: it is the one token ``t``
that ends there and is compatible with the last token ``p`` of what stands
before it, that is, merging the bytes of ``p + t`` gives back ``p, t``. One
step over the bytes of a pre-token so gives the counts of all its prefixes,
and each distinct pre-token is solved once for each worker. A document's
table is the pre-tokens' tables in a row, put right where cutting a text
changes its pre-tokens (runs of white space, contractions, added tokens).

From the table (one 32-bit count for each code point prefix) any question on
truncation or budgets is answered without encoding again.

Edge cases: null and empty texts have the table [0]. Strings of added tokens
inside a text count as these tokens, as the library has it by default.
Counts rise and may fall from one prefix to the next.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quillon.llm import kernels as K, tokenize
from quillon.llm.storage import ship

_SPACES = re.compile(r"\s{2,}(?=\S)")
#: Distinct pre-tokens whose tables a worker process keeps before it starts anew.
TABLE_WORDS = 1_000_000
_LONG = 256
_WHOLE = 1 << 20
_NEVER = 1 << 60


def _byte_alphabet() -> dict[str, int]:
    """The byte of each character in which byte-level vocabularies are written."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class _Tables(dict):
    """Packed tables by pre-token, solved when first asked for."""

    def __init__(self, solve) -> None:
        super().__init__()
        self.solve = solve

    def __missing__(self, word: str) -> bytes:
        table = self.solve(word)
        if len(word) <= _LONG:
            if len(self) >= TABLE_WORDS:
                self.clear()
            self[word] = table
        return table


class PrefixCounter:
    """Prefix tables for one byte-level BPE vocabulary."""

    def __init__(self, path: str) -> None:
        self.encoder = tokenize.encoder(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        if spec["model"]["type"] != "BPE" or pre.get("type") != "ByteLevel" or spec.get("normalizer") or pre.get("add_prefix_space"):
            raise ValueError("prefix counts need byte-level BPE without a normaliser")
        alphabet = _byte_alphabet()
        raw = lambda s: bytes(alphabet[c] for c in s)
        self.tokens = {raw(t): i for t, i in spec["model"]["vocab"].items() if all(c in alphabet for c in t)}
        self.reach: dict[bytes, int] = {}  # length of the longest token with these last four bytes
        for t in self.tokens:
            if len(t) > 3:
                self.reach[t[-4:]] = max(self.reach.get(t[-4:], 0), len(t))
        merges = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        self.ranks = {(raw(a), raw(b)): n for n, (a, b) in enumerate(merges)}
        self.splits: dict[bytes, tuple[bytes, bytes, int]] = {}
        for (a, b), n in self.ranks.items():
            self.splits.setdefault(a + b, (a, b, n))
        self.spines: tuple[dict, dict] = ({}, {})
        self.pairs: dict[int, bool] = {}
        self.names = {i: t for t, i in self.tokens.items()}
        self.tables = _Tables(self.word_table)
        self.added = re.compile("|".join(map(re.escape, sorted(self.encoder.added, key=len, reverse=True)))) if self.encoder.added else None

    def _spine(self, token: bytes, side: int) -> list[tuple[bytes, int]]:
        """The tokens on one edge of a token, each with the rank that ends it.

        ``side`` 1 gives those that end where ``token`` ends, 0 those that
        start where it starts, from the token itself down to one byte.
        """
        known = self.spines[side].get(token)
        if known is None:
            known, ends = [(token, _NEVER)], _NEVER
            while (split := self.splits.get(known[-1][0])) is not None:
                ends = split[2]
                known.append((split[side], ends))
            self.spines[side][token] = known
        return known

    def _compatible(self, p: bytes, t: bytes) -> bool:
        """Whether the bytes of ``p + t`` merge to the tokens p and t.

        They don't if some merge crosses the border: one of two edge tokens
        that both still stand when its turn comes. Of equal merges the left
        one goes first.
        """
        ranks, right = self.ranks, self._spine(t, 0)
        for x, x_ends in self._spine(p, 1):
            for y, y_ends in right:
                r = ranks.get((x, y))
                if r is not None and r < x_ends and r <= y_ends:
                    return False
        return True

    def byte_counts(self, word: bytes, known: int = 0, ids: list[int] | None = None, count: list[int] | None = None) -> tuple[list[int], list[int]]:
        """Last token and number of tokens of each byte prefix of a pre-token.

        ``ids`` and ``count`` may hold what an earlier word gave for the first
        ``known`` bytes that it shares with this one.
        """
        n, get, pairs, reach = len(word), self.tokens.get, self.pairs, self.reach.get
        ids = ids[: known + 1] if known else [-1]
        count = count[: known + 1] if known else [0]
        for end in range(known + 1, n + 1):
            for start in range(max(0, end - reach(word[end - 4 : end], 3)) if end > 3 else 0, end):
                t = get(word[start:end])
                if t is None:
                    continue
                if start:
                    key = ids[start] << 20 | t
                    ok = pairs.get(key)
                    if ok is None:
                        if len(pairs) > 500_000:
                            pairs.clear()
                        ok = pairs[key] = self._compatible(self.names[ids[start]], self.names[t])
                    if not ok:
                        continue
                ids.append(t)
                count.append(count[start] + 1)
                break
            else:
                raise ValueError("a byte has no token")
        return ids, count

    def learn(self, words: Iterable[str]) -> None:
        """Solve many pre-tokens in sorted order, each from the prefix it shares."""
        if len(self.tables) + len(words) > TABLE_WORDS:
            self.tables.clear()
        before, ids, count = b"", [-1], [0]
        for raw, word in sorted((w.encode("utf-8", "surrogatepass"), w) for w in words):
            shared, most = 0, min(len(raw), len(before))
            while shared < most and raw[shared] == before[shared]:
                shared += 1
            ids, count = self.byte_counts(raw, shared, ids, count)
            before = raw
            table = self._pack(word, raw, count)
            if len(word) <= _LONG:
                self.tables[word] = table

    def _pack(self, word: str, raw: bytes, count: list[int]) -> bytes:
        """Packed 32-bit counts at each code point prefix but the empty one."""
        if len(raw) == len(word):
            table = array("i", count[1:])
        else:
            ends = [i for i in range(1, len(raw)) if raw[i] & 0xC0 != 0x80]
            table = array("i", [count[i] for i in (*ends, len(raw))])
        if word in ("'re", "'ve", "'ll"):
            table[1] = 2  # cut there, the apostrophe and the letter are two pre-tokens
        return table.tobytes()

    def word_table(self, word: str) -> bytes:
        raw = word.encode("utf-8", "surrogatepass")
        return self._pack(word, raw, self.byte_counts(raw)[1])

    def _pretokens(self, text: str) -> Iterator[list[str]]:
        if self.encoder.plain(text):
            yield from self.encoder.words(text)
        else:
            pieces = self.encoder.tokenizer.pre_tokenizer.pre_tokenize_str(text)
            yield [text[a:b] for _, (a, b) in pieces]

    def _segment(self, text: str, cut: Iterable[list[str]] | None = None) -> np.ndarray:
        """Table of a text (pre-tokens ``cut``) in which no added token stands."""
        packed, sizes = [], []
        for words in cut if cut is not None else self._pretokens(text):
            packed.append(b"".join(map(self.tables.__getitem__, words)))
            sizes += map(len, words)
        if not sizes:
            return np.zeros(1, np.int32)
        flat, size = np.frombuffer(b"".join(packed), "<i4"), np.array(sizes)
        totals = flat[np.cumsum(size) - 1]
        out = np.zeros(len(flat) + 1, np.int32)
        np.add(flat, np.repeat(np.cumsum(totals) - totals, size), out=out[1:], casting="unsafe")
        for m in _SPACES.finditer(text):
            # cut at its end, the whole run is one pre-token
            out[m.end()] = out[m.start()] + np.frombuffer(self.tables[m.group()], "<i4")[-1]
        return out

    def table_batch(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """``table`` of each text; new pre-tokens of all are solved together."""
        plain = self.encoder.plain
        cuts = [list(self.encoder.words(t)) if t and len(t) <= _WHOLE and plain(t) else None for t in texts]
        known = self.tables
        self.learn({w for cut in cuts if cut for words in cut for w in words if w not in known})
        for text, cut in zip(texts, cuts, strict=True):
            yield self.table(text) if cut is None else self._segment(text, cut)

    def table(self, text: str | None) -> np.ndarray:
        """Token count of each code point prefix of a text (length + 1 entries)."""
        text = text or ""
        cuts = list(self.added.finditer(text)) if self.added else []
        out, base, at = [np.zeros(1, np.int32)], 0, 0
        for m in cuts:
            inside = self._segment(text[at : m.end() - 1])
            out.append(inside[1:] + base)
            base += int(inside[m.start() - at]) + 1
            out.append(np.array([base], np.int32))
            at = m.end()
        out.append(self._segment(text[at:])[1:] + base)
        return np.concatenate(out)


def longest_prefix(table: np.ndarray, budget: int) -> int:
    """Code points of the longest prefix of at most ``budget`` tokens."""
    return int(np.flatnonzero(table <= budget)[-1])


_COUNTERS: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    if path not in _COUNTERS:
        _COUNTERS[path] = PrefixCounter(path)
    return _COUNTERS[path]


def token_counts(docs: DataFrame, path: str, limit: int = 512, keep_table: bool = False) -> DataFrame:
    """Token counts from the prefix tables of whole texts.

    Returns one row for each row of ``docs`` (other columns than doc_id and
    text are ignored): doc_id, n_bytes, n_tokens, over_limit, fits_chars (code
    points of the longest prefix within ``limit`` tokens) and, with
    ``keep_table``, prefix_counts (little-endian 32-bit counts, one for each
    code point prefix).
    """
    ship(docs.sparkSession)

    def op(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        solver = counter(path)
        for batch in batches:
            size, tokens, fits, kept = [], [], [], []
            texts = batch.column("text").to_pylist()
            tables = (t for i in range(0, len(texts), 512) for t in solver.table_batch(texts[i : i + 512]))
            for text, table in zip(texts, tables, strict=True):
                size.append(len((text or "").encode()))
                tokens.append(int(table[-1]))
                fits.append(len(table) - 1 if table[-1] <= limit else longest_prefix(table, limit))
                kept.append(table.astype("<i4").tobytes() if keep_table else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(tokens, pa.int64()), pa.array([t > limit for t in tokens], pa.bool_()), pa.array(fits, pa.int64()), pa.array(kept, pa.binary())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit", "fits_chars", "prefix_counts"],
            )

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(K.lean(op), "doc_id long, n_bytes long, n_tokens long, over_limit boolean, fits_chars long, prefix_counts binary"
    )
    return out if keep_table else out.drop("prefix_counts")
