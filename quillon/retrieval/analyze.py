"""Tokenising, analysers and the query language of full-text search."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, functions as F

from quillon.retrieval import porter2, snowball

MAX_TERM, MAX_QUERY = 128, 64

# fixed values: English stop words and synonym groups
STOP_WORDS = frozenset(
    """a an and are as at be but by for if in into is it no not of on or such
    that the their then there these they this to was will with""".split()
)
SYNONYMS = (
    ("car", "automobile"), ("database", "db"), ("buy", "purchase"), ("big", "large"), ("fast", "quick", "rapid"),
    ("movie", "film"), ("phone", "telephone"), ("child", "kid"), ("jump", "leap"), ("begin", "start"),
    ("end", "finish"), ("error", "mistake"), ("help", "assist"), ("show", "display"), ("smart", "intelligent"),
)

_ALTERNATIVES = {porter2.stem(w): sorted({porter2.stem(x) for x in group}) for group in SYNONYMS for w in group}


#: Languages with stop words and a stemmer.
LANGUAGES = ("english", *snowball.STOPS)


def is_stop(term: str, analyzer: str) -> bool:
    return term in (STOP_WORDS if analyzer == "english" else snowball.STOPS.get(analyzer, ()))


def elided(term: str, analyzer: str) -> str:
    return snowball.elided(term) if analyzer == "french" else term


def stemmed(term: str, analyzer: str) -> str:
    """A term as it is indexed."""
    if analyzer == "english":
        return porter2.stem(term)
    return snowball.stem(term, analyzer) if analyzer in snowball.STOPS else term


def _analysed(column: Column, analyzer: str) -> Column:
    @F.pandas_udf("array<string>")
    def run(rows: pd.Series) -> pd.Series:
        def one(terms):
            plain = [elided(x, analyzer) for x in terms]
            return [stemmed(x, analyzer) for x in plain if not is_stop(x, analyzer)]

        return rows.map(lambda t: None if t is None else one(t))

    return run(column)


#: ASCII first and possessive: most characters are decided by one comparison.
_TERMS = r"[a-z0-9\p{L}\p{Nd}]++(?:'++[a-z0-9\p{L}\p{Nd}]++)*+"


def tokens(text: Column, analyzer: str = "simple") -> Column:
    """Terms of a text in order (an array; null for a null text).

    Letters, digits and apostrophes, lower-cased; apostrophes at the edges
    fall away; terms of over 128 characters are dropped. Whole texts are
    analysed, however long. ``simple`` stays native; the languages drop stop
    words and stem in Arrow batches (French elision comes first).
    """
    raw = F.regexp_extract_all(F.lower(text), F.lit(_TERMS), F.lit(0))
    out = F.filter(raw, lambda t: F.char_length(t) <= MAX_TERM)
    if analyzer == "simple":
        return out
    if analyzer in LANGUAGES:
        return _analysed(out, analyzer)
    raise ValueError(f"unknown analyzer {analyzer}")


@dataclass
class Slot:
    """One place of a query: alternatives, or a prefix, or a fuzzy term."""

    terms: list[str] = field(default_factory=list)
    prefix: str | None = None
    fuzzy: tuple[str, int] | None = None


@dataclass
class Query:
    groups: list[Slot]
    phrases: list[list[Slot]]


def auto_fuzzy(n: int) -> int:
    return 0 if n <= 2 else 1 if n <= 5 else 2


def auto_typo(n: int) -> int:
    return 0 if n <= 4 else 1 if n <= 8 else 2


_PIECE = re.compile(r"(?P<term>(?:[^\W_]|')+)(?P<op>\*|~[12]?(?![^\W_]))?", re.UNICODE)


def parse_query(text: str, analyzer: str = "simple") -> Query:
    """Terms (all required), ``"phrases"``, ``pre*``, ``fuzz~``, ``fuzz~2``."""
    groups: list[Slot] = []
    phrases: list[list[Slot]] = []
    for k, part in enumerate(text.split('"')):
        slots = [s for m in _PIECE.finditer(part) if (s := _slot(m, analyzer))]
        groups += slots
        if k % 2 and slots:
            phrases.append(slots)
    if not groups:
        raise ValueError("the query has no terms")
    if len(groups) > MAX_QUERY:
        raise ValueError("the query has too many terms")
    return Query(groups, phrases)


def _slot(m: re.Match, analyzer: str) -> Slot | None:
    term, op = m["term"].lower().strip("'"), m["op"]
    term = elided(term, analyzer)
    if not term:
        return None
    if op == "*":
        return Slot(prefix=term)
    if op:
        return Slot(fuzzy=(term, int(op[1]) if len(op) > 1 else auto_fuzzy(len(term))))
    if is_stop(term, analyzer):
        return None
    stem = stemmed(term, analyzer)
    return Slot(terms=_ALTERNATIVES.get(stem, [stem]) if analyzer == "english" else [stem])


def osa(a: str, b: str, most: int) -> bool:
    """Whether the optimal string alignment distance is at most ``most``."""
    if abs(len(a) - len(b)) > most:
        return False
    two, one = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            v = min(one[j] + 1, row[-1] + 1, one[j - 1] + (x != y))
            if two and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, two[j - 2] + 1)
            row.append(v)
        if min(row) > most:
            return False
        two, one = one, row
    return one[-1] <= most
