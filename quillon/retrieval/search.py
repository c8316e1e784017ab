"""SEARCH: boolean match with BM25 ranking, facets, highlights.

Corpus statistics (documents, lengths, document frequencies) come from one
aggregation over all rows, whatever WHERE keeps later. Prefix and fuzzy terms
and typos are expanded against the distinct terms of the corpus, within the
dialect's caps, before the plan is built; scoring then is one projection.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce
from itertools import product

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from quillon.retrieval import analyze
from quillon.retrieval.analyze import Query, Slot
from quillon.sources.storage import ship

K1, B = 1.2, 0.75
MAX_PREFIX, MAX_FUZZY, MAX_FACET = 256, 4096, 1024


def spread(rows: DataFrame) -> DataFrame:
    """Deal out a scan of fewer partitions than there are cores (a small or single-group file).

    Analysis costs far more than moving such a scan; a large one stays as it is.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() * 2 <= cores else rows


@dataclass
class Index:
    """A full-text index: the rows, each field's terms and the primary key."""

    rows: DataFrame
    fields: tuple[str, ...]
    pk: tuple[str, ...]
    analyzer: str = "simple"

    def __post_init__(self) -> None:
        ship(self.rows.sparkSession)
        self.rows = spread(self.rows)

    def terms(self) -> Column:
        """One array of terms for each field."""
        empty = F.array().cast("array<string>")
        return F.array(*(F.coalesce(analyze.tokens(F.col(f), self.analyzer), empty) for f in self.fields))

    def measured(self, body) -> Column:
        """What ``body`` makes of a row's terms, as an array of one.

        The terms are bound by a lambda, so a row is analysed once however
        often ``body`` uses them.
        """
        return F.transform(F.array(self.terms()), body)

    def vocabulary(self) -> DataFrame:
        return self.rows.select(F.explode(F.array_distinct(F.flatten(self.terms()))).alias("term")).distinct()


def expand(index, query: Query, typos: bool, prefixes: bool = True) -> None:
    """Fill the alternatives of prefix, fuzzy and misspelt slots in place.

    ``index`` has a ``vocabulary`` with a column ``term``; terms may repeat.
    Without ``prefixes`` those slots stay as they are.
    """
    slots = {id(s): s for s in query.groups}.values()
    for s in slots:
        if s.prefix is not None and not prefixes:
            continue
        if s.prefix is not None:
            s.terms = [r.term for r in index.vocabulary().select("term").filter(F.col("term").startswith(s.prefix)).distinct().orderBy("term").limit(MAX_PREFIX + 1).collect()]
            if len(s.terms) > MAX_PREFIX:
                raise ValueError("a prefix has too many matches")
        elif s.fuzzy is not None:
            s.terms = _near(index, *s.fuzzy)
    if not typos:
        return
    plain = {t for s in slots if s.prefix is None and s.fuzzy is None for t in s.terms}
    if not plain:
        return
    present = {r.term for r in index.vocabulary().select("term").filter(F.col("term").isin(*plain)).distinct().collect()}
    for s in slots:
        if s.prefix is None and s.fuzzy is None and not present.intersection(s.terms):
            most = analyze.auto_typo(len(s.terms[0]))
            if most:
                s.terms = _near(index, s.terms[0], most)


def _near(index, term: str, most: int) -> list[str]:
    @F.pandas_udf("boolean")
    def close(words: pd.Series) -> pd.Series:
        return words.map(lambda w: analyze.osa(w, term, most)).astype(bool)

    near = index.vocabulary().select("term").distinct().filter(F.abs(F.char_length("term") - len(term)) <= most)
    near = near.filter(close(F.col("term")))
    found = [r.term for r in near.orderBy("term").limit(MAX_FUZZY + 1).collect()]
    if len(found) > MAX_FUZZY:
        raise ValueError("a fuzzy term has too many matches")
    return found


def _count(terms: Column, term: str) -> Column:
    return F.size(terms) - F.size(F.array_remove(terms, F.lit(term)))


def _phrase(terms: Column, slots: list[Slot]) -> Column:
    """The slots' terms stand side by side in a field."""
    ways = math.prod(len(s.terms) for s in slots)
    if ways <= 64:
        flat = F.concat(F.lit(" "), F.array_join(terms, " "), F.lit(" "))
        return reduce(lambda a, b: a | b, (F.contains(flat, F.lit(f" {' '.join(x)} ")) for x in product(*(s.terms for s in slots))))
    fits = lambda at, k: F.coalesce(F.get(terms, at + k).isin(*slots[k].terms), F.lit(False))
    places = F.when(F.size(terms) > 0, F.sequence(F.lit(0), F.size(terms) - 1)).otherwise(F.array().cast("array<int>"))
    return F.exists(places, lambda at: reduce(lambda a, b: a & b, (fits(at, k) for k in range(len(slots)))))


def check_weights(weights: dict[str, float] | None) -> None:
    for w in (weights or {}).values():
        if not 0 < w <= 64:
            raise ValueError("a weight must be over 0 and at most 64")


def expanded(index: Index, text: str, typos: bool = True) -> Query:
    """The query with all terms that its slots stand for."""
    query = analyze.parse_query(text, index.analyzer)
    expand(index, query, typos)
    return query


def matched(index: Index, text: str, weights: dict[str, float] | None = None, typos: bool = True, query: Query | None = None) -> DataFrame:
    """All matching rows with ``_score`` (not ordered)."""
    check_weights(weights)
    query = query or expanded(index, text, typos)
    if any(not s.terms for s in query.groups):
        return index.rows.withColumn("_score", F.lit(0.0)).limit(0)
    weight = [float((weights or {}).get(f, 1.0)) for f in index.fields]
    terms = sorted({t for s in query.groups for t in s.terms})
    number = {t: k for k, t in enumerate(terms)}
    every = range(len(index.fields))

    def measure(fields: Column) -> Column:
        field = [F.get(fields, F.lit(i)) for i in every]
        length = reduce(lambda a, b: a + b, (F.size(f) for f in field))
        found = {t: reduce(lambda a, b: a + b, (_count(f, t) for f in field)) for t in terms}
        scaled = {t: reduce(lambda a, b: a + b, (_count(f, t) * w for f, w in zip(field, weight, strict=True))) for t in terms}
        keep = [reduce(lambda a, b: a | b, (found[t] > 0 for t in s.terms)) for s in query.groups]
        keep += [reduce(lambda a, b: a | b, (_phrase(f, p) for f in field)) for p in query.phrases]
        parts = [x for t, k in number.items() for x in (scaled[t].cast("double").alias(f"tf{k}"), (found[t] > 0).alias(f"has{k}"))]
        return F.struct(length.alias("length"), reduce(lambda a, b: a & b, keep).alias("keep"), *parts)

    measured = index.measured(measure)
    counted = index.rows.select(F.explode(measured).alias("_m")).select("_m.*")
    stats = counted.agg(F.count_if(F.col("length") > 0).alias("n"), F.sum("length").alias("total"), *(F.count_if(f"has{k}").alias(f"df{k}") for k in number.values())).first()
    n, mean = stats["n"], (stats["total"] or 0) / stats["n"] if stats["n"] else 1.0
    idf = {t: math.log(1 + (n - stats[f"df{k}"] + 0.5) / (stats[f"df{k}"] + 0.5)) for t, k in number.items()}
    long = K1 * (1 - B + B * F.col("_m.length") / mean)

    def score(t: str) -> Column:
        tf = F.col(f"_m.tf{number[t]}")
        return idf[t] * tf * (K1 + 1) / (tf + long)

    best = [F.greatest(*(score(t) for t in s.terms)) if len(s.terms) > 1 else score(s.terms[0]) for s in query.groups]
    rows = index.rows
    if index.analyzer == "simple":  # a term of a text is a part of the text: most rows need no analysis
        lowered = [F.lower(F.col(f)) for f in index.fields]
        cheap = [reduce(lambda a, b: a | b, (F.coalesce(F.contains(x, F.lit(t)), F.lit(False)) for x in lowered for t in s.terms)) for s in query.groups if len(s.terms) <= 16]
        if cheap:
            rows = rows.filter(reduce(lambda a, b: a & b, cheap))
    # exploded, so that the filter on what is measured does not measure again
    found = rows.withColumn("_m", F.explode(F.filter(measured, lambda m: m["keep"])))
    return found.withColumn("_score", reduce(lambda a, b: a + b, best)).drop("_m")


def search(index: Index, text: str, k: int | None = None, offset: int = 0, where: Column | None = None, weights: dict[str, float] | None = None, typos: bool = True) -> DataFrame:
    """Matching rows, best first, ties by primary key."""
    out = matched(index, text, weights, typos)
    if where is not None:
        out = out.filter(where)
    out = out.orderBy(F.col("_score").desc(), *index.pk)
    if offset:
        out = out.offset(offset)
    return out if k is None else out.limit(k)


def facet(matches: DataFrame, columns: list[str], top: int | None = None) -> DataFrame:
    """facet, value, count of each column over all matches; counts falling, values rising."""
    parts = []
    for at, c in enumerate(columns):
        counts = matches.filter(F.col(c).isNotNull()).groupBy(F.col(c).cast("string").alias("value"), F.col(c).alias("_key")).agg(F.count(F.lit(1)).alias("count"))
        w = Window.orderBy(F.col("count").desc(), F.col("_key"))  # bounded: at most MAX_FACET values
        counts = counts.limit(MAX_FACET + 1).withColumn("_rank", F.row_number().over(w))
        counts = counts.withColumn("_rank", F.when(F.count(F.lit(1)).over(Window.partitionBy()) > MAX_FACET, F.raise_error(F.lit("a facet has too many values"))).otherwise(F.col("_rank")))
        if top is not None:
            counts = counts.filter(F.col("_rank") <= top)
        parts.append(counts.select(F.lit(at).alias("_at"), F.lit(c).alias("facet"), "value", "count", F.col("_rank").cast("long").alias("rank")))
    return reduce(lambda a, b: a.unionByName(b), parts).orderBy("_at", "rank").drop("_at")


def highlight(text: Column, terms: list[str], pre: str = "<mark>", post: str = "</mark>", analyzer: str = "simple") -> Column:
    """The text with its matching words between ``pre`` and ``post``."""
    wanted = frozenset(terms)

    @F.pandas_udf("string")
    def mark(column: pd.Series) -> pd.Series:
        return column.map(lambda t: None if t is None else _mark(t, wanted, pre, post, analyzer))

    return mark(text)


def _spans(text: str, wanted: frozenset[str], analyzer: str) -> list[tuple[int, int]]:
    out = []
    for m in analyze._PIECE.finditer(text):
        raw = m["term"]
        word = raw.strip("'")
        at = m.start() + len(raw) - len(raw.lstrip("'"))
        low = analyze.elided(word.lower(), analyzer)
        term = low if low in wanted else analyze.stemmed(low, analyzer)  # a prefix or fuzzy hit may be unstemmed
        if word and term in wanted and not analyze.is_stop(low, analyzer):
            out.append((at, at + len(word)))
    return out


def _mark(text: str, wanted: frozenset[str], pre: str, post: str, analyzer: str) -> str:
    out, at = [], 0
    for a, b in _spans(text, wanted, analyzer):
        out += [text[at:a], pre, text[a:b], post]
        at = b
    return "".join([*out, text[at:]])


def snippet(text: Column, terms: list[str], width: int = 160, pre: str = "<mark>", post: str = "</mark>", analyzer: str = "simple") -> Column:
    """The window of ``width`` characters that covers most matches, highlighted."""
    if not 16 <= width <= 4096:
        raise ValueError("SNIPPET: the width must be 16 to 4096")
    wanted = frozenset(terms)

    @F.pandas_udf("string")
    def cut(column: pd.Series) -> pd.Series:
        return column.map(lambda t: None if t is None else _snippet(t, wanted, width, pre, post, analyzer))

    return cut(text)


def _snippet(text: str, wanted: frozenset[str], width: int, pre: str, post: str, analyzer: str) -> str:
    spans = _spans(text, wanted, analyzer)
    if len(text) <= width:
        return _mark(text, wanted, pre, post, analyzer)
    last = len(text) - width
    starts = {0, last} | {min(max(x, 0), last) for a, b in spans for x in (a - width // 4, a, b - width)}

    def worth(s: int) -> tuple[int, int, int]:
        inside = [min(b, s + width) - max(a, s) for a, b in spans if a < s + width and b > s]
        return len(inside), sum(inside), -s

    start = max(starts, key=worth)
    piece = _mark(text[start : start + width], wanted, pre, post, analyzer)
    return ("…" if start else "") + piece + ("…" if start < last else "")
