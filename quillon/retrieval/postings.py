"""A stored full-text index: postings sorted by term.

One row for each term and document: its counts and positions in each field
and the document's length. Files are range-partitioned and sorted by term
(a common term goes on over several files), so a query reads only the row
groups of its terms. Corpus statistics are kept when the index is written;
document frequencies of a query's terms are looked up in the vocabulary. New
rows are added as further files.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from quillon.retrieval import analyze, search
from quillon.retrieval.search import B, K1
from quillon.sources.storage import fresh


@dataclass
class Postings:
    """Search without the texts; ``matched`` gives primary keys and ``_score``."""

    fields: tuple[str, ...]
    pk: tuple[str, ...]
    analyzer: str = "simple"
    parts: list[str] = field(default_factory=list)  # folders of postings
    words: list[str] = field(default_factory=list)  # folders of (term, df)
    documents: int = 0  # with a term
    length: int = 0  # terms in all
    spark: object = None
    schema: object = None

    @classmethod
    def build(cls, rows: DataFrame, fields: tuple[str, ...], pk: tuple[str, ...], analyzer: str = "simple") -> Postings:
        out = cls(fields, pk, analyzer, spark=rows.sparkSession)
        out.add(rows)
        return out

    def add(self, rows: DataFrame) -> None:
        """Index further rows (of other primary keys)."""
        index = search.Index(rows.select(*self.pk, *self.fields), self.fields, self.pk, self.analyzer)
        every = range(len(self.fields))

        def of_field(terms: Column, i: int) -> Column:
            return F.transform(F.get(terms, F.lit(i)), lambda t, k: F.struct(t.alias("term"), F.lit(i).alias("f"), k.alias("at")))

        def entries(terms: Column) -> Column:
            """All terms with their field and place."""
            return F.struct(F.size(F.flatten(terms)).alias("length"), F.flatten(F.array(*(of_field(terms, i) for i in every))).alias("flat"))

        measured = index.rows.select(*self.pk, F.explode(index.measured(entries)).alias("_m")).select(*self.pk, "_m.length", F.explode("_m.flat").alias("_e"))
        # positions of a document come together in one shuffle; a document's terms are its own groups
        where = [F.sort_array(F.collect_list(F.when(F.col("_e.f") == i, F.col("_e.at")))).alias(f"at{i}") for i in every]
        grouped = measured.groupBy(*self.pk, F.col("_e.term").alias("term"), "length").agg(*where)
        uri = fresh(self.spark, "postings")
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        grouped.repartitionByRange(parts, "term", *self.pk).sortWithinPartitions("term", *self.pk).write.parquet(uri)
        self.schema = grouped.schema
        self.parts.append(uri)
        own = self.spark.read.schema(self.schema).parquet(uri)
        vocabulary = fresh(self.spark, "vocabulary")
        own.groupBy("term").agg(F.count(F.lit(1)).alias("df")).repartitionByRange(max(1, parts // 4), "term").sortWithinPartitions("term").write.parquet(vocabulary)
        self.words.append(vocabulary)
        one = own.groupBy(*self.pk).agg(F.first("length").alias("length")).agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("total")).first()
        self.documents += one["n"]
        self.length += one["total"] or 0

    def postings(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*self.parts)

    def vocabulary(self) -> DataFrame:
        return self.spark.read.schema("term string, df long").parquet(*self.words)

    def expanded(self, text: str, typos: bool = True, whole: bool = False) -> analyze.Query:
        query = analyze.parse_query(text, self.analyzer)
        search.expand(self, query, typos, prefixes=not whole)
        return query

    def matched(self, text: str, weights: dict[str, float] | None = None, typos: bool = True, query: analyze.Query | None = None, whole: bool = False) -> DataFrame:
        """Primary key and ``_score`` of all matching rows (not ordered).

        The dialect fails on a prefix of over ``search.MAX_PREFIX`` terms. With
        ``whole`` a prefix stands for all of its terms, however many: they are a
        range of the postings, and their document frequencies are joined.
        """
        search.check_weights(weights)
        query = query or self.expanded(text, typos, whole)
        wide = whole and any(s.prefix is not None for s in query.groups)

        def hit(s: analyze.Slot) -> Column:
            return F.col("term").startswith(s.prefix) if wide and s.prefix is not None else F.col("term").isin(*s.terms)

        any_of = reduce(lambda a, b: a | b, (hit(s) for s in query.groups))
        postings = self.postings().filter(any_of)
        if any(not s.terms and not (wide and s.prefix is not None) for s in query.groups):
            return postings.limit(0).select(*self.pk, F.lit(0.0).alias("_score"))
        found = self.vocabulary().filter(any_of).groupBy("term").agg(F.sum("df").alias("df"))
        n, mean = self.documents, self.length / self.documents if self.documents else 1.0
        every = range(len(self.fields))
        weight = [float((weights or {}).get(f, 1.0)) for f in self.fields]
        tf = reduce(lambda a, b: a + b, (F.size(f"at{i}") * w for i, w in zip(every, weight, strict=True))).cast("double")
        long = K1 * (1 - B + B * F.col("length") / mean)
        if wide:
            scored = postings.join(found.select("term", F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("_idf")), "term")
            scored = scored.withColumn("_s", F.col("_idf") * tf * (K1 + 1) / (tf + long))
        else:
            idf = {r.term: math.log(1 + (n - r.df + 0.5) / (r.df + 0.5)) for r in found.collect()}  # a query has few terms
            scale = F.create_map(*(x for t, v in idf.items() for x in (F.lit(t), F.lit(v)))) if idf else F.create_map()
            scored = postings.withColumn("_s", F.try_element_at(scale, "term") * tf * (K1 + 1) / (tf + long)) if idf else postings.withColumn("_s", F.lit(0.0))
        groups = [F.max(F.when(hit(s), F.col("_s"))).alias(f"g{k}") for k, s in enumerate(query.groups)]
        places = []
        for j, phrase in enumerate(query.phrases):
            for k, s in enumerate(phrase):
                places += [F.flatten(F.collect_list(F.when(hit(s), F.col(f"at{i}")))).alias(f"p{j}_{k}_{i}") for i in every]
        rows = scored.groupBy(*self.pk).agg(*groups, *places)
        rows = rows.dropna(subset=[f"g{k}" for k in range(len(groups))])
        for j, phrase in enumerate(query.phrases):
            rows = rows.filter(reduce(lambda a, b: a | b, (_consecutive([f"p{j}_{k}_{i}" for k in range(len(phrase))]) for i in every)))
        return rows.select(*self.pk, reduce(lambda a, b: a + b, (F.col(f"g{k}") for k in range(len(groups)))).alias("_score"))


def _consecutive(columns: list[str]) -> Column:
    """Some position of the first column is followed, step by step, in the others."""
    return F.exists(F.col(columns[0]), lambda x: reduce(lambda a, b: a & b, (F.array_contains(F.col(c), x + k) for k, c in enumerate(columns[1:], 1)), F.lit(True)))
