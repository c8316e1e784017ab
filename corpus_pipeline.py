"""The corpus pipeline: quality, near duplicates, repeats, benchmarks, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next stage's ``docs``. All but the
last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quillon.llm import decontaminate, ngram_jaccard, packing, quality_rules, substring_dedup
from quillon.llm.queries import vocabulary
from quillon.llm.repeats import ROW, keyed
from quillon.llm.storage import fresh

_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    judged = quality_rules.quality_rules(docs, pass_through=_COLUMNS)
    return judged.filter("kept").select(*(f"passed.{c}" for c in _COLUMNS))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class: that of the smallest doc_id.

    Of repeated rows (equal doc_id and text) one stays; rows without an id
    have no class of their own to stand for, so they stay.
    """
    classes = ngram_jaccard.near_duplicates(docs)
    stay = classes.filter("class_id IS NULL OR doc_id = class_id").select(*ROW).distinct()
    rows = keyed(docs, *_COLUMNS[2:])
    return rows.join(stay, ROW).dropDuplicates(ROW).select(*_COLUMNS)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the repeated passages; documents of which nothing is left go."""
    cut = substring_dedup.substring_dedup(docs, pass_through=("lang", "source", "n_chars"))
    left = cut.filter("n_removed = 0 OR n_removed < n_words")
    size = F.when(F.col("n_removed") == 0, F.col("n_chars")).otherwise(F.char_length("kept_text").cast("long"))
    return left.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", size.alias("n_chars"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a benchmark item."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.contamination(docs, items, pass_through=_COLUMNS[1:])
    return found.filter("NOT contaminated").select(*_COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens."""
    out = packing.pack(docs, vocabulary("byte_bpe_50k.json"), cache_words=150_000)  # workers outlive this stage
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality_rules", quality),
    ("ngram_jaccard_join", near_duplicates),
    ("substring_dedup", repeats),
    ("benchmark_decontamination", decontamination),
    ("packing", packed),
]

#: SQL cannot express the token ids and the packing (nor the robust estimates).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        uri = fresh(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(uri)
        docs = spark.read.parquet(uri)
    return docs
