"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from quillon.llm import decontaminate, license_scan, ngram_jaccard, packing, quality_rules, storage, substring_dedup, suffix_dedup, token_counts, token_files, warc_zip


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def vocabulary(name: str) -> str:
    """Path of a public tokenizer's file (folder: ``QUILLON_TOKENIZERS`` or the package)."""
    if folder := os.environ.get("QUILLON_TOKENIZERS"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc_zip.write_archives(_read(spark, sf_dir, "pages"), storage.fresh(spark, "warc"))
    return warc_zip.read_archives(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files ``source/lang/block/name``; those that open with a notice are licence files."""
    docs = _read(spark, sf_dir, "documents")
    opens = F.coalesce(F.substring_index("text", "\n", 1).rlike(license_scan.TRIGGER), F.lit(False))
    name = F.concat(F.when(opens, "LICENSE-").otherwise(""), F.col("doc_id").cast("string"))
    block = F.floor(F.col("doc_id") / 1000).cast("string")
    files = docs.select("doc_id", "text", F.concat_ws("/", "source", "lang", block, name).alias("path"))
    return license_scan.license_scan(files, corpus_terms=True)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.substring_dedup(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = token_counts.token_counts(_read(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), limit=512)
    return out.select("doc_id", "n_bytes", "n_tokens", "over_limit", "fits_chars")


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard.near_duplicates(_read(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack(_read(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.quality_rules(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    manifest = token_files.write_token_files(docs, vocabulary("word_bpe_49k.json"), end_id=2, uri=storage.fresh(spark, "tokens"))
    return token_files.read_token_files(spark, manifest).select("doc_id", "start", "n_tokens", "ids_crc32")


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.suffix_dedup(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_warc_zip": op1_warc_zip,
        "op2_license_scan": op2_license_scan,
        "op3_substring_dedup": op3_substring_dedup,
        "op4_token_counts": op4_token_counts,
        "op5_ngram_jaccard_join": op5_ngram_jaccard_join,
        "op6_packing": op6_packing,
        "op7_quality_rules": op7_quality_rules,
        "op8_decontamination": op8_decontamination,
        "op9_token_files": op9_token_files,
        "op10_suffix_array_dedup": op10_suffix_array_dedup,
    }


_WARC_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body FROM pages
), d AS (
  SELECT page_id, octet_length(encode(body)) AS payload_bytes, sha256(body) AS payload_digest FROM p
), f AS (
  SELECT payload_digest, min(page_id) AS first FROM d WHERE payload_bytes >= 100 GROUP BY payload_digest HAVING count(*) > 1
)
SELECT d.page_id, d.payload_bytes, d.payload_digest,
       CASE WHEN f.first IS NOT NULL AND d.page_id IS DISTINCT FROM f.first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN d.page_id IS DISTINCT FROM f.first THEN f.first END AS refers_to
FROM d LEFT JOIN f USING (payload_digest)
"""

_SUBSTRING_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), s AS (
  SELECT doc_id, unnest(range(1, len(words) - 48)) AS i, words FROM w WHERE len(words) >= 50
), h AS (
  SELECT doc_id, i, sha256(array_to_string(words[i:i + 49], ' ')) AS win FROM s
), m AS (
  SELECT win, min(doc_id) AS first FROM h GROUP BY win
), g AS (
  SELECT doc_id, list(DISTINCT p) AS gone
  FROM (SELECT h.doc_id, unnest(range(i, i + 50)) AS p FROM h JOIN m USING (win) WHERE h.doc_id > m.first) GROUP BY doc_id
)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
       CASE WHEN gone IS NULL THEN sha256(array_to_string(words, ' '))
            WHEN len(gone) = len(words) THEN sha256('')
            ELSE sha256(k.kept) END AS kept_sha256
FROM w LEFT JOIN g USING (doc_id)
LEFT JOIN (
  SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept
  FROM (SELECT w.doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS p, gone FROM w JOIN g USING (doc_id))
  WHERE NOT list_contains(gone, p) GROUP BY doc_id
) k USING (doc_id)
"""

_DECONTAMINATION_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, n, array_to_string(words[i:i + n - 1], ' ') AS win
  FROM (SELECT item_id, words, least(len(words), 10) AS n, unnest(range(1, greatest(len(words) - 9, 1) + 1)) AS i FROM b WHERE len(words) > 0)
), sizes AS (
  SELECT DISTINCT n FROM bw
), dw AS (
  SELECT doc_id, n, i, array_to_string(words[i:i + n - 1], ' ') AS win
  FROM (SELECT doc_id, words, n, unnest(range(1, len(words) - n + 2)) AS i FROM d, sizes WHERE len(words) >= n)
), hit AS (
  SELECT doc_id, dw.n, i, item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n
), c AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id
), t AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hit) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_warc_zip": _WARC_SQL, "op3_substring_dedup": _SUBSTRING_SQL, "op8_decontamination": _DECONTAMINATION_SQL}
