"""The pipeline's stages against brute force, each on what the one before kept."""

import os
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from quillon.llm.queries import vocabulary
from quillon.llm.storage import materialise

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


def _shingles(text):
    w = PLAIN.findall(text.lower().replace("ß", "ss"))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} - {()}


def _items(spark):
    windows = set()
    for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect():
        w = PLAIN.findall(r.text.lower())
        windows |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))}
    return windows


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").withColumn("node", F.lit("clash"))
    stages = dict(corpus_pipeline.STAGES)
    before = {r.doc_id: r.text for r in docs.collect()}
    kept = materialise(stages["quality_rules"](spark, docs, FOLDER), "q")
    assert kept.columns == list(corpus_pipeline._COLUMNS)
    texts = {r.doc_id: r.text for r in kept.collect()}
    assert texts.items() <= before.items() and all(len(WORD.findall(t)) >= 10 for t in texts.values())
    assert len(texts) > 0.7 * len(before)

    one = materialise(stages["ngram_jaccard_join"](spark, kept, FOLDER), "n")
    left = {r.doc_id: r.text for r in one.collect()}
    sets = {i: _shingles(t) for i, t in texts.items()}
    label = {i: i for i in sets}
    near = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    for _ in range(len(near) + 1):
        for a, b in near:
            label[a] = label[b] = min(label[a], label[b])
    assert set(left) == {i for i in sets if label[i] == i}

    cut = materialise(stages["substring_dedup"](spark, one, FOLDER), "s")
    first = {}
    for i, t in sorted(left.items()):
        w = WORD.findall(t)
        for p in range(len(w) - 49):
            first.setdefault(tuple(w[p : p + 50]), i)
    want = {}
    for i, t in left.items():
        w = WORD.findall(t)
        gone = [False] * len(w)
        for p in range(len(w) - 49):
            if first[tuple(w[p : p + 50])] < i:
                gone[p : p + 50] = [True] * 50
        if not all(gone):
            want[i] = [x for x, g in zip(w, gone, strict=True) if not g]
    rows = cut.collect()
    assert {r.doc_id: WORD.findall(r.text) for r in rows} == want and all(r.n_chars == len(r.text) for r in rows)

    clean = materialise(stages["benchmark_decontamination"](spark, cut, FOLDER), "d")
    windows = _items(spark)
    dirty = {r.doc_id for r in rows if any(tuple(w[i : i + 10]) in windows for w in [PLAIN.findall(r.text.lower())] for i in range(len(w) - 9))}
    assert {r.doc_id for r in clean.collect()} == set(want) - dirty

    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    packed = stages["packing"](spark, clean, FOLDER).collect()
    tokens = Counter()
    for r in packed:
        tokens[r.doc_id] += r.length
    assert tokens == {r.doc_id: len(lib.encode(r.text, add_special_tokens=False).ids) + 1 for r in clean.collect()}
    assert corpus_pipeline.run(spark, FOLDER).count() == len(packed)


def test_stages_take_odd_rows(spark):
    """Empty tables, null and empty texts, repeated rows."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    odd = [(1, None, None, None, None), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (None, "a b c", "en", "s", 5), (None, None, "en", "s", 0)]
    for rows in ([], odd):
        docs = spark.createDataFrame(rows, schema)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, FOLDER)
            assert out.count() == {"quality_rules": 0, "ngram_jaccard_join": min(4, len(rows)), "packing": len(rows)}.get(name, len(rows))


def test_registered():
    names = set(__spark_entry__.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
