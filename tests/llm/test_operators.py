"""Each operator against a brute-force version, on rows with every edge case."""

import hashlib
import io
import random
import re
import struct
import zipfile
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillon.llm import components, decontaminate, kernels, license_scan, ngram_jaccard, packing, quality_rules, queries, storage, substring_dedup, suffix_dedup, token_counts, token_files, tokenize, warc_zip
from quillon.llm.queries import vocabulary

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row_key string, anchor string, node int, marks int, path string"


def _texts():
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(400)] + ["Éa", "naïve", "日本", "x'y", "don't"]
    say = lambda n: [rnd.choice(words) for _ in range(n)]
    passage, long = say(70), say(6000)
    out = [None, "", "  \n\t ", "a b", "a  b", "single"]
    for i in range(20):
        out.append(" ".join(say(rnd.randint(5, 90)) + passage[rnd.randint(0, 15) :] + say(rnd.randint(0, 60))))
    base = say(120)
    out.append(" ".join(base))
    for i in range(12):  # near copies
        near = list(base)
        near[10 * i % 120] = f"new{i}"
        out.append(" ".join(near))
    out += [" ".join(long), " ".join(long[2000:2300] + say(40)), " ".join(say(30) * 5), "x" * 700, "ab" * 400, out[7], "Line one two\nLine one two\nother"]
    return out


@pytest.fixture(scope="module")
def rows():
    out = [(i, t) for i, t in enumerate(_texts())]
    return [*out, out[8], out[8], (None, out[9][1]), (None, None), (3, "another text with an id that is taken")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    full = [(i, t, ("en", "fr", None)[k % 3], f"s{k % 2}", 1, "k", "a", 1, 2, f"p/{k}") for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def _same(got, want):
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


@pytest.mark.parametrize("bucket", [10_000, 1])
def test_substring_dedup(docs, rows, none, bucket):
    first = {}
    for i, t in rows:
        w = WORD.findall(t or "")
        for p in range(len(w) - 49):
            k = tuple(w[p : p + 50])
            if i is not None:
                first[k] = min(i, first.get(k, i))
    want = []
    for i, t in rows:
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for p in range(len(w) - 49):
            if i is not None and first[tuple(w[p : p + 50])] < i:
                gone[p : p + 50] = [True] * 50
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        want.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    out = substring_dedup.substring_dedup(docs, bucket=bucket)
    _same(out.select("doc_id", "n_words", "n_removed", "kept_sha256").collect(), want)
    for r in out.collect():
        assert hashlib.sha256(" ".join(WORD.findall(r.kept_text or "")).encode()).hexdigest() == r.kept_sha256
    assert sum(w[2] for w in want) > 500
    assert substring_dedup.substring_dedup(none).count() == 0


@pytest.mark.parametrize("bucket", [4096, 1])
def test_suffix_dedup(docs, rows, none, bucket):
    seen = Counter()
    for _, t in rows:
        b = (t or "").encode()
        seen.update(b[p : p + 200] for p in range(len(b) - 199))
    want = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 199):
            if seen[b[p : p + 200]] > 1:
                gone[p : p + 200] = b"\1" * 200
        spans = sum(1 for k, g in enumerate(gone) if g and not (k and gone[k - 1]))
        want.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    _same(suffix_dedup.suffix_dedup(docs, bucket=bucket).drop("kept_bytes").collect(), want)
    assert suffix_dedup.suffix_dedup(none).count() == 0


def test_suffix_sort_orders_suffixes():
    rnd = random.Random(3)
    text = bytes(rnd.choice(b"ab") for _ in range(3000))
    data = np.frombuffer(text, np.uint8)
    pos = np.arange(0, 2900, 3)
    group = pos % 4
    order = suffix_dedup.suffix_sort(data, kernels.byte_prefix(data), group, pos, 40)
    want = sorted(range(len(pos)), key=lambda k: (group[k], text[pos[k] : pos[k] + 40], k))
    assert order.tolist() == want


def _library(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary(name))


HARD = [
    "it're  fine\n\n \n x 're 've!'s <|endoftext|> a  <|endoftext|>",
    "don't we'll they've'd 'tis 'll",
    "naïve ½ ² 東京 😀😀  x İ ŉ \x1c\x1d a\x0bb\x0c",
    "é" * 40 + "x" * 300,
    "foo<|endoftext|><|endoftext|>bar !!!<|endoftext",
    "ﬁ Ａ ① Ⅳ ᾳ ́é §§ § a§b",
]


def test_prefix_counts_at_every_prefix():
    lib, mine = _library("byte_bpe_50k.json"), token_counts.counter(vocabulary("byte_bpe_50k.json"))
    rnd = random.Random(2)
    for text in HARD + ["".join(rnd.choice("ab '\n\tsrtlvemd1!é😀 <|") for _ in range(30)) for _ in range(40)]:
        table = mine.table(text)
        assert table.tolist() == [len(lib.encode(text[:i], add_special_tokens=False).ids) for i in range(len(text) + 1)]
        assert next(mine.table_batch([text])).tolist() == table.tolist()


def test_token_counts(docs, rows, none):
    lib = _library("byte_bpe_50k.json")
    want = []
    for i, t in rows:
        n = len(lib.encode(t or "", add_special_tokens=False).ids)
        want.append((i, len((t or "").encode()), n, n > 512))
    out = token_counts.token_counts(docs, vocabulary("byte_bpe_50k.json"), keep_table=True)
    _same(out.select("doc_id", "n_bytes", "n_tokens", "over_limit").collect(), want)
    text = {(i, len((t or "").encode())): t or "" for i, t in rows}
    for r in out.collect():
        table = np.frombuffer(r.prefix_counts, "<i4")
        assert table[r.fits_chars] <= 512 and (r.fits_chars == len(text[r.doc_id, r.n_bytes]) or table[r.fits_chars + 1 :].min() > 512)
    assert token_counts.token_counts(none, vocabulary("byte_bpe_50k.json")).count() == 0


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_equals_the_library(rows, name):
    rnd = random.Random(4)
    noise = ["".join(rnd.choice("ab 's'st're'VE'll 'd'm12 \n\n  \t!?é²—€İ東<|") for _ in range(rnd.randint(0, 60))) for _ in range(3000)]
    texts = HARD + [t for _, t in rows] + ["a " * 200_000, "w" * 40 + " " + "y" * 17 + " " + "z" * 16] + noise
    lib = _library(name)
    want = [lib.encode(t or "", add_special_tokens=False).ids for t in texts]
    for room in (None, 300):  # a table that is started anew again and again
        packed = tokenize.Encoder(vocabulary(name)).encode(texts, room)
        assert [np.frombuffer(p, "<u4").tolist() for p in packed] == want


def test_near_duplicates(docs, rows, none):
    for block in (1024, 2):
        got = ngram_jaccard.near_duplicates(docs, block=block).drop("row_id", "row_key").collect()
        sets = []
        for _, t in rows:
            w = PLAIN.findall((t or "").lower().replace("ß", "ss"))
            sets.append({tuple(w[p : p + 5]) for p in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} - {()})
        n = len(rows)
        links = [[b for b in range(n) if a != b and sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])] for a in range(n)]
        label = list(range(n))
        for _ in range(n):
            label = [min([label[a], *(label[b] for b in links[a])]) for a in range(n)]
        want = []
        for a, (i, _) in enumerate(rows):
            ids = [rows[b][0] for b in range(n) if label[b] == label[a] and rows[b][0] is not None]
            want.append((i, min(ids, default=None) if sets[a] else i, len(links[a])))
        _same(got, want)
    assert max(w[2] for w in want) > 8
    assert ngram_jaccard.near_duplicates(none).count() == 0


def test_pruning_keeps_similar_pairs():
    bits = [ngram_jaccard.least_agreement(n, 0.8, 1e-6) for n in (32, 64, 96, 128)]
    assert bits == sorted(bits) and bits[-1] < 0.9 * 128
    rng = np.random.default_rng(0)
    common = rng.integers(0, 1 << 62, 400).astype(np.uint64)
    kept = 0
    for _ in range(30):
        a, b = np.concatenate([common, rng.integers(0, 1 << 62, 40).astype(np.uint64)]), np.concatenate([common, rng.integers(0, 1 << 62, 40).astype(np.uint64)])
        grams = np.concatenate([np.sort(a), np.sort(b)])
        _, values = ngram_jaccard.signatures(np.repeat([0, 1], [len(a), len(b)]), grams)
        sketch = ngram_jaccard.sketch_bits(values).view(np.uint32)
        kept += int(ngram_jaccard.Pruner(128, 0.8, 1e-6).keep(sketch[:1], sketch[1:])[0])
    assert kept == 30


def test_components(spark):
    rnd = random.Random(1)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5, 5)]
    label = {}
    for u, v in edges:
        label.setdefault(u, u)
        label.setdefault(v, v)
    for _ in range(400):
        for u, v in edges:
            label[u] = label[v] = min(label[u], label[v])
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {n: r for n, r in label.items() if n in got}
    assert {n for u, v in edges if u != v for n in (u, v)} == set(got)


def test_packing(docs, rows, none):
    lib = _library("byte_bpe_50k.json")
    out = packing.pack(docs, vocabulary("byte_bpe_50k.json")).collect()
    lengths = Counter()
    for i, t in rows:
        ids = lib.encode(t or "", add_special_tokens=False).ids + [1]
        for s in range(0, len(ids), 2048):
            piece = np.array(ids[s : s + 2048], "<u4")
            lengths[i, s, len(piece), zlib.crc32(piece.tobytes()), len(ids)] += 1
    assert lengths == Counter(tuple(r)[:5] for r in out)
    sequences = {}
    for r in out:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in sequences.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= 2048
    assert packing.pack(none, vocabulary("byte_bpe_50k.json")).count() == 0


def test_column_generation_is_near_the_bound():
    demand = np.random.default_rng(1).integers(0, 500, 64)
    patterns, use = packing.plan(demand, 64)
    assert ((patterns * use[:, None]).sum(axis=0) == demand).all()
    assert (patterns @ np.arange(1, 65) <= 64).all()
    assert use.sum() <= 1.02 * packing.column_generation(demand, 64)[1].sum() + 1


def test_quality_base(docs, rows, none):
    got = quality_rules.quality_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()
    want = []
    for i, t in rows:
        t = t or ""
        w = WORD.findall(t)
        count = Counter(tuple(w[p : p + 5]) for p in range(len(w) - 4))
        hit = [False] * len(w)
        for p in range(len(w) - 4):
            if count[tuple(w[p : p + 5])] > 1:
                hit[p : p + 5] = [True] * 5
        lines = [x for x in t.split("\n") if WORD.search(x)]
        failed = len(w) < 10 or 100 * sum(hit) > 20 * len(w)
        want.append((i, len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), sum(hit), failed))
    _same(got, want)
    assert quality_rules.quality_rules(none).count() == 0


_QUALITY = "doc_id long, text string, lang string, source string"


def _statistics(rows):
    x = [
        [np.log(r.n_words + 1), np.log((r.word_chars + 1) / (r.n_words + 1)), np.log1p(100 * r.n_symbols / (r.word_chars + 1)), np.log1p(r.n_dup_lines), np.log1p(100 * r.n_repeat_words / (r.n_words + 1))]
        for r in rows
    ]
    return np.round(np.array(x).reshape(-1, 5) * 1000)


def _mcd(x):
    """n of the core, mean and scatter of one group, by the docstring."""
    floor, factor, n = np.diag((np.array(quality_rules.FLOORS) * 1000) ** 2), quality_rules.consistency(), len(x)
    lower = lambda v: np.sort(v, axis=0)[(n - 1) // 2]
    log_det = lambda c: np.linalg.slogdet(c)[1]
    m = lower(x)
    scale = np.sqrt((1.4826 * lower(np.abs(x - m))) ** 2 + np.diag(floor))
    z = (x - m) / scale
    size = np.sqrt((z**2).sum(axis=1, keepdims=True))
    starts = [np.eye(5)]
    for v in (np.tanh(z), np.divide(z, size, out=np.zeros_like(z), where=size > 0)):
        c = np.cov(np.round(v * 1000).T, bias=True)
        root = np.sqrt(np.maximum(np.diag(c), 1))
        corr = 0.9 * c / np.outer(root, root)
        np.fill_diagonal(corr, 1)
        starts.append(corr)

    def step(mean, cov):
        d2 = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)
        bins = np.minimum(np.floor(np.log1p(d2) * 400), 20_000)
        before = np.searchsorted(np.sort(bins), bins)
        core = x[before < n * quality_rules.CORE]
        return len(core), core.mean(axis=0), factor * np.cov(core.T, bias=True) + floor

    found = []
    for corr in starts:
        one = step(m, corr * np.outer(scale, scale))
        for _ in range(quality_rules.FIRST_STEPS - 1):
            one = step(*one[1:])
        found.append(one)
    best = min(found, key=lambda e: log_det(e[2]))
    while log_det((new := step(*best[1:]))[2]) < log_det(best[2]) - quality_rules.SETTLED:
        best = new
    return best


def _judged(spark, rows):
    """Rows of the operator against the method in numpy, of groups of any size."""
    got = sorted(quality_rules.quality_rules(spark.createDataFrame(rows, _QUALITY), pass_through=("lang", "source")).collect(), key=str)
    ok = [r for r in got if not r.base_failed]
    x, lang, pair = _statistics(ok), [r.passed.lang for r in ok], [(r.passed.lang, r.passed.source) for r in ok]
    names = {None, *((g,) for g in lang), *pair}
    of = lambda g: np.array([g is None or g == (a,) or g == b for a, b in zip(lang, pair, strict=True)])
    fits = {g: _mcd(x[of(g)]) for g in names}
    want = []
    for k, g in enumerate(pair):
        mean, cov = fits[None][1:]
        for name in ((g[0],), g):
            n, m, c = fits[name]
            mean = (n * m + quality_rules.PRIOR_MEAN * mean) / (n + quality_rules.PRIOR_MEAN)
            cov = (n * c + quality_rules.PRIOR * cov) / (n + quality_rules.PRIOR)
        want.append((x[k] - mean) @ np.linalg.inv(cov) @ (x[k] - mean))
    assert np.allclose([r.d2 for r in ok], want, rtol=1e-6)
    assert all(r.kept == (r.d2 <= quality_rules.CUTOFF) for r in ok) and not any(r.kept or r.d2 for r in got if r.base_failed)
    assert len(got) == len(rows)
    return got


def _say(rng, mark=""):
    return " ".join("".join(rng.choice(list("abcdefgh"), 6)) + mark for _ in range(int(rng.integers(80, 200))))


def test_robust_estimates_reject_outliers(spark):
    rng = np.random.default_rng(7)
    rows = [(k, _say(rng, "" if k % 10 else "***"), "en", "s") for k in range(400)]
    assert {r.doc_id: r.kept for r in _judged(spark, rows)} == {k: k % 10 != 0 for k in range(400)}


def test_outliers_of_groups_of_any_size(spark):
    """A rare source's junk is far from its language, that of a rare language from all documents."""
    rng = np.random.default_rng(11)
    rows = [(k, _say(rng), "en", "hot") for k in range(240)] + [(k, _say(rng), "en", f"s{k % 3}") for k in range(300, 340)]
    rows += [(240, _say(rng), "en", "rare"), (241, _say(rng, "***"), "en", "rare"), (242, _say(rng), "de", "rare"), (243, _say(rng, "***"), "de", "rare"), (244, _say(rng, "***"), "en", None), (245, _say(rng, "***"), None, "")]
    got = {r.doc_id: r.kept for r in _judged(spark, rows)}
    assert got == {k: k not in (241, 243, 244, 245) for k, *_ in rows}
    few = [(k, _say(rng), "en", None if k % 2 else "") for k in range(7)]
    assert all(r.kept for r in _judged(spark, few))


def test_repeated_rows_of_other_groups_are_judged_apart(spark):
    """Equal id and text in another language: each row has its own group's verdict."""
    rng = np.random.default_rng(5)
    rows = [(k, _say(rng), "en", "s") for k in range(300)] + [(1000 + k, _say(rng, "#" * 5), "fr", "s") for k in range(300)]
    rows += [(7, rows[7][1], "fr", "s"), (7, rows[7][1], "en", "s")]
    en, again, fr = sorted((r.passed.lang, r.d2) for r in _judged(spark, rows) if r.doc_id == 7)
    assert en == again and en[1] < quality_rules.CUTOFF and fr[1] > 5 * en[1] + 10


def test_chi_square():
    assert abs(quality_rules.chi_square_quantile(0.975, 5) - 12.8325) < 1e-3 and abs(quality_rules.chi_square_quantile(0.5, 7) - 6.3458) < 1e-3
    rng = np.random.default_rng(1)
    x = np.sort((rng.normal(size=(400_000, 5)) ** 2).sum(axis=1))
    assert abs(x[300_000] - quality_rules.chi_square_quantile(0.75, 5)) < 0.05


def test_decontamination(spark, docs, rows, none):
    items = [(1, rows[12][1][40:200]), (2, "a B"), (10, rows[13][1][:300].upper()), (11, None), (12, ""), (None, "single"), (1, rows[12][1][40:200])]
    items += [(20 + k, f"own words {k} of an item and then " + rows[14][1][30:250]) for k in range(30)]  # a window that many items share
    table = spark.createDataFrame(items, "item_id long, text string")
    windows = {}
    for k, t in items:
        w = PLAIN.findall((t or "").translate(ASCII_LOWER))
        for p in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[p : p + 10]), set()).add("" if k is None else str(k))
    want = []
    for i, t in rows:
        w = PLAIN.findall((t or "").translate(ASCII_LOWER))
        hit, names = [False] * len(w), set()
        for n in {len(k) for k in windows}:
            for p in range(len(w) - n + 1):
                if found := windows.get(tuple(w[p : p + n])):
                    names |= found
                    hit[p : p + n] = [True] * n
        want.append((i, len(w), sum(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), any(hit)))
    assert sum(w[5] for w in want) > 3
    for block in (1 << 20, 200):
        out = decontaminate.contamination(docs, table, block_bytes=block)
        _same(out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect(), want)
    assert decontaminate.contamination(none, table).count() == 0
    assert not decontaminate.contamination(docs, table.limit(0)).filter("contaminated").count()


def test_token_files(spark, docs, rows, none):
    lib = _library("word_bpe_49k.json")
    manifest = token_files.write_token_files(docs, vocabulary("word_bpe_49k.json"), 2, storage.fresh(spark, "t"), block_ids=100)
    got = token_files.read_token_files(spark, manifest, split_documents=3).collect()
    want = Counter()
    for i, t in rows:
        ids = np.array(lib.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        want[i, len(ids), zlib.crc32(ids.tobytes())] += 1
    assert want == Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got)
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    ids = [-1 if r.doc_id is None else r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert ids == sorted(ids)
    assert token_files.read_token_files(spark, token_files.write_token_files(none, vocabulary("word_bpe_49k.json"), 2, storage.fresh(spark, "t"))).count() == 0


@pytest.mark.parametrize("bits", [1, 3, 8, 13, 16, 17, 32])
def test_bit_packing_round_trip(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 1001).astype("<u4")
    raw = token_files.pack_bits(ids, bits)
    assert len(raw) == -(-1001 * bits // 8)
    assert (token_files.unpack_bits(raw, bits, 1001) == ids).all()


def test_warc(spark):
    pages = [(i, f"http://x/{i}", f"<p>{i % 7}</p>" * 30) for i in range(40)] + [(50, None, None), (51, "u", ""), (52, "u", "tiny"), (53, "u", "tiny"), (None, "u", "y" * 200), (60, "u\nv", "y" * 200), (None, None, "ü" * 80)]
    table = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    archives = warc_zip.write_archives(table, storage.fresh(spark, "w"), roll_bytes=2000)
    out = warc_zip.read_archives(archives, split_bytes=700, keep_payload=True)
    first = {}
    for i, _, h in pages:
        b = (h or "").encode()
        if i is not None:
            first[b] = min(i, first.get(b, i))
    same, want = Counter((h or "").encode() for _, _, h in pages), []
    for i, _, h in pages:
        b = (h or "").encode()
        again = len(b) >= 100 and same[b] > 1 and b in first and first[b] != i
        want.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first[b] if again else None))
    _same(out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect(), want)
    path = archives.first().path.removeprefix("file://")
    assert zipfile.ZipFile(path).testzip() is None
    assert warc_zip.read_archives(warc_zip.write_archives(table.limit(0), storage.fresh(spark, "w"))).count() == 0


def test_zip64_directory():
    """Sizes and places only in ZIP64 fields, a comment, and bytes before the archive."""
    name, body = b"m", b"stored bytes"
    local = struct.pack("<4sHHHHHIIIHH", b"PK\3\4", 45, 0, 0, 0, 0, zlib.crc32(body), len(body), len(body), 1, 0) + name
    wide = struct.pack("<HHQQQ", 1, 24, len(body), len(body), 0)
    full = 0xFFFFFFFF
    central = struct.pack("<4sHHHHHHIIIHHHHHII", b"PK\1\2", 45, 45, 0, 0, 0, 0, zlib.crc32(body), full, full, 1, len(wide), 0, 0, 0, 0, full) + name + wide
    at = len(local) + len(body)
    end64 = struct.pack("<4sQHHIIQQQQ", b"PK\6\6", 44, 45, 45, 0, 0, 1, 1, len(central), at)
    locator = struct.pack("<4sIQI", b"PK\6\7", 0, at + len(central), 1)
    end = struct.pack("<4sHHHHIIH", b"PK\5\6", 0, 0, 0xFFFF, 0xFFFF, full, full, 5) + b"hello"
    file = pa.BufferReader(local + body + central + end64 + locator + end)
    zip_ = warc_zip.ZipDirectory(file)
    where, n = zip_.stored("m")
    assert zip_.read(where, n) == body
    plain = io.BytesIO()
    with zipfile.ZipFile(plain, "w") as z:
        z.writestr("a/b", b"x" * 10)
    zip_ = warc_zip.ZipDirectory(pa.BufferReader(plain.getvalue()))
    assert zip_.read(*zip_.stored("a/b")) == b"x" * 10
    with pytest.raises(ValueError):
        warc_zip.ZipDirectory(pa.BufferReader(b"nothing of the kind" * 3))


def test_license_scan(spark):
    filler = "quiet rivers carry nothing about terms here"
    files = [
        (1, "a/LICENSE", "Released under the MIT License."),
        (2, "a/x.py", filler),
        (3, "a/b/c/y.py", filler),
        (4, "a/b/LICENSE.txt", "Licensed under the Apache License, Version 2.0. More words follow on this very line."),
        (5, "a/b/z.py", "top\nThis work is licensed under the GNU General Public License, version 3.\n" + filler),
        (6, "q/w.py", filler + " licensed"),
        (7, None, None),
        (8, "top.py", ""),
        (2, "a/x.py", filler),
    ]
    table = spark.createDataFrame(files, "doc_id long, path string, text string").withColumn("license", F.lit("clash"))
    got = {r.doc_id: (r.license, r.basis, r.license_path) for r in license_scan.license_scan(table).collect()}
    assert got == {
        1: ("MIT", "own", "a/LICENSE"),
        2: ("MIT", "inherited", "a/LICENSE"),
        3: ("Apache-2.0", "inherited", "a/b/LICENSE.txt"),
        4: ("Apache-2.0", "own", "a/b/LICENSE.txt"),
        5: ("GPL-3.0", "own", "a/b/z.py"),
        6: (None, None, None),
        7: (None, None, None),
        8: (None, None, None),
    }
    assert license_scan.license_scan(table).count() == len(files)
    assert license_scan.license_scan(table.limit(0)).count() == 0


def test_license_scores(spark):
    """Scores against a dictionary version of the cosine."""
    texts = ["Released under the MIT License.", "licensed under CC BY-NC 4.0 and some more", "Copyright nobody. Plain text", "no match at all"] * 2
    table = spark.createDataFrame([(i, f"d/{i}", t) for i, t in enumerate(texts)], "doc_id long, path string, text string")
    split = lambda t: re.findall(r"[^\s!-/:-@\[-`{-~]+", t.lower())
    known = {w for _, t in license_scan.TEMPLATES for w in split(t)}
    df = Counter(w for t in texts for w in set(split(t)) & known)
    idf = lambda w: np.log((len(texts) + 1) / max(df[w], 1) + 1)
    vector = lambda t: {w: n * idf(w) for w, n in Counter(split(t)).items()}
    norm = lambda v: np.sqrt(sum(x * x for x in v.values()))
    want = {}
    for i, t in enumerate(texts):
        units = [u for u in re.split(r"\n|(?<=[.!?])\s+", t) if re.search(license_scan.TRIGGER, u)]
        scores = [(-sum(x * b.get(w, 0) for w, x in a.items()) / (norm(a) * norm(b)), name) for u in units for name, text in license_scan.TEMPLATES for a, b in [(vector(u), vector(text))]]
        best = min(scores, default=(0, None))
        want[i] = (best[1], round(-best[0], 6)) if -best[0] >= license_scan.THRESHOLD else (None, None)
    got = {r.doc_id: (r.license, r.score) for r in license_scan.license_scan(table).collect()}
    assert got.keys() == want.keys()
    for i, (name, score) in want.items():
        assert got[i][0] == name and (score is None or abs(got[i][1] - score) < 2e-6)


def test_license_scores_do_not_fall_as_the_corpus_grows(spark, tmp_path):
    base = ["This repository is released under the MIT License."] + ["The repository holds quiet rivers and nothing else."] * 19
    scores = []
    for times in (2, 40):
        rows = [(i, x, "en", "s", len(x)) for i, x in enumerate(base * times)]
        spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/{times}/documents.parquet")
        first = queries.op2_license_scan(spark, f"{tmp_path}/{times}").filter("doc_id = 0").first()
        assert first.license == "MIT" and first.basis == "own"
        scores.append(first.score)
    assert abs(scores[0] - scores[1]) < 0.02


def test_near_duplicates_of_symbols_and_long_texts(spark):
    """Texts without a letter are linked by their white-space words; long ones in small blocks of bytes."""
    rnd = random.Random(8)
    long = [f"w{rnd.randrange(5000)}" for _ in range(40_000)]
    near = [list(long) for _ in range(5)]
    for k, words in enumerate(near):
        for p in range(k, 40_000, 400):
            words[p] = f"x{k}"
    rows = [(1, "*** --- { } ;"), (2, "*** --- { } ;"), (3, "*** +++"), (4, "a b c"), *((10 + k, " ".join(w)) for k, w in enumerate(near))]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    before = ngram_jaccard.BLOCK_BYTES
    ngram_jaccard.BLOCK_BYTES = 300_000
    try:
        got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_jaccard.near_duplicates(table).collect()}
    finally:
        ngram_jaccard.BLOCK_BYTES = before
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in near]
    links = [sum(1 for b in sets if b is not a and len(a & b) >= 0.8 * len(a | b)) for a in sets]
    assert got == {1: (1, 1), 2: (1, 1), 3: (3, 0), 4: (4, 0)} | {10 + k: (10, n) for k, n in enumerate(links)} and min(links) > 0


def test_license_files_and_headers(spark):
    """A whole licence file and a header against the full templates."""
    full = dict((len(t), (n, t)) for n, t in license_scan.TEMPLATES)
    longest = {name: text for _, (name, text) in sorted(full.items())}
    files = [(k, f"p{k}/LICENSE", f"{name} text\n\nCopyright (c) 2020 Some Body\n\n" + text.replace(". ", ".\n")) for k, (name, text) in enumerate(sorted(longest.items())) if len(text) > 300]
    head = "/*\n * Copyright 2021 Some Body\n * " + longest["MPL-2.0"].replace(". ", ".\n * ") + "\n */\nint main() { return 0; }\n"
    table = spark.createDataFrame([*files, (100, "q/main.c", head), (101, f"p{min(k for k, *_ in files)}/x.c", "nothing")], "doc_id long, path string, text string")
    got = {r.doc_id: (r.license, r.basis) for r in license_scan.license_scan(table).collect()}
    names = {k: text.split(" text")[0] for k, _, text in files}
    assert len(names) >= 8 and {k: got[k][0] for k in names} == names
    assert got[100] == ("MPL-2.0", "own") and got[101] == (names[min(names)], "inherited")


def test_inheritance_by_brute_force(spark):
    """Random trees against a walk up the directories."""
    rnd = random.Random(6)
    notices = {"MIT": "Released under the MIT License.", "Apache-2.0": "Licensed under the Apache License, Version 2.0.", "CC-BY-4.0": "Licensed under CC BY 4.0."}
    files = []
    for k in range(220):
        folder = [rnd.choice("abc") for _ in range(rnd.randint(0, 5))]
        named = rnd.random() < 0.15
        has = rnd.random() < (0.8 if named else 0.1)
        files.append((k, "/".join([*folder, f"{'LICENSE' if named else 'f'}{k}"]), rnd.choice(sorted(notices)) if has else None))
    table = spark.createDataFrame([(k, p, notices[n] if n else "quiet rivers") for k, p, n in files], "doc_id long, path string, text string")
    got = {r.doc_id: (r.license, r.basis, r.license_path) for r in license_scan.license_scan(table).collect()}
    scores = {r.doc_id: r.score for r in license_scan.license_scan(table).collect()}
    for k, path, own in files:
        if own:
            assert got[k] == (own, "own", path)
            continue
        steps, want = path.split("/")[:-1], (None, None, None)
        for n in range(len(steps), -1, -1):
            here = [(-scores[j], p, name) for j, p, name in files if name and p.split("/")[:-1] == steps[:n] and p.split("/")[-1].startswith("LICENSE")]
            if here:
                _, p, name = min(here)
                want = (name, "inherited", p)
                break
        assert got[k] == want
