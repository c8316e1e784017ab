"""Full text, vectors, fusion, facets and the change stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window, functions as F

from quillon.functions import scalar as S, vectors as V
from quillon.plans.registry import Tables, query
from quillon.retrieval import analyze, hybrid, many, nearest as N, postings, search as X, vectorindex as VI

_STORED: dict[tuple, object] = {}


def stored(t: Tables, name: str, build: Callable):
    """An index of a folder's table, built once in an application and read by every query on it."""
    key = (t.spark.sparkContext.applicationId, t.folder, name)
    if key not in _STORED:
        _STORED[key] = build()
    return _STORED[key]


def _index(t: Tables, analyzer: str = "simple") -> postings.Postings:
    return stored(t, f"text-{analyzer}", lambda: postings.Postings.build(t.documents, ("text",), ("doc_id",), analyzer))


def _best(hits: DataFrame, k: int) -> DataFrame:
    return hits.orderBy(F.col("_score").desc(), "doc_id").limit(k)


def _ranked(df, score: str = "_score"):
    order = F.col(score).desc() if score == "_score" else F.col(score)
    return df.select("doc_id", F.row_number().over(Window.orderBy(order, "doc_id")).cast("long").alias("rank"), F.round(score, 5).alias("score"))


_TOKENS = "WITH d AS (SELECT doc_id, lang, source, regexp_extract_all(lower(text), '[\\p{L}\\p{Nd}'']+') AS w FROM documents), s AS (SELECT count_if(len(w) > 0) AS n, sum(len(w)) / count_if(len(w) > 0) AS mean FROM d)"


def _tf(term: str) -> str:
    return f"len(list_filter(w, lambda x: x = '{term}'))"


def _bm25(term: str) -> str:
    df = f"(SELECT count_if(list_contains(w, '{term}')) FROM d)"
    return f"(ln(1 + (n - {df} + 0.5) / ({df} + 0.5)) * {_tf(term)} * 2.2 / ({_tf(term)} + 1.2 * (0.25 + 0.75 * len(w) / mean)))"


@query(f"{_TOKENS} SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, round(score, 5) AS score FROM (SELECT doc_id, {_bm25('the')} + {_bm25('with')} AS score FROM d, s WHERE list_contains(w, 'the') AND list_contains(w, 'with')) ORDER BY score DESC, doc_id LIMIT 20")
def search_and(t: Tables):
    return _ranked(_best(_index(t).matched("the with", typos=False), 20))


@query(f"{_TOKENS}, p AS (SELECT doc_id, w, ' ' || array_to_string(w, ' ') || ' ' AS flat FROM d) SELECT doc_id FROM p WHERE contains(flat, ' to the ')")
def search_phrase(t: Tables):
    return _index(t).matched('"to the"').select("doc_id")


@query(f"{_TOKENS} SELECT doc_id FROM d WHERE len(list_filter(w, lambda x: starts_with(x, 'oron'))) > 0")
def search_prefix(t: Tables):
    return _index(t).matched("oron*", whole=True).select("doc_id")


@query(f"{_TOKENS} SELECT doc_id FROM d WHERE len(list_filter(w, lambda x: damerau_levenshtein(x, 'onder') <= 1)) > 0")
def search_fuzzy(t: Tables):
    return _index(t).matched("onder~1").select("doc_id")


@query(f"{_TOKENS} SELECT doc_id FROM d WHERE list_contains(w, 'license') AND list_contains(w, 'apache')")
def search_typo(t: Tables):
    return _index(t).matched("license apachee").select("doc_id")


@query(f"{_TOKENS} SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, round(score, 5) AS score FROM (SELECT doc_id, {_bm25('license').replace(_tf('license'), '(3.0 * ' + _tf('license') + ')')} AS score FROM d, s WHERE list_contains(w, 'license'))")
def search_weighted(t: Tables):
    return _ranked(_index(t).matched("license", {"text": 3.0}, typos=False))


@query(f"""{_TOKENS}, m AS (SELECT * FROM d WHERE list_contains(w, 'licensed')), c AS (SELECT 'lang' AS facet, lang AS value, count(*) AS count FROM m GROUP BY 2 UNION ALL SELECT 'source', source, count(*) FROM m GROUP BY 2)
SELECT * FROM (SELECT facet, value, count, row_number() OVER (PARTITION BY facet ORDER BY count DESC, value) AS rank FROM c) WHERE rank <= 5""")
def search_facet(t: Tables):
    hits = t.documents.select("doc_id", "lang", "source").join(_index(t).matched("licensed"), "doc_id")
    return X.facet(hits, ["lang", "source"], top=5)


_BOTH = "WITH b AS (SELECT doc_id, regexp_extract_all(lower(source), '[\\p{L}\\p{Nd}'']+') AS a, regexp_extract_all(lower(text), '[\\p{L}\\p{Nd}'']+') AS c FROM documents)"


@query(f"{_BOTH} SELECT doc_id FROM b WHERE (list_contains(a, 'src1') OR list_contains(c, 'src1')) AND (list_contains(a, 'the') OR list_contains(c, 'the'))")
def search_two_columns(t: Tables):
    index = stored(t, "two", lambda: postings.Postings.build(t.documents, ("source", "text"), ("doc_id",)))
    return index.matched("src1 the", {"source": 2.0}, typos=False).select("doc_id")


@query(f"{_TOKENS} SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, round(score, 5) AS score FROM (SELECT doc_id, {_bm25('license')} AS score FROM d, s WHERE list_contains(w, 'license'))")
def search_scan(t: Tables):
    """The same ranking without an index: one pass for statistics, one for scores."""
    return _ranked(X.matched(X.Index(t.documents, ("text",), ("doc_id",)), "license", typos=False))


_STOPS = ", ".join(f"'{w}'" for w in sorted(analyze.STOP_WORDS))
_ENGLISH = _TOKENS.replace("SELECT doc_id, lang, source, regexp", "SELECT doc_id, lang, source, [x FOR x IN regexp").replace("+') AS w FROM", f"+') IF x NOT IN ({_STOPS})] AS w FROM")
#: Words with one stem.
_FORMS = {"licens": "'license', 'licensed', 'licenses', 'licensing'", "public": "'public', 'publics'"}


def _stem_score(stem: str) -> str:
    tf = f"len([x FOR x IN w IF x IN ({_FORMS[stem]})])"
    df = f"(SELECT count_if({tf} > 0) FROM d)"
    return f"(ln(1 + (n - {df} + 0.5) / ({df} + 0.5)) * {tf} * 2.2 / ({tf} + 1.2 * (0.25 + 0.75 * len(w) / mean)))"


@query(f"{_ENGLISH} SELECT doc_id, round(a + b, 5) AS score FROM (SELECT doc_id, {_stem_score('licens')} AS a, {_stem_score('public')} AS b FROM d, s) WHERE a > 0 AND b > 0 ORDER BY a + b DESC, doc_id LIMIT 20")
def search_english(t: Tables):
    return _best(_index(t, "english").matched("licensed public"), 20).select("doc_id", F.round("_score", 5).alias("score"))


@query("SELECT doc_id, regexp_replace(text, '(?<![\\p{L}\\p{Nd}''])((?i)license)(?![\\p{L}\\p{Nd}''])', '[\\1]', 'g') AS marked FROM documents".replace("(?<![\\p{L}\\p{Nd}''])((?i)license)(?![\\p{L}\\p{Nd}''])", "\\b([Ll]icense|LICENSE)\\b"))
def highlight(t: Tables):
    return t.documents.select("doc_id", X.highlight(F.col("text"), ["license"], "[", "]").alias("marked"))


@query()
def snippet(t: Tables):
    hits = t.documents.select("doc_id", "text").join(_index(t).matched("license").select("doc_id"), "doc_id")
    return hits.select("doc_id", X.snippet(F.col("text"), ["license"], 60).alias("cut"))


def _target(t: Tables) -> list[float]:
    return t.embeddings.filter("vec_id = 7").first()["embedding"]


_E = "WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), q AS (SELECT v AS q FROM e WHERE vec_id = 7)"


def _nearest_sql(distance: str, where: str = "true") -> str:
    return f"{_E} SELECT vec_id, row_number() OVER (ORDER BY d, vec_id) AS rank, round(d, 5) AS distance FROM (SELECT vec_id, {distance} AS d FROM e, q WHERE {where}) ORDER BY d, vec_id LIMIT 15"


def _near(t: Tables, metric: str, where=None):
    best = N.nearest(t.embeddings, "embedding", _target(t), ("vec_id",), metric, 15, where)
    return best.select("vec_id", F.row_number().over(Window.orderBy("_distance", "vec_id")).cast("long").alias("rank"), F.round("_distance", 5).alias("distance"))


@query(_nearest_sql("1 - list_cosine_similarity(v, q)").replace("round(d, 5)", "abs(round(d, 5))"))
def nearest_cosine(t: Tables):
    return _near(t, "cosine").withColumn("distance", F.abs("distance"))


@query(_nearest_sql("list_distance(v, q)"))
def nearest_l2(t: Tables):
    return _near(t, "l2")


@query(_nearest_sql("-list_inner_product(v, q)"))
def nearest_ip(t: Tables):
    return _near(t, "inner_product")


@query(_nearest_sql("list_distance(v, q)", "label = 3"))
def nearest_filtered(t: Tables):
    return _near(t, "l2", F.col("label") == 3)


def _exact(t: Tables, k: int = 10) -> DataFrame:
    """Exact neighbours of the query set, in one pass over all vectors."""
    asked = t.embeddings.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("qv"))
    asked = F.broadcast(asked) if t.embeddings.count() <= 1_000_000 else asked
    far = t.embeddings.join(asked, how="cross").select("q", "vec_id", V.distance("cosine", F.col("embedding"), F.col("qv")).alias("_distance"))
    return VI.top(far, "q", ("vec_id",), k)


@query("""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), q AS (SELECT vec_id AS q, v AS qv FROM e WHERE vec_id % 100 = 0)
SELECT q, vec_id, CAST(r AS INTEGER) AS rank FROM (SELECT q, vec_id, row_number() OVER (PARTITION BY q ORDER BY 1 - list_cosine_similarity(v, qv), vec_id) AS r FROM e, q) WHERE r <= 10""")
def nearest_many(t: Tables):
    return _exact(t).select("q", "vec_id", F.col("_rank").cast("int").alias("rank"))


def _recall(t: Tables, index) -> DataFrame:
    """recall@10 of an index for the stated query set, every vector whose id is divisible by 100, all searched at once."""
    asked = t.embeddings.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("q"), "embedding")
    return VI.recall(index.search_many(asked, "q", 10), many.nearest(t.embeddings, "embedding", ("vec_id",), asked, "q"), "q", ("vec_id",))


@query()
def ivf_recall(t: Tables):
    return _recall(t, stored(t, "ivf", lambda: VI.Lists.build(t.embeddings, "embedding", ("vec_id",), lists=16, probes=12)))


@query()
def ivfpq_recall(t: Tables):
    return _recall(t, stored(t, "ivfpq", lambda: VI.Lists.build(t.embeddings, "embedding", ("vec_id",), lists=8, probes=6, subspaces=32)))


@query()
def hnsw_recall(t: Tables):
    return _recall(t, stored(t, "hnsw", lambda: VI.Shards.build(t.embeddings, "embedding", ("vec_id",))))


@query()
def hnsw_i8_recall(t: Tables):
    return _recall(t, stored(t, "hnsw8", lambda: VI.Shards.build(t.embeddings, "embedding", ("vec_id",), quantisation="I8")))


@query(f"{_E} SELECT vec_id, round(v[3] * 2 - v[10], 5) AS ip FROM e WHERE v[3] * 2 - v[10] <> 0 ORDER BY v[3] * 2 - v[10] DESC, vec_id LIMIT 12")
def sparse_nearest(t: Tables):
    sparse = F.struct(F.sequence(F.lit(0), F.size("embedding") - 1).alias("idx"), F.col("embedding").alias("val"))
    rows = t.embeddings.select("vec_id", sparse.alias("s"))
    return N.sparse_nearest(rows, "s", {2: 2.0, 9: -1.0}, ("vec_id",), 12).select("vec_id", F.round(-F.col("_distance"), 5).alias("ip"))


@query(f"{_E} SELECT vec_id, round(v[3] * 2 - v[10], 5) AS ip FROM e WHERE v[3] * 2 - v[10] <> 0 ORDER BY v[3] * 2 - v[10] DESC, vec_id LIMIT 12")
def sparse_lists(t: Tables):
    """By inverted lists: two of the 64 are read."""
    sparse = F.struct(F.sequence(F.lit(0), F.size("embedding") - 1).alias("idx"), F.col("embedding").alias("val"))
    index = stored(t, "sparse", lambda: VI.Sparse.build(t.embeddings.select("vec_id", sparse.alias("s")), "s", ("vec_id",)))
    return index.search({2: 2.0, 9: -1.0}, 12).select("vec_id", F.round(-F.col("_distance"), 5).alias("ip"))


@query(f"""{_TOKENS}, e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), q AS (SELECT v AS q FROM e WHERE vec_id = 7),
h AS (SELECT doc_id, {_bm25('the')} + {_bm25('with')} AS score FROM d, s WHERE list_contains(w, 'the') AND list_contains(w, 'with')),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS a, row_number() OVER (ORDER BY list_distance(v, q), doc_id) AS b FROM h JOIN e ON vec_id = doc_id % (SELECT count(*) FROM e), q)
SELECT doc_id, round(1.0 / (60 + a) + 1.0 / (60 + b), 6) AS score FROM r ORDER BY 1.0 / (60 + a) + 1.0 / (60 + b) DESC, doc_id LIMIT 10""")
def hybrid_rrf(t: Tables):
    n = t.embeddings.count()
    both = _index(t).matched("the with", typos=False).withColumn("vec_id", F.col("doc_id") % n).join(t.embeddings, "vec_id")
    far = V.distance("l2", F.col("embedding"), V.literal(_target(t)))
    return hybrid.fuse_scored(both, ("doc_id",), [-F.col("_score"), far], 10).select("doc_id", F.round("_score", 6).alias("score"))


@query(f"""{_TOKENS}, h AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM (SELECT doc_id, {_bm25('license')} AS score FROM d, s WHERE list_contains(w, 'license')))
SELECT doc_id, rank, quality FROM h LEFT JOIN labels USING (doc_id)""")
def rank_then_join(t: Tables):
    from quillon.operators.relational import rank_join

    ranked = _ranked(_index(t).matched("license", typos=False)).select("doc_id", "rank")
    labels = t.labels.withColumnRenamed("doc_id", "l_doc")
    return rank_join(ranked, labels, F.col("doc_id") == F.col("l_doc"), "left", [F.col("rank")], [F.col("doc_id")]).select("doc_id", "rank", "quality")


_H = f"""{_TOKENS}, h AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM (SELECT doc_id, {_bm25('license')} AS score FROM d, s WHERE list_contains(w, 'license')))"""


def _rank_joined(t: Tables, how: str) -> DataFrame:
    from quillon.operators.relational import rank_join

    ranked = _ranked(_index(t).matched("license", typos=False)).select("doc_id", "rank")
    labels = t.labels.withColumnRenamed("doc_id", "l_doc")
    return rank_join(ranked, labels, F.col("doc_id") == F.col("l_doc"), how, [F.col("rank")], [F.col("l_doc")]).select("doc_id", "l_doc", "rank", "quality")


@query(f"{_H} SELECT h.doc_id, l.doc_id AS l_doc, rank, quality FROM h RIGHT JOIN labels l ON l.doc_id = h.doc_id")
def rank_then_join_right(t: Tables):
    return _rank_joined(t, "right")


@query(f"{_H} SELECT h.doc_id, l.doc_id AS l_doc, rank, quality FROM h FULL JOIN labels l ON l.doc_id = h.doc_id")
def rank_then_join_full(t: Tables):
    return _rank_joined(t, "full")


@query(f"""{_TOKENS}, e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), q AS (SELECT v AS q FROM e WHERE vec_id = 7),
a AS (SELECT doc_id AS id, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM (SELECT doc_id, {_bm25('the')} AS score FROM d, s WHERE list_contains(w, 'the')) ORDER BY r LIMIT 50),
b AS (SELECT vec_id AS id, row_number() OVER (ORDER BY list_distance(v, q), vec_id) AS r FROM e, q ORDER BY r LIMIT 50),
c AS (SELECT vec_id AS id, row_number() OVER (ORDER BY v[3] * 2 - v[10] DESC, vec_id) AS r FROM e WHERE v[3] * 2 - v[10] <> 0 ORDER BY r LIMIT 50)
SELECT id, round(sum(1.0 / (60 + r)), 6) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c) GROUP BY id ORDER BY sum(1.0 / (60 + r)) DESC, id LIMIT 12""")
def fuse_three(t: Tables):
    """Text, dense and sparse channels, each to a depth of 50."""
    text = hybrid.ranks(_index(t).matched("the", typos=False).withColumnRenamed("doc_id", "id"), [F.col("_score").desc()], ("id",), 50)
    dense = N.nearest(t.embeddings, "embedding", _target(t), ("vec_id",), "l2").withColumnRenamed("vec_id", "id")
    rows = t.embeddings.select(F.col("vec_id").alias("id"), F.struct(F.sequence(F.lit(0), F.size("embedding") - 1).alias("idx"), F.col("embedding").alias("val")).alias("s"))
    sparse = N.sparse_nearest(rows, "s", {2: 2.0, 9: -1.0}, ("id",))
    near = [hybrid.ranks(x, [F.col("_distance")], ("id",), 50) for x in (dense, sparse)]
    return hybrid.fuse([text, *near], ("id",), 12).select("id", F.round("_score", 6).alias("score"))


@query("SELECT event_type, time_bucket(INTERVAL 1 DAY, ts) AS day, count(*) AS n FROM events GROUP BY 1, 2")
def events_by_day(t: Tables):
    return t.events.groupBy("event_type", S.date_trunc("day", F.col("ts").cast("timestamp")).cast("timestamp_ntz").alias("day")).agg(F.count(F.lit(1)).alias("n"))
