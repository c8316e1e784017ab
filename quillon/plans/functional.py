"""Scalar functions: strings, numbers, dates, JSON, collections, vectors, geography."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions import geo as G, jsonedit as J, scalar as S, vectors as V
from quillon.plans.registry import Tables, query

_PAD = "chr(160) || ' ' || n_name || chr(9)"


@query(f"""SELECT n_nationkey, lower(n_name) AS lo, upper(n_name) AS up, CAST(length(n_name) AS BIGINT) AS len, n_name AS trimmed,
chr(160) || ' ' || n_name AS rtrimmed, substring(n_name, 2, 3) AS mid, substring(n_name, 4) AS rest, n_name || '-' || n_nationkey AS cat,
replace(n_name, 'A', '*') AS rep, starts_with(n_name, 'A') AS sw, ends_with(n_name, 'A') AS ew, contains(n_name, 'IN') AS has
FROM (SELECT *, {_PAD} AS padded FROM nation)""")
def str_fns(t: Tables):
    n = F.col("n_name")
    pad = F.concat(F.char(F.lit(160)), F.lit(" "), n, F.char(F.lit(9)))
    return t.nation.select(
        "n_nationkey", F.lower(n).alias("lo"), F.upper(n).alias("up"), F.char_length(n).cast("long").alias("len"), S.trim(pad).alias("trimmed"), S.rtrim(pad).alias("rtrimmed"),
        S.substring(n, 2, 3).alias("mid"), S.substring(n, 4).alias("rest"), F.concat(n, F.lit("-"), F.col("n_nationkey").cast("string")).alias("cat"),
        S.replace(n, F.lit("A"), F.lit("*")).alias("rep"), F.startswith(n, F.lit("A")).alias("sw"), F.endswith(n, F.lit("A")).alias("ew"), F.contains(n, F.lit("IN")).alias("has"),
    )


@query("""SELECT s_suppkey, abs(s_acctbal) AS a, CAST(ceil(s_acctbal) AS BIGINT) AS c, CAST(floor(s_acctbal) AS BIGINT) AS f,
CAST(round(CAST(s_acctbal AS DECIMAL(18,2)), 1) AS DOUBLE) AS r, s_suppkey % 7 AS m, -s_acctbal AS neg, CAST(round(sqrt(s_suppkey), 8) AS DOUBLE) AS q,
CAST(s_suppkey * s_suppkey * s_suppkey AS DOUBLE) AS p FROM supplier""")
def math_fns(t: Tables):
    b, k = F.col("s_acctbal"), F.col("s_suppkey")
    return t.supplier.select(
        "s_suppkey", F.abs(b).alias("a"), F.ceil(b).alias("c"), F.floor(b).alias("f"), F.round(S.exact(b, 2, 18), 1).cast("double").alias("r"), S.mod(k, F.lit(7)).cast("long").alias("m"),
        (-b).alias("neg"), S.sqrt(k).cast("double").alias("q"), S.power(k, F.lit(3)).cast("double").alias("p"),
    )


@query("SELECT l_orderkey, l_linenumber, CAST((CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * 100 AS HUGEINT) * 1000000) // CAST(l_quantity AS BIGINT) AS BIGINT) AS unit_e8 FROM lineitem")
def decimal_division(t: Tables):
    q = S.divide(S.exact(F.col("l_extendedprice"), 2, 18), F.col("l_quantity").cast("decimal(20,0)"), 2, 0)
    return t.lineitem.select("l_orderkey", "l_linenumber", (q * 100000000).cast("long").alias("unit_e8"))


@query("SELECT o_orderkey AS k, CASE WHEN o_orderkey % 4 = 0 THEN 'NaN' WHEN o_orderkey % 4 = 1 THEN 'Infinity' WHEN o_orderkey % 4 = 2 THEN '-Infinity' ELSE 'finite' END AS q FROM orders")
def float_division(t: Tables):
    k = F.col("o_orderkey")
    a = F.when(k % 4 == 0, 0.0).when(k % 4 == 2, -F.col("o_totalprice")).otherwise(F.col("o_totalprice"))
    q = S.float_divide(a, F.when(k % 4 == 3, 2.0).otherwise(0.0))
    shown = F.when(k % 4 == 3, F.when(q == a / 2, "finite")).otherwise(q.cast("string"))
    return t.orders.select(k.alias("k"), shown.alias("q"))


@query("""SELECT k, CASE WHEN a IS NULL OR b IS NULL THEN NULL ELSE greatest(a, b) END AS g, CASE WHEN a IS NULL OR b IS NULL THEN NULL ELSE least(a, b) END AS l,
coalesce(a, b, 0) AS c, CASE WHEN a IS NULL OR b IS NULL THEN a ELSE nullif(a, b) END AS n FROM (SELECT c_custkey AS k, CASE WHEN c_custkey % 3 > 0 THEN c_nationkey END AS a, CASE WHEN c_custkey % 5 > 0 THEN c_custkey % 25 END::INTEGER AS b FROM customer)""")
def greatest_null(t: Tables):
    k = F.col("c_custkey")
    v = t.customer.select(k.alias("k"), F.when(k % 3 > 0, F.col("c_nationkey")).alias("a"), F.when(k % 5 > 0, (k % 25).cast("int")).alias("b"))
    a, b = F.col("a"), F.col("b")
    return v.select("k", S.greatest(a, b).alias("g"), S.least(a, b).alias("l"), F.coalesce(a, b, F.lit(0)).alias("c"), S.nullif(a, b).alias("n"))


@query("SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d, hour(o_orderdate) AS h FROM orders")
def date_extract(t: Tables):
    d = F.col("o_orderdate")
    return t.orders.select("o_orderkey", *(S.extract(u, d).alias(a) for u, a in (("year", "y"), ("month", "m"), ("day", "d"), ("hour", "h"))))


@query("SELECT event_id, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS h, CAST(date_trunc('month', ts) AS TIMESTAMP) AS m FROM events")
def date_trunc(t: Tables):
    ts = F.col("ts").cast("timestamp")
    return t.events.select("event_id", S.date_trunc("hour", ts).cast("timestamp_ntz").alias("h"), S.date_trunc("month", ts).cast("timestamp_ntz").alias("m"))


@query("""SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) + INTERVAL 1 MONTH + to_days(CAST(day(o_orderdate) - 1 AS INTEGER)) + (o_orderdate - date_trunc('day', o_orderdate)) AS TIMESTAMP) AS next,
CAST(o_orderdate + INTERVAL 36 HOUR AS TIMESTAMP) AS later FROM orders""")
def date_add(t: Tables):
    d = F.col("o_orderdate").cast("timestamp")
    return t.orders.select("o_orderkey", S.date_add(d, 1, "month").cast("timestamp_ntz").alias("next"), S.date_add(d, 36, "hour").cast("timestamp_ntz").alias("later"))


@query("""SELECT o_orderkey, date_diff('month', TIMESTAMP '1995-01-31', o_orderdate) AS months, date_diff('year', TIMESTAMP '1995-01-31', o_orderdate) AS years,
CAST(trunc((epoch_us(o_orderdate) - epoch_us(TIMESTAMP '1995-01-31 12:00:00')) / 86400000000) AS BIGINT) AS days FROM orders""")
def date_diff(t: Tables):
    d = F.col("o_orderdate")
    start = F.expr("TIMESTAMP_NTZ '1995-01-31 00:00:00'")
    noon = F.expr("TIMESTAMP_NTZ '1995-01-31 12:00:00'")
    return t.orders.select("o_orderkey", S.date_diff(d, start, "month").alias("months"), S.date_diff(d, start, "year").alias("years"), S.date_diff(d, noon, "day").alias("days"))


@query("SELECT o_orderkey, CAST(o_orderdate + INTERVAL 1 MONTH + INTERVAL 2 DAY AS TIMESTAMP) AS x FROM orders")
def interval_add(t: Tables):
    return t.orders.select("o_orderkey", S.add_interval(F.col("o_orderdate").cast("timestamp"), months=1, days=2).cast("timestamp_ntz").alias("x"))


@query("SELECT event_id, CAST(props ->> '$.k' AS BIGINT) AS k, props ->> '$.missing' AS none FROM events")
def json_get(t: Tables):
    v = S.json(F.col("props"))
    return t.events.select("event_id", S.json_get(v, "k", "long").alias("k"), S.json_get(v, "$.missing").alias("none"))


@query("SELECT event_id, lower(json_type(props)) AS t, CASE WHEN json_type(props, '$.k') IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN 'number' ELSE lower(json_type(props, '$.k')) END AS k, lower(json_type(props, '$.nothing')) AS none FROM events")
def json_type(t: Tables):
    v = S.json(F.col("props"))
    return t.events.select("event_id", S.json_type(v).alias("t"), S.json_type(v, "k").alias("k"), S.json_type(v, "nothing").alias("none"))


@query("""SELECT event_id, '{"a":{"b":1},"k":' || (props ->> '$.k') || '}' AS put, '{}' AS gone, CAST(props ->> '$.k' AS BIGINT) = 5 AS has, CAST(2 AS BIGINT) AS n FROM events""")
def json_set(t: Tables):
    p = F.col("props")
    return t.events.select(
        "event_id", J.json_set(p, "a.b", F.lit("1")).alias("put"), J.json_remove(p, "k").alias("gone"), J.json_contains(p, F.lit('{"k":5}')).alias("has"),
        S.json_array_length(S.json(F.lit('{"x":[1,2]}')), "x").alias("n"),
    )


@query("""SELECT n_nationkey, CAST(3 AS BIGINT) AS n, CASE WHEN n_nationkey BETWEEN 1 AND 3 THEN list_extract([10, 20, 30], n_nationkey) END AS at,
n_regionkey IN (1, 2) AS has, true AS has_null FROM nation""")
def coll_array(t: Tables):
    arr = F.array(F.lit(10), F.lit(20), F.lit(30))
    return t.nation.select(
        "n_nationkey", F.cardinality(arr).cast("long").alias("n"), S.element_at(arr, F.col("n_nationkey")).alias("at"),
        S.array_contains(F.array(F.lit(1), F.lit(2), F.lit(None).cast("int")), F.col("n_regionkey")).alias("has"),
        S.array_contains(F.array(F.lit(1), F.lit(None).cast("int")), F.lit(None).cast("int")).alias("has_null"),
    )


@query("SELECT n_nationkey, CAST(2 AS BIGINT) AS n, 'a,b' AS keys, n_name || ',x' AS vals, n_name AS at, true AS has, n_nationkey AS field FROM nation")
def coll_map(t: Tables):
    m = F.create_map(F.lit("b"), F.lit("x"), F.lit("a"), F.col("n_name"))
    s = F.struct(F.col("n_nationkey").alias("k"))
    return t.nation.select(
        "n_nationkey", F.cardinality(m).cast("long").alias("n"), F.array_join(S.map_keys(m), ",").alias("keys"), F.array_join(S.map_values(m), ",").alias("vals"),
        F.try_element_at(m, F.lit("a")).alias("at"), F.map_contains_key(m, F.lit("b")).alias("has"), s["k"].alias("field"),
    )


@query("SELECT c_custkey, unnest(string_split(c_name, '#')) AS item, CAST(generate_subscripts(string_split(c_name, '#'), 1) AS BIGINT) AS pos FROM customer")
def unnest_offset(t: Tables):
    each = t.customer.select("c_custkey", F.posexplode(F.split("c_name", "#")).alias("p", "item"))
    return each.select("c_custkey", "item", (F.col("p") + 1).cast("long").alias("pos"))


@query("""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), q AS (SELECT v AS q FROM e WHERE vec_id = 0)
SELECT vec_id, round(list_cosine_similarity(v, q), 6) AS cosine, round(list_distance(v, q), 6) AS l2, round(list_inner_product(v, q), 6) AS ip,
round(list_sum(list_transform(list_zip(v, q), lambda x: abs(x[1] - x[2]))), 6) AS l1, round(sqrt(list_inner_product(v, v)), 6) AS norm, CAST(len(v) AS BIGINT) AS dim FROM e, q""")
def vec_scalars(t: Tables):
    q = t.embeddings.filter("vec_id = 0").select(F.col("embedding").alias("q"))
    a, b = F.col("embedding"), F.col("q")
    fn = {"cosine": V.cosine(a, b), "l2": V.l2(a, b), "ip": V.dot(a, b), "l1": V.l1(a, b), "norm": V.norm(a)}
    return t.embeddings.crossJoin(F.broadcast(q)).select("vec_id", *(F.round(f, 6).alias(n) for n, f in fn.items()), V.dimensions(a).alias("dim"))


@query("""SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: 1.0 * x * x))) * 3, 4) AS scaled,
round(sqrt(list_sum(list_transform(embedding, lambda x: pow(CAST(x AS DOUBLE) + x * x, 2)))), 3) AS moved, round(list_sum(list_transform(embedding, lambda x: abs(1.0 * x))) / sqrt(list_sum(list_transform(embedding, lambda x: 1.0 * x * x))), 2) AS unit FROM embeddings""")
def vec_build(t: Tables):
    e = F.col("embedding")
    return t.embeddings.select("vec_id", F.round(V.norm(V.scale(e, 3.0)), 4).alias("scaled"), F.round(V.norm(V.subtract(V.add(e, F.transform(e, lambda x: (x.cast("double") * x).cast("float"))), V.scale(e, 0.0))), 3).alias("moved"), F.round(V.l1(V.normalize(e), V.scale(e, 0.0)), 2).alias("unit"))


def _places(t: Tables):
    k = F.col("c_custkey")
    return t.customer.select("c_custkey", G.point((k * 37) % 360 - 180.0, (k * 17) % 180 - 90.0).alias("p"))


_PLACES = "(SELECT c_custkey, (c_custkey * 37) % 360 - 180.0::DOUBLE AS lon, (c_custkey * 17) % 180 - 90.0::DOUBLE AS lat FROM customer)"
_HAVERSINE = "2 * 6371008.8 * asin(least(1.0, sqrt(pow(sin(radians(48.85 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(48.85::DOUBLE)) * pow(sin(radians(2.35 - lon) / 2), 2))))"


@query(f"SELECT c_custkey, CAST(round({_HAVERSINE}, 2) AS DOUBLE) AS metres FROM {_PLACES}")
def geo_distance(t: Tables):
    target = F.struct(F.lit(2.35).alias("lon"), F.lit(48.85).alias("lat"))
    return _places(t).select("c_custkey", F.round(G.distance(F.col("p"), target), 2).alias("metres"))


@query(f"SELECT c_custkey FROM {_PLACES} WHERE {_HAVERSINE} <= 2000000")
def geo_dwithin(t: Tables):
    return _places(t).filter(G.dwithin(F.col("p"), 2.35, 48.85, 2_000_000)).select("c_custkey")


@query(f"SELECT c_custkey, (lon > 170 OR lon < -170) AND lat > -20 AND lat < 20 AS inside, (lon >= 10 AND lon <= 40) AND lat >= 0 AND lat <= 60 AS covered FROM {_PLACES}")
def geo_within_box(t: Tables):
    corner = lambda *v: G.box(*(F.lit(float(x)) for x in v))
    p = F.col("p")
    return _places(t).select("c_custkey", G.within_box(p, corner(170, -20, -170, 20)).alias("inside"), G.within_box(p, corner(10, 0, 40, 60), strict=False).alias("covered"))


_CELL = "least(CAST(floor(({} + {}) / {} * 65536) AS BIGINT), 65535)"


@query(f"""SELECT c_custkey, CAST(list_sum(list_transform(range(16), lambda b: (((x >> b) & 1) << (2 * b)) + (((y >> b) & 1) << (2 * b + 1)))) AS BIGINT) AS cell
FROM (SELECT c_custkey, {_CELL.format('lon', 180, 360)} AS x, {_CELL.format('lat', 90, 180)} AS y FROM {_PLACES})""")
def geo_hash(t: Tables):
    return _places(t).select("c_custkey", G.geohash(F.col("p"), 16).alias("cell"))


@query("""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), q AS (SELECT v AS q FROM e WHERE vec_id = 0)
SELECT vec_id, CAST(len(list_filter(list_zip(v, q), lambda x: (x[1] > 0) <> (x[2] > 0))) AS DOUBLE) AS bits FROM e, q""")
def vec_hamming(t: Tables):
    sign = lambda c: F.transform(c, lambda x: F.when(x > 0, 1.0).otherwise(0.0).cast("float"))
    q = t.embeddings.filter("vec_id = 0").select(F.col("embedding").alias("q"))
    return t.embeddings.crossJoin(F.broadcast(q)).select("vec_id", V.distance("hamming", sign(F.col("embedding")), sign(F.col("q"))).alias("bits"))


@query("""SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: pow(CAST(x AS DOUBLE), 2))), 3) AS whole,
round(list_max(list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE)))) / 127 / 2, 6) AS most FROM embeddings""")
def vec_quantised(t: Tables):
    """Of an I8 vector no element is off by over half a step."""
    e = F.col("embedding")
    step = F.array_max(F.transform(e, lambda x: F.abs(x.cast("double")))) / 127 / 2
    off = F.array_max(F.zip_with(e, V.quantised(e, "I8"), lambda x, y: F.abs(x.cast("double") - y)))
    return t.embeddings.select("vec_id", F.round(V.dot(e, e), 3).alias("whole"), F.when(off <= step * 1.001, F.round(step, 6)).alias("most"))
