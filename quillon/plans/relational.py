"""Scans, joins, aggregates, windows, sorts, set operations, subqueries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from quillon.functions import scalar as S
from quillon.operators import relational as R
from quillon.plans.registry import Tables, query
from quillon.sources.storage import fresh, keep as written
from quillon.sources.tables import Partitioning, bucketed


def money(c) -> F.Column:
    total = S.whole_sum(S.cents(F.col(c) if isinstance(c, str) else c))
    return (total * F.lit("0.01").cast("decimal(2,2)")).cast("double")


# scan, filter, project


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_returnflag = 'R' AND l_quantity < 10")
def scan_filter(t: Tables):
    return t.lineitem.filter("l_shipdate >= TIMESTAMP_NTZ '1996-01-01' AND l_returnflag = 'R' AND l_quantity < 10").select("l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT p_partkey, p_size FROM part WHERE p_size BETWEEN 10 AND 20")
def between(t: Tables):
    return t.part.filter(S.between(F.col("p_size"), F.lit(10), F.lit(20))).select("p_partkey", "p_size")


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderstatus IN ('F', 'P') AND o_orderkey NOT IN (1, 2, 3)")
def in_list(t: Tables):
    return t.orders.filter(F.col("o_orderstatus").isin("F", "P") & ~F.col("o_orderkey").isin(1, 2, 3)).select("o_orderkey", "o_orderpriority")


@query("SELECT p_partkey, p_name, p_type FROM part WHERE p_type LIKE '%A%' AND p_name NOT LIKE '%!_%' ESCAPE '!'")
def like_escape(t: Tables):
    return t.part.filter(S.like(F.col("p_type"), "%A%") & ~S.like(F.col("p_name"), "%!_%", "!")).select("p_partkey", "p_name", "p_type")


@query("SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS class, CASE p_size WHEN 1 THEN 'one' ELSE 'other' END AS simple FROM part")
def case_when(t: Tables):
    size = F.col("p_size")
    return t.part.select("p_partkey", F.when(size < 10, "small").when(size < 30, "medium").otherwise("large").alias("class"), F.when(size == 1, "one").otherwise("other").alias("simple"))


@query("SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS k, CAST(o_totalprice AS BIGINT) AS whole FROM orders WHERE o_totalprice = floor(o_totalprice) OR o_orderkey % 7 = 0 AND NOT (o_custkey > 100)".replace("CAST(o_totalprice AS BIGINT)", "CAST(trunc(o_totalprice) AS BIGINT)"))
def cast_logic(t: Tables):
    o = t.orders.filter((F.col("o_totalprice") == F.floor("o_totalprice")) | (F.col("o_orderkey") % 7 == 0) & ~(F.col("o_custkey") > 100))
    return o.select("o_orderkey", F.col("o_orderkey").cast("string").alias("k"), F.col("o_totalprice").cast("long").alias("whole"))


# joins


@query("SELECT o_orderkey, c_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 5000")
def join_inner(t: Tables):
    c = t.customer.filter("c_acctbal > 5000")
    return t.orders.join(c, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name", "o_totalprice")


@query("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 200000")
def join_left(t: Tables):
    o = t.orders.filter("o_totalprice > 200000")
    return t.customer.join(o, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "o_orderkey")


@query("SELECT s_suppkey, c_custkey FROM (SELECT * FROM supplier WHERE s_acctbal > 3000) s RIGHT JOIN customer ON s_suppkey = c_custkey")
def join_right(t: Tables):
    return t.supplier.filter("s_acctbal > 3000").join(t.customer, F.col("s_suppkey") == F.col("c_custkey"), "right").select("s_suppkey", "c_custkey")


@query("SELECT s_suppkey, c_custkey FROM supplier FULL JOIN (SELECT * FROM customer WHERE c_custkey > 50) c ON s_suppkey = c_custkey")
def join_full(t: Tables):
    return t.supplier.join(t.customer.filter("c_custkey > 50"), F.col("s_suppkey") == F.col("c_custkey"), "full").select("s_suppkey", "c_custkey")


@query("SELECT r_name, n_name FROM region CROSS JOIN nation")
def join_cross(t: Tables):
    return t.region.crossJoin(t.nation).select("r_name", "n_name")


@query("SELECT s.s_suppkey, n.n_nationkey FROM supplier s JOIN nation n ON s.s_nationkey < n.n_nationkey AND s.s_suppkey % 5 = n.n_regionkey")
def join_theta(t: Tables):
    on = (F.col("s_nationkey") < F.col("n_nationkey")) & (F.col("s_suppkey") % 5 == F.col("n_regionkey"))
    return t.supplier.join(t.nation, on).select("s_suppkey", "n_nationkey")


def _theta(t: Tables, how: str):
    """Pairs by inequalities alone; the side of nations is small and fixed."""
    on = (F.col("s_nationkey") < F.col("n_nationkey")) & (F.col("s_acctbal") > 9000)
    return t.supplier.join(F.broadcast(t.nation), on, how).select("s_suppkey", "n_nationkey")


_THETA = "SELECT s_suppkey, n_nationkey FROM supplier {} JOIN nation ON s_nationkey < n_nationkey AND s_acctbal > 9000"


@query(_THETA.format("LEFT"))
def theta_left(t: Tables):
    return _theta(t, "left")


@query(_THETA.format("RIGHT"))
def theta_right(t: Tables):
    return _theta(t, "right")


@query(_THETA.format("FULL"))
def theta_full(t: Tables):
    return _theta(t, "full")


@query("""SELECT n_name, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey
JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE r_name = (SELECT min(r_name) FROM region) GROUP BY n_name""")
def join_multi5(t: Tables):
    first = t.region.agg(F.min("r_name").alias("r_name"))
    geo = t.nation.join(t.region.join(first, "r_name"), F.col("n_regionkey") == F.col("r_regionkey"))
    c = t.customer.join(geo, F.col("c_nationkey") == F.col("n_nationkey"))
    o = t.orders.join(c, F.col("o_custkey") == F.col("c_custkey"))
    return t.lineitem.join(o, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("n_name").agg(money("l_extendedprice").alias("revenue"))


@query("SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def join_self(t: Tables):
    a, b = t.nation.alias("a"), t.nation.alias("b")
    return a.join(b, (F.col("a.n_regionkey") == F.col("b.n_regionkey")) & (F.col("a.n_nationkey") < F.col("b.n_nationkey"))).select(F.col("a.n_name").alias("a"), F.col("b.n_name").alias("b"))


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def semi_exists(t: Tables):
    return t.customer.join(t.orders.filter("o_totalprice > 300000"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("c_custkey")


@query("SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)")
def semi_in(t: Tables):
    return t.part.join(t.lineitem.filter("l_quantity > 49"), F.col("p_partkey") == F.col("l_partkey"), "left_semi").select("p_partkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def anti_not_exists(t: Tables):
    return t.customer.join(t.orders.filter("o_totalprice > 300000"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")


@query("SELECT s_suppkey FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 49 AND l_discount > 0.08)")
def anti_not_in(t: Tables):
    t.supplier.createOrReplaceTempView("q_supplier")
    t.lineitem.createOrReplaceTempView("q_lineitem")
    return t.spark.sql("SELECT s_suppkey FROM q_supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM q_lineitem WHERE l_quantity > 49 AND l_discount > 0.08)")


@query("SELECT count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def join_count(t: Tables):
    return t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).agg(F.count(F.lit(1)).alias("n"))


# aggregates


@query("SELECT count(*) AS n, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS q, min(l_shipdate) AS first, max(l_shipdate) AS last FROM lineitem")
def agg_global(t: Tables):
    return t.lineitem.agg(F.count(F.lit(1)).alias("n"), money("l_quantity").alias("q"), F.min("l_shipdate").alias("first"), F.max("l_shipdate").alias("last"))


@query("SELECT count(*) AS n, count(l_quantity) AS c, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS q, max(l_comment) AS m FROM (SELECT l_quantity, l_returnflag AS l_comment FROM lineitem WHERE l_quantity < 0)")
def agg_global_empty(t: Tables):
    none = t.lineitem.filter("l_quantity < 0")
    return none.agg(F.count(F.lit(1)).alias("n"), F.count("l_quantity").alias("c"), money("l_quantity").alias("q"), F.max("l_returnflag").alias("m"))


@query("""SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS sum_qty,
CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(18,2)))) AS DOUBLE) AS sum_disc
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus""")
def agg_group(t: Tables):
    price, cut = S.cents(F.col("l_extendedprice")), S.cents(F.col("l_discount"))
    total = S.whole_sum(price * (100 - cut)).cast("decimal(34,0)")
    rows = t.lineitem.filter("l_shipdate <= TIMESTAMP_NTZ '1998-09-02'")
    return rows.groupBy("l_returnflag", "l_linestatus").agg(
        F.count(F.lit(1)).alias("n"), money("l_quantity").alias("sum_qty"), (total * F.lit("0.0001").cast("decimal(4,4)")).cast("double").alias("sum_disc")
    )


@query("SELECT year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY year(o_orderdate)")
def agg_expr_key(t: Tables):
    return t.orders.groupBy(S.extract("year", F.col("o_orderdate")).alias("y")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderstatus, CAST(sum(o_orderkey + o_custkey) AS BIGINT) AS s FROM orders GROUP BY o_orderstatus")
def agg_expr_arg(t: Tables):
    return t.orders.groupBy("o_orderstatus").agg(F.sum(F.col("o_orderkey") + F.col("o_custkey")).alias("s"))


@query("SELECT l_returnflag, CASE WHEN count(*) > 1000 THEN 'many' ELSE 'few' END AS size, max(l_quantity) - min(l_quantity) AS spread FROM lineitem GROUP BY l_returnflag")
def agg_in_expr(t: Tables):
    return t.lineitem.groupBy("l_returnflag").agg(F.when(F.count(F.lit(1)) > 1000, "many").otherwise("few").alias("size"), (F.max("l_quantity") - F.min("l_quantity")).alias("spread"))


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12")
def having_alias(t: Tables):
    return t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")).filter("n > 12")


@query("SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_nationkey) AS names, len(array_agg(n_name)) AS n FROM nation GROUP BY n_regionkey")
def array_agg(t: Tables):
    names = S.array_agg(F.col("n_name"), F.col("n_nationkey"))
    return t.nation.groupBy("n_regionkey").agg(F.array_join(names, ",").alias("names"), F.size(names).cast("long").alias("n"))


@query("SELECT n_regionkey, string_agg(n_nationkey || '=' || n_name, ';' ORDER BY n_nationkey) AS pairs FROM nation GROUP BY n_regionkey")
def map_agg(t: Tables):
    m = S.map_agg(F.col("n_nationkey"), F.col("n_name"))
    return t.nation.groupBy("n_regionkey").agg(F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"].cast("string"), F.lit("="), e["value"])), ";").alias("pairs"))


@query("SELECT c_mktsegment, min(c_name) AS lo, max(c_name) AS hi FROM customer GROUP BY c_mktsegment")
def min_max_text(t: Tables):
    return t.customer.groupBy("c_mktsegment").agg(F.min("c_name").alias("lo"), F.max("c_name").alias("hi"))


@query("SELECT event_type, CAST(sum(CAST(value AS DECIMAL(24,10))) AS DOUBLE) AS s, count(value) AS n FROM events GROUP BY event_type")
def sum_exact_decimal(t: Tables):
    return t.events.groupBy("event_type").agg(F.sum(S.exact(F.col("value"), 10, 24)).cast("double").alias("s"), F.count("value").alias("n"))


@query("""SELECT l_suppkey, CAST((CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) * 100 AS HUGEINT) * 1000000) // count(*) AS BIGINT) AS avg_e8
FROM lineitem GROUP BY l_suppkey""")
def avg_truncating(t: Tables):
    avg = S.average(F.col("l_extendedprice"), 2)
    return t.lineitem.groupBy("l_suppkey").agg((avg * 100000000).cast("long").alias("avg_e8"))


@query("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def distinct(t: Tables):
    return t.lineitem.select("l_returnflag", "l_linestatus").distinct()


@query("SELECT o_orderpriority FROM orders GROUP BY o_orderpriority")
def group_without_agg(t: Tables):
    return t.orders.select("o_orderpriority").distinct()


# windows


def _w(*by):
    return Window.partitionBy(*by)


@query("SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders")
def w_row_number(t: Tables):
    return t.orders.select("o_orderkey", F.row_number().over(_w("o_custkey").orderBy(S.desc("o_totalprice"), S.asc("o_orderkey"))).cast("long").alias("rn"))


@query("SELECT l_orderkey, l_linenumber, rank() OVER (PARTITION BY l_orderkey ORDER BY l_quantity NULLS LAST) AS r, dense_rank() OVER (PARTITION BY l_orderkey ORDER BY l_quantity NULLS LAST) AS d FROM lineitem")
def w_rank_dense(t: Tables):
    w = _w("l_orderkey").orderBy(S.asc("l_quantity"))
    return t.lineitem.select("l_orderkey", "l_linenumber", F.rank().over(w).cast("long").alias("r"), F.dense_rank().over(w).cast("long").alias("d"))


@query("SELECT o_orderkey, lag(o_orderkey) OVER w AS prev, lead(o_orderkey, 2, 0) OVER w AS next FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)")
def w_lag_lead_default(t: Tables):
    w = _w("o_custkey").orderBy(S.asc("o_orderkey"))
    return t.orders.select("o_orderkey", F.lag("o_orderkey").over(w).alias("prev"), F.lead("o_orderkey", 2, 0).over(w).alias("next"))


@query("SELECT o_orderkey, first_value(o_orderkey) OVER w AS f, last_value(o_orderkey) OVER w AS l FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)")
def w_first_last(t: Tables):
    w = _w("o_custkey").orderBy(S.asc("o_orderkey"))
    return t.orders.select("o_orderkey", F.first("o_orderkey").over(w).alias("f"), F.last("o_orderkey").over(w).alias("l"))


@query("SELECT l_orderkey, l_linenumber, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS DOUBLE) AS s FROM lineitem")
def w_rows_frame(t: Tables):
    w = _w("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice").rowsBetween(-1, 1)
    return t.lineitem.select("l_orderkey", "l_linenumber", F.sum(S.exact(F.col("l_quantity"), 2, 18)).over(w).cast("double").alias("s"))


@query("SELECT l_orderkey, l_linenumber, count(*) OVER (PARTITION BY l_orderkey ORDER BY l_quantity RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n FROM lineitem")
def w_range_peers(t: Tables):
    w = _w("l_orderkey").orderBy(S.asc("l_quantity")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return t.lineitem.select("l_orderkey", "l_linenumber", F.count(F.lit(1)).over(w).alias("n"))


@query("SELECT c_mktsegment, c_nationkey, count(*) AS n, CAST(sum(count(*)) OVER (PARTITION BY c_mktsegment) AS BIGINT) AS total, rank() OVER (PARTITION BY c_mktsegment ORDER BY count(*) DESC) AS r FROM customer GROUP BY c_mktsegment, c_nationkey")
def w_over_agg(t: Tables):
    g = t.customer.groupBy("c_mktsegment", "c_nationkey").agg(F.count(F.lit(1)).alias("n"))
    return g.select("*", F.sum("n").over(_w("c_mktsegment")).alias("total"), F.rank().over(_w("c_mktsegment").orderBy(S.desc("n"))).cast("long").alias("r"))


@query("SELECT event_id, CAST((CAST(sum(CAST(round(value, 2) AS DECIMAL(18,2))) OVER w * 100 AS HUGEINT) * 1000000) // count(*) OVER w AS BIGINT) AS avg_e8 FROM events WHERE value >= 0 WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)")
def w_moving_avg(t: Tables):
    w = _w("user_id").orderBy("event_id").rowsBetween(-4, 0)
    v = S.exact(F.round("value", 2), 2, 18)
    mean = S.divide(F.sum(v).over(w), F.count(F.lit(1)).over(w).cast("decimal(20,0)"), 2, 0)
    return t.events.filter("value >= 0").select("event_id", (mean * 100000000).cast("long").alias("avg_e8"))


@query("SELECT o_orderkey, min(o_totalprice) OVER (PARTITION BY o_custkey) AS lo, max(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS hi, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) + 1 AS next FROM orders")
def w_min_max_expr(t: Tables):
    w = _w("o_custkey")
    before = w.orderBy("o_orderkey").rowsBetween(Window.unboundedPreceding, -1)
    return t.orders.select(
        "o_orderkey", F.min("o_totalprice").over(w).alias("lo"), F.max("o_totalprice").over(before).alias("hi"), (F.row_number().over(_w("o_orderstatus").orderBy("o_orderkey")) + 1).cast("long").alias("next")
    )


# sort and limit


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def order_topn(t: Tables):
    return t.orders.select("o_orderkey", "o_totalprice").orderBy(S.desc("o_totalprice"), S.asc("o_orderkey")).limit(25)


@query("SELECT c_custkey FROM customer ORDER BY c_acctbal, c_custkey LIMIT 10 OFFSET 15")
def order_offset(t: Tables):
    return t.customer.orderBy(S.asc("c_acctbal"), "c_custkey").select("c_custkey").offset(15).limit(10)


@query("SELECT n_regionkey AS k, count(*) AS n FROM nation GROUP BY n_regionkey ORDER BY 2 DESC, k LIMIT 3")
def order_ordinal_alias(t: Tables):
    return t.nation.groupBy(F.col("n_regionkey").alias("k")).agg(F.count(F.lit(1)).alias("n")).orderBy(S.desc("n"), S.asc("k")).limit(3)


@query("SELECT k, row_number() OVER (ORDER BY v NULLS LAST, k) AS up, row_number() OVER (ORDER BY v DESC NULLS FIRST, k) AS down FROM (SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_acctbal END AS v FROM customer)")
def null_order(t: Tables):
    v = t.customer.select(F.col("c_custkey").alias("k"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_acctbal")).alias("v"))
    return v.select("k", F.row_number().over(Window.orderBy(S.asc("v"), "k")).cast("long").alias("up"), F.row_number().over(Window.orderBy(S.desc("v"), "k")).cast("long").alias("down"))


# set operations


@query("SELECT n_nationkey AS k FROM nation UNION ALL SELECT r_regionkey FROM region")
def union_all(t: Tables):
    return t.nation.select(F.col("n_nationkey").alias("k")).union(t.region.select("r_regionkey"))


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def union(t: Tables):
    return t.customer.select(F.col("c_nationkey").alias("k")).union(t.supplier.select("s_nationkey")).distinct()


@query("SELECT o_custkey AS k FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 8000")
def intersect(t: Tables):
    return t.orders.select(F.col("o_custkey").alias("k")).intersect(t.customer.filter("c_acctbal > 8000").select("c_custkey"))


@query("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 300000")
def except_(t: Tables):
    return t.customer.select(F.col("c_custkey").alias("k")).subtract(t.orders.filter("o_totalprice > 300000").select("o_custkey"))


@query("SELECT n_nationkey AS k FROM nation WHERE n_nationkey < 5 UNION ALL SELECT n_nationkey FROM nation INTERSECT SELECT r_regionkey FROM region")
def setop_precedence(t: Tables):
    n = t.nation.select(F.col("n_nationkey").alias("k"))
    return n.filter("k < 5").union(n.intersect(t.region.select("r_regionkey")))


# CTE and subqueries


@query("WITH a AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey), b AS (SELECT n, count(*) AS c FROM a GROUP BY n) SELECT n, c FROM b WHERE c > 1")
def cte_chain(t: Tables):
    a = t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    return a.groupBy("n").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")


@query("WITH a AS MATERIALIZED (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) SELECT x.o_custkey, x.n FROM a x WHERE x.n = (SELECT max(n) FROM a)")
def cte_materialized(t: Tables):
    a = written(t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")))
    return a.join(F.broadcast(a.agg(F.max("n").alias("n"))), "n").select("o_custkey", "n")


@query("WITH RECURSIVE r(i, v) AS (SELECT 1, CAST(1 AS BIGINT) UNION ALL SELECT i + 1, v * 2 FROM r WHERE i < 12) SELECT CAST(i AS BIGINT) AS i, v FROM r")
def recursive_union_all(t: Tables):
    base = t.spark.range(1).select(F.lit(1).cast("long").alias("i"), F.lit(1).cast("long").alias("v"))
    return R.recursive_union(base, lambda r: r.filter("i < 12").select((F.col("i") + 1).alias("i"), (F.col("v") * 2).alias("v")), False, written)


@query("WITH RECURSIVE e AS (SELECT n_nationkey AS a, (n_nationkey * 7 + 3) % 25 AS b FROM nation), r(k) AS (SELECT 3 UNION SELECT e.b FROM r JOIN e ON e.a = r.k) SELECT CAST(k AS BIGINT) AS k FROM r")
def recursive_union_cycle(t: Tables):
    e = t.nation.select(F.col("n_nationkey").cast("long").alias("a"), ((F.col("n_nationkey") * 7 + 3) % 25).cast("long").alias("b"))
    base = t.spark.range(1).select(F.lit(3).cast("long").alias("k"))
    return R.recursive_union(base, lambda r: r.join(e, F.col("k") == F.col("a")).select(F.col("b").alias("k")), True, written)


@query("SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.8 FROM orders)")
def scalar_subquery(t: Tables):
    mean = t.orders.agg((F.avg("o_totalprice") * 1.8).alias("m"))
    return t.orders.crossJoin(F.broadcast(mean)).filter("o_totalprice > m").select("o_orderkey")


@query("SELECT c_custkey, (SELECT max(o_totalprice) FROM orders WHERE o_custkey = c_custkey) AS top FROM customer")
def correlated_scalar(t: Tables):
    top = t.orders.groupBy("o_custkey").agg(F.max("o_totalprice").alias("top"))
    return t.customer.join(top, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "top")


@query("SELECT k, n FROM (SELECT o_orderstatus AS k, count(*) AS n FROM orders GROUP BY 1) d WHERE n > 10")
def derived_table(t: Tables):
    return t.orders.groupBy(F.col("o_orderstatus").alias("k")).agg(F.count(F.lit(1)).alias("n")).filter("n > 10")


@query("SELECT n_name, c FROM (SELECT n_name, count(*) AS c FROM nation JOIN customer ON n_nationkey = c_nationkey GROUP BY n_name) WHERE c > 50")
def view_over_view(t: Tables):
    t.nation.join(t.customer, F.col("n_nationkey") == F.col("c_nationkey")).createOrReplaceTempView("q_joined")
    t.spark.sql("SELECT n_name, count(*) AS c FROM q_joined GROUP BY n_name").createOrReplaceTempView("q_counted")
    return t.spark.sql("SELECT n_name, c FROM q_counted WHERE c > 50")


# writes, as rewrites of a table


@query("SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN 0.0 ELSE s_acctbal END AS s_acctbal FROM supplier")
def dml_update(t: Tables):
    return R.update(t.supplier.select("s_suppkey", "s_acctbal"), {"s_acctbal": F.lit(0.0)}, F.col("s_acctbal") < 0)


@query("SELECT s_suppkey FROM supplier WHERE NOT coalesce(s_acctbal > 5000, false)")
def dml_delete(t: Tables):
    return R.delete(t.supplier.select("s_suppkey", "s_acctbal"), F.col("s_acctbal") > 5000).select("s_suppkey")


@query("SELECT n_nationkey AS k, n_name AS v FROM nation UNION ALL SELECT r_regionkey + 100, NULL FROM region")
def dml_insert(t: Tables):
    return R.insert(t.nation.select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("v")), t.region.select((F.col("r_regionkey") + 100).alias("k")))


@query("SELECT coalesce(n_nationkey, r_regionkey) AS k, CASE WHEN r_regionkey IS NOT NULL AND n_nationkey IS NOT NULL THEN n_name || '/' || r_name ELSE coalesce(n_name, r_name) END AS v FROM (SELECT * FROM nation WHERE n_nationkey > 2) FULL JOIN region ON n_nationkey = r_regionkey")
def dml_upsert(t: Tables):
    old = t.nation.filter("n_nationkey > 2").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("v"))
    new = t.region.select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("v"))
    return R.upsert(old, new, ["k"], lambda was, excluded: {"v": F.concat(was("v"), F.lit("/"), excluded("v"))})


def _partitioned(t: Tables, p: Partitioning, df: DataFrame) -> DataFrame:
    uri = fresh(t.spark, "partitioned")
    p.write(df, uri)
    return t.spark.read.parquet(uri)


@query("SELECT o_custkey, count(*) AS n, max(l_linenumber) AS most FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_custkey, o_orderkey HAVING count(*) > 5")
def join_bucketed(t: Tables):
    """Join and aggregation bucket by bucket: no exchange."""
    o = bucketed(t.orders.select("o_orderkey", "o_custkey"), "quillon_orders", ["o_orderkey"], 8)
    li = bucketed(t.lineitem.select("l_orderkey", "l_linenumber"), "quillon_lineitem", ["l_orderkey"], 8)
    joined = o.join(li.hint("merge"), F.col("o_orderkey") == F.col("l_orderkey"))
    return joined.groupBy("o_orderkey", "o_custkey").agg(F.count(F.lit(1)).alias("n"), F.max("l_linenumber").alias("most")).filter("n > 5").select("o_custkey", "n", "most")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey BETWEEN 500 AND 620")
def partition_range(t: Tables):
    p = Partitioning("range", "l_partkey", splits=(250, 500, 750, 1000, 1500))
    return p.between(_partitioned(t, p, t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey")), 500, 620).select("l_orderkey", "l_linenumber")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_suppkey = 42")
def partition_hash(t: Tables):
    p = Partitioning("hash", "l_suppkey", parts=8)
    return p.equals(_partitioned(t, p, t.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey")), 42).select("l_orderkey", "l_linenumber")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'A'")
def partition_list(t: Tables):
    p = Partitioning("list", "l_returnflag")
    return p.equals(_partitioned(t, p, t.lineitem.select("l_orderkey", "l_linenumber", "l_returnflag")), "A").select("l_orderkey", "l_linenumber")
