"""Statements of the dialect, run by the engine, against DuckDB's own SQL."""

from __future__ import annotations

from quillon.plans.registry import ORACLE, QUERIES
from quillon.sql.engine import Engine

KEYS = {
    "region": ["r_regionkey"], "nation": ["n_nationkey"], "customer": ["c_custkey"], "supplier": ["s_suppkey"], "part": ["p_partkey"], "orders": ["o_orderkey"],
    "lineitem": ["l_orderkey", "l_linenumber"], "events": ["event_id"], "documents": ["doc_id"], "embeddings": ["vec_id"], "labels": ["doc_id"],
}


def engine(spark, folder: str) -> Engine:
    """An engine over a folder of tables."""
    e = Engine(spark)
    for name, pk in KEYS.items():
        e.register(name, spark.read.parquet(f"{folder}/{name}.parquet"), pk)
    return e


#: name: (statement, DuckDB's SQL or None if it is the same)
STATEMENTS = {
    "sql_top_customers": (
        "SELECT c.c_custkey, COUNT(*) AS n, CAST(SUM(o.o_totalprice) AS FLOAT64) AS s FROM customer c JOIN orders o ON o.o_custkey = c.c_custkey WHERE o.o_totalprice BETWEEN 1000 AND 300000 GROUP BY c.c_custkey HAVING COUNT(*) > 5 ORDER BY n DESC, c.c_custkey LIMIT 20",
        "SELECT c_custkey, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(28,6))) AS DOUBLE) AS s FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_totalprice BETWEEN 1000 AND 300000 GROUP BY c_custkey HAVING count(*) > 5 ORDER BY n DESC, c_custkey LIMIT 20",
    ),
    "sql_case_like_in": ("SELECT p_partkey, CASE WHEN p_size > 25 THEN 'big' ELSE 'small' END AS size FROM part WHERE p_type LIKE '%A%' AND p_brand NOT IN ('Brand#1', 'Brand#2') OR p_size = 1", None),
    "sql_window": (
        "SELECT o_orderkey, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) + 0 AS rn, LAG(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS prev FROM orders",
        "SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS rn, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS prev FROM orders",
    ),
    "sql_set_operations": ("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier EXCEPT SELECT n_nationkey FROM nation WHERE n_regionkey = 1", None),
    "sql_subqueries": (
        "SELECT s_suppkey FROM supplier s WHERE s_acctbal > (SELECT AVG(s_acctbal) FROM supplier) AND EXISTS (SELECT 1 FROM lineitem l WHERE l.l_suppkey = s.s_suppkey AND l.l_quantity > 45) AND s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 0)",
        None,
    ),
    "sql_cte": ("WITH a AS (SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey), b AS MATERIALIZED (SELECT n, COUNT(*) AS c FROM a GROUP BY n) SELECT n, c FROM b WHERE c > 1", None),
    "sql_recursive_union": (
        "WITH RECURSIVE r(k) AS (SELECT n_nationkey FROM nation WHERE n_nationkey = 3 UNION SELECT n.n_regionkey * 4 FROM nation n JOIN r ON n.n_nationkey = r.k) SELECT k FROM r",
        None,
    ),
    "sql_functions": (
        "SELECT n_nationkey, UPPER(SUBSTRING(n_name, 1, 3)) AS head, LENGTH(n_name) AS len, COALESCE(NULLIF(n_regionkey, 0), 99) AS r, REPLACE(n_name, 'A', 'a') AS low, GREATEST(n_nationkey, n_regionkey, 7) AS g, MOD(n_nationkey, 4) AS m FROM nation",
        "SELECT n_nationkey, upper(substring(n_name, 1, 3)) AS head, CAST(length(n_name) AS INTEGER) AS len, coalesce(nullif(n_regionkey, 0), 99) AS r, replace(n_name, 'A', 'a') AS low, greatest(n_nationkey, n_regionkey, 7) AS g, n_nationkey % 4 AS m FROM nation",
    ),
    "sql_json": ("SELECT event_id, JSON_GET(props, 'k') AS k, JSON_TYPE(props, 'k') AS t FROM events WHERE event_type = 'click'", "SELECT event_id, props ->> '$.k' AS k, 'number' AS t FROM events WHERE event_type = 'click'"),
    "sql_spatial": (
        "SELECT n_nationkey, ST_AREA(g) AS area, ST_CONTAINS(g, ST_POINT(5, 1)) AS has, ST_NPOINTS(g) AS n, ST_ASTEXT(ST_CENTROID(g)) AS mid, ST_DISTANCE(g, ST_POINT(100, 0)) AS far FROM (SELECT n_nationkey, ST_GEOMFROMTEXT(CONCAT('POLYGON((0 0,', n_nationkey + 2, ' 0,', n_nationkey + 2, ' 2,0 2,0 0))')) AS g FROM nation) p",
        "SELECT n_nationkey, (n_nationkey + 2) * 2.0::DOUBLE AS area, n_nationkey + 2 > 5 AS has, CAST(5 AS BIGINT) AS n, 'POINT(' || CASE WHEN n_nationkey % 2 = 0 THEN CAST((n_nationkey + 2) // 2 AS VARCHAR) ELSE CAST((n_nationkey + 2) / 2.0 AS VARCHAR) END || ' 1)' AS mid, 98.0::DOUBLE - n_nationkey AS far FROM nation",
    ),
    "sql_search_facet": (
        "SELECT * FROM documents SEARCH text FOR 'licensed' FACET lang",
        "SELECT 'lang' AS facet, lang AS value, count(*) AS count FROM documents WHERE list_contains(regexp_extract_all(lower(text), '[\\p{L}\\p{Nd}'']+'), 'licensed') GROUP BY lang",
    ),
    "sql_nearest": (
        "SELECT vec_id, label FROM embeddings WHERE label < 5 NEAREST embedding TO (1, 0, 1, 0, 1, 0, 1, 0, 1, 0, 1, 0, 1, 0, 1, 0, 1, 0, 1, 0, 1, 0, 1, 0, 1, 0, 1, 0, 1, 0, 1, 0, 1, 0, 1, 0, 1, 0, 1, 0, 1, 0, 1, 0, 1, 0, 1, 0, 1, 0, 1, 0, 1, 0, 1, 0, 1, 0, 1, 0, 1, 0, 1, 0) USING L2 LIMIT 8",
        "SELECT vec_id, label FROM embeddings WHERE label < 5 ORDER BY list_distance(CAST(embedding AS DOUBLE[]), [CAST((i + 1) % 2 AS DOUBLE) FOR i IN range(64)]), vec_id LIMIT 8",
    ),
    "sql_hybrid": (
        "SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id SEARCH text FOR 'license'",
        "SELECT d.doc_id, quality FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE list_contains(regexp_extract_all(lower(text), '[\\p{L}\\p{Nd}'']+'), 'license')",
    ),
}

for _name, (_statement, _duck) in STATEMENTS.items():
    QUERIES[_name] = lambda spark, folder, statement=_statement: engine(spark, folder).sql(statement)
    ORACLE[_name] = _duck or _statement
