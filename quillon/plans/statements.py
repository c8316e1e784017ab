"""Writes, definitions, indexes and values of the dialect, each a short script, against DuckDB's SQL."""

from __future__ import annotations

from quillon.plans.dialect import engine
from quillon.plans.registry import ORACLE, QUERIES


def script(name: str, sql: str | None, *statements: str) -> None:
    """Register a query: all statements run, the last one's rows are the result."""

    def run(spark, folder):
        e = engine(spark, folder)
        for s in statements[:-1]:
            e.sql(s)
        return e.sql(statements[-1])

    QUERIES[name] = run
    if sql is not None:
        ORACLE[name] = sql


_CREATE = "CREATE TABLE acct (id INT64 PRIMARY KEY, name STRING NOT NULL, region INT64 DEFAULT 9, bal FLOAT64 CHECK (bal > -100000), note STRING DEFAULT 'none')"
_FILL = "INSERT INTO acct (id, name, region, bal) SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier"

script("stmt_create_insert_returning", "SELECT c_custkey AS id, upper(c_name) AS up, CAST(9 AS BIGINT) AS region, 'none' AS note FROM customer", _CREATE, "INSERT INTO acct (id, name) SELECT c_custkey, c_name FROM customer RETURNING id, UPPER(name) AS up, region, note")
script("stmt_create_as", "SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1", "CREATE TABLE counts PRIMARY KEY (k) AS SELECT c_nationkey AS k, COUNT(*) AS n FROM customer GROUP BY c_nationkey", "SELECT k, n FROM counts")
script("stmt_update_limit_returning", "SELECT s_suppkey AS id, CAST(-1 AS BIGINT) AS region FROM supplier WHERE s_nationkey < 10 ORDER BY s_suppkey LIMIT 7", _CREATE, _FILL, "UPDATE acct SET region = 0 - 1 WHERE region < 10 LIMIT 7 RETURNING id, region")
script("stmt_update_rest", "SELECT s_suppkey AS id, CASE WHEN s_acctbal < 0 THEN s_acctbal * 2 ELSE s_acctbal END AS bal, CASE WHEN s_acctbal < 0 THEN 'debt' ELSE 'none' END AS note FROM supplier", _CREATE, _FILL, "UPDATE acct SET bal = bal * CAST(2 AS FLOAT64), note = 'debt' WHERE bal < 0", "SELECT id, bal, note FROM acct")
script("stmt_delete_limit", "SELECT s_suppkey AS id FROM supplier WHERE s_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0 ORDER BY s_suppkey LIMIT 5)", _CREATE, _FILL, "DELETE FROM acct WHERE bal > 0 LIMIT 5", "SELECT id FROM acct")
script("stmt_delete_returning", "SELECT s_suppkey AS id, s_name AS name FROM supplier WHERE s_nationkey = 3", _CREATE, _FILL, "DELETE FROM acct WHERE region = 3 RETURNING id, name")
script("stmt_upsert_repeated_keys", "SELECT DISTINCT l_suppkey AS id, CAST(max(l_linenumber) OVER (PARTITION BY l_suppkey) AS BIGINT) AS most FROM lineitem", "CREATE TABLE seen (id INT64 PRIMARY KEY, most INT64)", "UPSERT INTO seen (id, most) SELECT l_suppkey, l_linenumber FROM lineitem ORDER BY l_linenumber", "SELECT id, most FROM seen")
script("stmt_upsert_set", "SELECT coalesce(s_suppkey, n_nationkey + 95) AS id, CASE WHEN s_suppkey IS NULL THEN 'new' WHEN n_nationkey IS NULL THEN 'none' ELSE 'none+' || n_name END AS note FROM supplier FULL JOIN nation ON s_suppkey = n_nationkey + 95", _CREATE, _FILL, "UPSERT INTO acct (id, name, note) SELECT n_nationkey + 95, n_name, 'new' FROM nation SET note = CONCAT(note, '+', excluded.name)", "SELECT id, note FROM acct")
script("stmt_upsert_on_unique", "SELECT n_nationkey AS id, n_name AS name, CASE WHEN n_regionkey = 1 THEN n_nationkey + 1000 ELSE n_nationkey END AS v FROM nation", "CREATE TABLE u (id INT64 PRIMARY KEY, name STRING UNIQUE, v INT64)", "INSERT INTO u SELECT n_nationkey, n_name, n_nationkey FROM nation", "UPSERT INTO u (id, name, v) SELECT n_nationkey + 1000, n_name, n_nationkey + 1000 FROM nation WHERE n_regionkey = 1 ON UNIQUE (name) SET v = excluded.v", "SELECT id, name, v FROM u")
script("stmt_alter", "SELECT s_suppkey AS id, s_name AS title, 'e' AS extra FROM supplier", _CREATE, _FILL, "ALTER TABLE acct ADD COLUMN extra STRING NOT NULL DEFAULT 'e'", "ALTER TABLE acct RENAME COLUMN name TO title", "ALTER TABLE acct DROP COLUMN note", "ALTER TABLE acct RENAME TO accounts", "SELECT id, title, extra FROM accounts")
script("stmt_foreign_key_cascade", "SELECT c_custkey AS id, c_nationkey AS nation FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)", "CREATE TABLE lands (id INT64 PRIMARY KEY, region INT64)", "INSERT INTO lands SELECT n_nationkey, n_regionkey FROM nation", "CREATE TABLE people (id INT64 PRIMARY KEY, nation INT64 REFERENCES lands (id) ON DELETE CASCADE)", "INSERT INTO people SELECT c_custkey, c_nationkey FROM customer", "DELETE FROM lands WHERE region = 2", "SELECT id, nation FROM people")
script("stmt_live_view", "SELECT count(*) + 1 AS n FROM nation", "CREATE TABLE lands (id INT64 PRIMARY KEY)", "INSERT INTO lands SELECT n_nationkey FROM nation", "CREATE VIEW inner_v AS SELECT id FROM lands", "CREATE VIEW v AS SELECT COUNT(*) AS n FROM inner_v", "INSERT INTO lands VALUES (1000)", "SELECT n FROM v")
script("stmt_system_columns", "SELECT * FROM (VALUES ('id', CAST(1 AS BIGINT), true, true), ('name', 2, true, false), ('region', 3, false, false), ('bal', 4, false, false), ('note', 5, false, false)) v(column_name, ordinal, not_null, is_primary)", _CREATE, "SELECT column_name, ordinal, not_null, is_primary FROM system.columns WHERE table_name = 'acct'")
script("stmt_analyze", "SELECT 'n_regionkey' AS column, CAST(25 AS BIGINT) AS rows, count(DISTINCT n_regionkey) AS distinct_values FROM nation", "ANALYZE nation", "SELECT column_name AS column, row_count AS rows, distinct_values FROM system.column_stats c JOIN system.table_stats t ON t.table_name = c.table_name WHERE c.table_name = 'nation' AND column_name = 'n_regionkey'")
script("stmt_parameters_none", "SELECT 3 AS a, CAST(NULL AS INTEGER) AS b, true AS c", "SELECT 1 + 2 AS a, CAST(NULL AS INT32) AS b, NULL IS NULL AS c")

_PARTS = "CREATE TABLE ev (kind STRING, id INT64, v FLOAT64, PRIMARY KEY (kind, id)) PARTITION BY LIST (kind) (PARTITION a VALUES IN ('click', 'view'), PARTITION b VALUES IN ('purchase', 'signup', 'login', 'logout', 'search', 'error', 'add_to_cart', 'other'))"
script("part_range", "SELECT o_orderkey AS id, o_totalprice AS price FROM orders WHERE o_orderkey >= 200 AND o_orderkey < 700", "CREATE TABLE o (id INT64 PRIMARY KEY, price FLOAT64) PARTITION BY RANGE (id) (PARTITION a VALUES LESS THAN (500), PARTITION b VALUES LESS THAN (5000), PARTITION c VALUES LESS THAN MAXVALUE)", "INSERT INTO o SELECT o_orderkey, o_totalprice FROM orders", "SELECT id, price FROM o WHERE id >= 200 AND id < 700")
script("part_hash", "SELECT DISTINCT l_orderkey AS o, l_linenumber AS l FROM lineitem WHERE l_orderkey IN (7, 8, 9)", "CREATE TABLE li (o INT64, l INT64, PRIMARY KEY (o, l)) PARTITION BY HASH (o) (PARTITION p0 MODULUS 3 REMAINDER 0, PARTITION p1 MODULUS 3 REMAINDER 1, PARTITION p2 MODULUS 3 REMAINDER 2)", "INSERT INTO li SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem", "SELECT o, l FROM li WHERE o IN (7, 8, 9)")
script("part_list_two_columns", "SELECT n_regionkey AS r, n_nationkey % 2 AS h, n_nationkey AS id FROM nation WHERE n_regionkey = 1 AND n_nationkey % 2 = 0", "CREATE TABLE n (r INT64, h INT64, id INT64, PRIMARY KEY (r, h, id)) PARTITION BY LIST (r, h) (PARTITION a VALUES IN ((0, 0), (1, 0), (2, 0), (3, 0), (4, 0)), PARTITION b VALUES IN ((0, 1), (1, 1), (2, 1), (3, 1), (4, 1)))", "INSERT INTO n SELECT n_regionkey, MOD(n_nationkey, 2), n_nationkey FROM nation", "SELECT r, h, id FROM n WHERE r = 1 AND h = 0")

script("index_covering", "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal BETWEEN 1000 AND 2000", "CREATE INDEX ix ON customer (c_acctbal)", "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal BETWEEN 1000 AND 2000")
script("index_partial", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 200000", "CREATE INDEX ix ON orders (o_totalprice) WHERE o_orderstatus = 'F'", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 200000")
script("index_expression", "SELECT p_partkey, lower(p_brand) AS low FROM part WHERE lower(p_brand) = 'brand#1'", "CREATE INDEX ix ON part (LOWER(p_brand))", "SELECT p_partkey, LOWER(p_brand) AS low FROM part WHERE LOWER(p_brand) = 'brand#1'")
script("index_json_path", "SELECT event_id FROM events WHERE props ->> '$.k' = '5'", "CREATE TABLE j (id INT64 PRIMARY KEY, doc JSON)", "INSERT INTO j SELECT event_id, props FROM events", "CREATE INDEX ix ON j (doc.k)", "SELECT id AS event_id FROM j WHERE doc.k = '5'")
_PLACE = "CREATE TABLE places (id INT64 PRIMARY KEY, at POINT)"
_SPOTS = "INSERT INTO places SELECT c_custkey, POINT(MOD(c_custkey * 37, 360) - 180, MOD(c_custkey * 17, 180) - 90) FROM customer"
_HAV = "2 * 6371008.8 * asin(least(1.0, sqrt(pow(sin(radians(48.85 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(48.85::DOUBLE)) * pow(sin(radians(2.35 - lon) / 2), 2))))"
script("index_spatial_dwithin", f"SELECT c_custkey AS id FROM (SELECT c_custkey, (c_custkey * 37) % 360 - 180.0::DOUBLE AS lon, (c_custkey * 17) % 180 - 90.0::DOUBLE AS lat FROM customer) WHERE {_HAV} <= 2000000", _PLACE, _SPOTS, "CREATE SPATIAL INDEX sp ON places (at)", "SELECT id FROM places WHERE DWITHIN(at, POINT(2.35, 48.85), 2000000)")
script("index_spatial_box", "SELECT c_custkey AS id FROM (SELECT c_custkey, (c_custkey * 37) % 360 - 180 AS lon, (c_custkey * 17) % 180 - 90 AS lat FROM customer) WHERE (lon > 170 OR lon < -170) AND lat > -20 AND lat < 20", _PLACE, _SPOTS, "CREATE SPATIAL INDEX sp ON places (at)", "SELECT id FROM places WHERE WITHIN(at, BOX(170, -20, -170, 20))")
_W = "(SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{Nd}'']+') AS w FROM documents)"
script("index_fulltext_phrase", f"SELECT doc_id FROM {_W} WHERE contains(' ' || array_to_string(w, ' ') || ' ', ' to the ')", "CREATE FULLTEXT INDEX ft ON documents (text)", "SELECT doc_id FROM documents SEARCH text FOR '\"to the\"'")
script("index_fulltext_residual", f"SELECT doc_id FROM {_W} JOIN documents USING (doc_id) WHERE list_contains(w, 'the') AND list_contains(w, 'with') AND lang = 'en'", "CREATE FULLTEXT INDEX ft ON documents (text)", "SELECT doc_id FROM documents WHERE lang = 'en' SEARCH text FOR 'the with'")
script("index_vector_ivf_all", "SELECT vec_id FROM embeddings ORDER BY 1 - list_cosine_similarity(CAST(embedding AS DOUBLE[]), [CAST(1 + i % 3 AS DOUBLE) FOR i IN range(64)]), vec_id LIMIT 9", "CREATE VECTOR INDEX vi ON embeddings (embedding) USING IVF WITH (LISTS = 8, PROBES = 8)", f"SELECT vec_id FROM embeddings NEAREST embedding TO ({', '.join(str(1 + i % 3) for i in range(64))}) LIMIT 9")
script("index_vector_filtered", "SELECT vec_id FROM embeddings WHERE label = 2 ORDER BY 1 - list_cosine_similarity(CAST(embedding AS DOUBLE[]), [CAST(1 + i % 3 AS DOUBLE) FOR i IN range(64)]), vec_id LIMIT 5", "CREATE VECTOR INDEX vi ON embeddings (embedding) USING HNSW", f"SELECT vec_id FROM embeddings WHERE label = 2 NEAREST embedding TO ({', '.join(str(1 + i % 3) for i in range(64))}) LIMIT 5")

script("val_sum_small_floats", "SELECT n_regionkey, CAST(sum(CAST(n_nationkey AS DECIMAL(18,0)) * 0.0000001) AS DOUBLE) AS s, round(CAST(sum(n_nationkey) AS DOUBLE) / count(*) * 0.0000001::DOUBLE, 9) AS a FROM nation GROUP BY 1", "SELECT n_regionkey, CAST(SUM(CAST(n_nationkey AS FLOAT64) * CAST(0.0000001 AS FLOAT64)) AS FLOAT64) AS s, CAST(ROUND(AVG(CAST(n_nationkey AS FLOAT64) * CAST(0.0000001 AS FLOAT64)), 9) AS FLOAT64) AS a FROM nation GROUP BY n_regionkey")
script("val_intervals", "SELECT o_orderkey, CAST(o_orderdate + INTERVAL 1 MONTH + INTERVAL 2 DAY AS TIMESTAMP) AS later, '1 month 2 days' AS shown, true AS same, CAST(epoch_us(o_orderdate) - epoch_us(TIMESTAMP '1995-01-01') AS BIGINT) AS micros FROM orders", "SELECT o_orderkey, o_orderdate + (INTERVAL '1 month' + INTERVAL '2 days') AS later, CAST(INTERVAL '1 month' + INTERVAL '2 days' AS STRING) AS shown, INTERVAL '1 month' = INTERVAL '30 days' AS same, (o_orderdate - TIMESTAMP '1995-01-01 00:00:00').micros AS micros FROM orders")
script("val_json_edit", "SELECT event_id, '{\"a\":{\"b\":\"x\"},\"k\":' || (props ->> '$.k') || '}' AS put, '{}' AS gone, CAST(props ->> '$.k' AS BIGINT) = 5 AS has FROM events", "SELECT event_id, CAST(JSON_SET(props, 'a.b', 'x') AS STRING) AS put, CAST(JSON_REMOVE(props, 'k') AS STRING) AS gone, JSON_CONTAINS(props, '{\"k\":5}') AS has FROM events")
script("val_json_path_array", "SELECT event_id, props ->> '$.k' AS k, props ->> '$.k' AS first FROM events", "CREATE TABLE j (id INT64 PRIMARY KEY, doc JSON)", "INSERT INTO j SELECT event_id, CONCAT('{\"a\":[', JSON_GET(props, 'k'), ',0],\"k\":', JSON_GET(props, 'k'), '}') FROM events", "SELECT id AS event_id, doc.k AS k, j.doc.a.0 AS first FROM j")
script("val_geography", f"SELECT n_nationkey, CAST(round(6371008.8 * radians(n_nationkey + 1.0), 2) AS DOUBLE) AS line, CAST(round(6371008.8 * radians(n_nationkey + 1.0), 2) AS DOUBLE) AS far, n_nationkey + 1 >= 5 AS meets, CAST(5 AS BIGINT) AS n, 'POLYGON' AS kind FROM nation", "SELECT n_nationkey, ROUND(LINELENGTH(LINESTRING(CONCAT('LINESTRING(0 0, 0 ', n_nationkey + 1, ')'))), 2) AS line, ROUND(ST_DISTANCE(ST_GEOGFROMTEXT('POINT(0 0)'), ST_GEOGFROMTEXT(CONCAT('POINT(0 ', n_nationkey + 1, ')'))), 2) AS far, INTERSECTS(LINESTRING(CONCAT('LINESTRING(0 0, 0 ', n_nationkey + 1, ')')), BOX(-1, 5, 1, 6)) AS meets, NPOINTS(POLYGON('POLYGON((0 0, 1 0, 1 1, 0 1, 0 0))')) AS n, GEOMETRYTYPE(POLYGON('POLYGON((0 0, 1 0, 1 1, 0 1, 0 0))')) AS kind FROM nation")
script("val_struct_subscript", "SELECT n_nationkey, n_name AS b, n_regionkey + 1 AS second FROM nation", "SELECT n_nationkey, s.b AS b, a[2] AS second FROM (SELECT n_nationkey, STRUCT(n_regionkey AS a, n_name AS b) AS s, ARRAY(n_regionkey, n_regionkey + 1) AS a FROM nation) q")
script("sort_hidden_key", "SELECT n_name FROM nation ORDER BY n_regionkey DESC, n_nationkey LIMIT 6", "SELECT n_name FROM nation ORDER BY n_regionkey DESC, n_nationkey LIMIT 6")
script("count_min_max", "SELECT count(*) AS n, min(o_orderkey) AS lo, max(o_orderkey) AS hi FROM orders", "SELECT COUNT(*) AS n, MIN(o_orderkey) AS lo, MAX(o_orderkey) AS hi FROM orders")
script("empty_limit", "SELECT n_name FROM nation LIMIT 0", "SELECT n_name FROM nation LIMIT 0")


def _changes(spark, folder):
    """All changes of a table after its first transaction, as SUBSCRIBE has them."""
    from quillon.streaming.changes import COLUMNS, drain

    e = engine(spark, folder)
    e.sql("CREATE TABLE o (id INT64 PRIMARY KEY, status STRING, price FLOAT64)")
    e.sql("INSERT INTO o SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
    first = e.changes.last("o")
    e.sql("UPDATE o SET status = 'Z' WHERE status = 'F'")
    e.sql("DELETE FROM o WHERE status = 'O'")
    out = e._fresh("subscribed")
    drain(e.sql(f"SUBSCRIBE TO o AFTER {first}"), e._fresh("state"), lambda df: df.write.mode("append").parquet(out))
    rows = spark.read.schema(", ".join(f"{c} string" for c in COLUMNS)).parquet(out)
    return rows.selectExpr("operation", "CAST(CAST(unhex(primary_key) AS STRING) AS BIGINT) AS id", "CAST(dense_rank() OVER (ORDER BY CAST(commit_lsn AS BIGINT)) AS BIGINT) AS transaction")


QUERIES["subscribe_changes"] = _changes
ORACLE["subscribe_changes"] = "SELECT 'UPDATE' AS operation, o_orderkey AS id, CAST(1 AS BIGINT) AS transaction FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 'DELETE', o_orderkey, CAST(2 AS BIGINT) FROM orders WHERE o_orderstatus = 'O'"
