"""The dialect end to end, on the golden corpus and small inline tables."""

import pytest

from quillon.sql.engine import Engine
from quillon.sql.parser import Parser, SqlError


@pytest.fixture(scope="module")
def db(spark):
    e = Engine(spark)
    e.register("customers", spark.createDataFrame([(1, "anouk", "north"), (2, "bela", "south"), (3, "arvid", "east")], "id long, name string, region string"))
    orders = spark.createDataFrame([(10, 1, 18.5, "swift delivery", '{"category":"maps","qty":2}'), (11, 2, 6.25, "ordinary", '{"category":"tools","qty":7}'), (12, 1, 40.75, "notes on a lantern", '{"category":"maps","qty":1}')], "id long, customer_id long, total double, note string, metadata string")
    e.register("orders", orders.selectExpr("id", "customer_id", "total", "note", "parse_json(metadata) AS metadata"), analyzer="english")
    e.register("docs", spark.createDataFrame([(1, [1.0, 0.0, 0.0, 0.0]), (2, [0.0, 1.0, 0.0, 0.0]), (3, [0.0, 0.0, 1.0, 0.0])], "id long, embedding array<float>"))
    e.register("w", spark.createDataFrame([("1", "a", 10), ("2", "a", 20), ("3", "a", None), ("4", "b", 5)], "id string, k string, v int"))
    e.register("org", spark.createDataFrame([("top", None), ("l", "top"), ("r", "top"), ("l1", "l")], "id string, parent string"))
    e.register("articles", spark.createDataFrame([("one", "the owl slept", "birds", 2024), ("two", "the owl slept on the roof", "birds", 2024), ("three", "engine tuning", "machines", 2023), ("four", "the owl and engines", "birds", 2023)], "id string, body string, category string, year int"))
    return e


CASES = [
    ("SELECT COUNT(*) FROM orders WHERE customer_id = 1", [(2,)]),
    ("SELECT c.name, o.total FROM customers c JOIN orders o ON o.customer_id = c.id ORDER BY o.id", [("anouk", 18.5), ("bela", 6.25), ("anouk", 40.75)]),
    ("SELECT region, COUNT(*) FROM customers GROUP BY region ORDER BY region", [("east", 1), ("north", 1), ("south", 1)]),
    ("SELECT id, metadata.category, metadata.qty FROM orders ORDER BY id", [(10, "maps", "2"), (11, "tools", "7"), (12, "maps", "1")]),
    ("SELECT id FROM orders SEARCH note FOR 'lanterns'", [(12,)]),
    ("SELECT id FROM orders SEARCH note FOR 'delivery'", [(10,)]),
    ("SELECT id FROM docs NEAREST embedding TO (1, 0, 0, 0) LIMIT 3", [(1,), (2,), (3,)]),
    ("SELECT id FROM docs NEAREST embedding TO (0, 0, 1, 0) USING L2 LIMIT 1", [(3,)]),
    ("SELECT id, v FROM w ORDER BY v, id", [("4", 5), ("1", 10), ("2", 20), ("3", None)]),
    ("SELECT id FROM w ORDER BY v DESC", [("3",), ("2",), ("1",), ("4",)]),
    ("SELECT id, ROW_NUMBER() OVER (PARTITION BY k ORDER BY v DESC, id) FROM w ORDER BY id", [("1", 3), ("2", 2), ("3", 1), ("4", 1)]),
    ("SELECT k, SUM(v), RANK() OVER (ORDER BY SUM(v)) AS r FROM w GROUP BY k ORDER BY k", [("a", 30, 2), ("b", 5, 1)]),
    ("SELECT id, SUM(v) OVER (ORDER BY id ROWS 1 PRECEDING) FROM w ORDER BY id", [("1", 10), ("2", 30), ("3", 20), ("4", 5)]),
    ("SELECT 2 / 3, 5 BETWEEN NULL AND 1, GREATEST(1, NULL), LENGTH('é')", [("0.666666", None, None, 1)]),
    ("SELECT 1 + 1 AS n", [(2,)]),
    ("SELECT AVG(v), ARRAY_AGG(v), CARDINALITY(ARRAY_AGG(v)) FROM w WHERE k = 'a' AND v IS NOT NULL", [("15.000000", [10, 20], 2)]),
    ("WITH RECURSIVE r AS (SELECT id FROM org WHERE parent IS NULL UNION SELECT o.id FROM org o JOIN r ON o.parent = r.id) SELECT id FROM r ORDER BY id", [("l",), ("l1",), ("r",), ("top",)]),
    ("WITH RECURSIVE r(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM r WHERE n < 4) SELECT n FROM r ORDER BY n", [(1,), (2,), (3,), (4,)]),
    ("WITH big AS MATERIALIZED (SELECT * FROM orders WHERE total > 10) SELECT COUNT(*) FROM big", [(2,)]),
    ("SELECT id FROM customers WHERE id NOT IN (SELECT customer_id FROM orders)", [(3,)]),
    ("SELECT name FROM customers c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.customer_id = c.id AND o.total > 40)", [("anouk",)]),
    ("SELECT id FROM customers WHERE name LIKE 'a%' OR NOT id = 3 AND region IN ('south') ORDER BY id", [(1,), (2,), (3,)]),
    ("SELECT id FROM customers UNION ALL SELECT id FROM customers INTERSECT SELECT customer_id FROM orders ORDER BY id", [(1,), (1,), (2,), (2,), (3,)]),
    ("SELECT x, pos FROM UNNEST(ARRAY('p', 'q')) AS u(x, pos) WITH OFFSET", [("p", 1), ("q", 2)]),
    ("SELECT EXTRACT(day, DATE_ADD(TIMESTAMPTZ '2024-01-31', 1, 'month')), DATE_DIFF(TIMESTAMPTZ '2024-02-01', TIMESTAMPTZ '2024-01-31', 'month')", [(2, 1)]),
    ("SELECT * FROM articles SEARCH body FOR 'owl' FACET category", [("category", "birds", 3)]),
    ("SELECT id, HIGHLIGHT(body) AS h FROM articles WHERE year = 2023 SEARCH body FOR 'owl'", [("four", "the <mark>owl</mark> and engines")]),
    ("SELECT a.id, c.name FROM articles a LEFT JOIN customers c ON c.name = a.id SEARCH body FOR '\"owl slept\"'", [("one", None), ("two", None)]),
    ("SELECT CASE k WHEN 'a' THEN 1 ELSE 0 END AS c, COUNT(*) AS n FROM w GROUP BY k HAVING COUNT(*) > 1", [(1, 3)]),
    ("SELECT DISTINCT k FROM w ORDER BY k LIMIT 1 OFFSET 1", [("b",)]),
    ("SELECT WITHIN(POINT(1, 1), BOX(0, 0, 2, 2)), COVERS(BOX(0, 0, 2, 2), POINT(2, 2)), DWITHIN(POINT(0, 0), POINT(0, 1), 200000)", [(True, True, True)]),
]


@pytest.mark.parametrize(("sql", "want"), CASES)
def test_query(db, sql, want):
    got = [tuple(str(x) if type(x).__name__ == "Decimal" and not x == int(x) or type(x).__name__ == "Decimal" and "." in str(x) else (int(x) if type(x).__name__ == "Decimal" else x) for x in r) for r in db.sql(sql).collect()]
    assert got == want


def test_parameters(db):
    assert [r.id for r in db.sql("SELECT id FROM orders WHERE total > $low AND customer_id = $c", {"low": 20.0, "c": 1}).collect()] == [12]
    assert [r.id for r in db.sql("SELECT id FROM docs NEAREST embedding TO $1 LIMIT 1", [[0.0, 1.0, 0.0, 0.0]]).collect()] == [2]


def test_writes(spark):
    e = Engine(spark)
    e.register("t", spark.createDataFrame([(1, "x", 10)], "id long, name string, qty long"), ["id"])
    e.sql("INSERT INTO t (id, name) VALUES (2, 'y'), (3, 'z')")
    e.sql("UPSERT INTO t (id, name) VALUES (1, 'xx'), (4, 'n')")
    e.sql("UPDATE t SET qty = id * 2, name = UPPER(name) WHERE id > 1")
    e.sql("DELETE FROM t WHERE id = 3")
    assert [tuple(r) for r in e.sql("SELECT * FROM t ORDER BY id").collect()] == [(1, "xx", 10), (2, "Y", 4), (4, "N", 8)]
    with pytest.raises(SqlError):
        e.sql("INSERT INTO t (id, name) VALUES (1, 'again')")
    e.sql("CREATE TABLE u PRIMARY KEY (id) AS SELECT id, qty FROM t WHERE qty > 5")
    e.sql("CREATE VIEW v AS SELECT COUNT(*) AS n FROM u")
    assert e.sql("SELECT n FROM v").first()[0] == 2
    assert {r.name for r in e.sql("SHOW TABLES").collect()} == {"t", "u", "v"}
    assert "Scan" in "".join(r.plan for r in e.sql("EXPLAIN SELECT * FROM t").collect())
    e.sql("DROP TABLE u")
    with pytest.raises(SqlError):
        e.table("u")


@pytest.mark.parametrize("bad", ["SELECT a FROM t GROUP BY 1", "SELECT NTILE(2) OVER (ORDER BY a) FROM t", "SELECT a FROM t EXCEPT ALL SELECT a FROM t", "SELECT FROM", "SELECT nothing(1)"])
def test_rejected(db, bad):
    with pytest.raises(SqlError):
        db.sql(bad)


def test_parser_keeps_precedence():
    q = Parser("SELECT a OR b AND NOT c = 1 + 2 * 3").query()
    assert q.body.items[0][0] == ("bin", "OR", ("name", ["a"]), ("bin", "AND", ("name", ["b"]), ("not", ("bin", "=", ("name", ["c"]), ("bin", "+", ("num", "1"), ("bin", "*", ("num", "2"), ("num", "3")))))))
