"""From the dialect's syntax tree to Spark SQL text.

Only expressions whose meaning differs from Spark's are rewritten; clauses
map one to one, so Catalyst sees one declarative plan.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import types as T

from quillon.functions import interval
from quillon.functions.geo import EARTH
from quillon.functions.geometry import CONSTRUCTORS, FUNCTIONS, GEOGRAPHY
from quillon.sql.catalog import spark_type
from quillon.sql.parser import Query, Select, SqlError

_AGGREGATES = {"COUNT", "SUM", "AVG", "MIN", "MAX", "ARRAY_AGG", "MAP_AGG"}
_WINDOWS = {"ROW_NUMBER", "RANK", "DENSE_RANK", "LAG", "LEAD", "FIRST_VALUE", "LAST_VALUE"}
_SAME = {"LOWER": "lower", "UPPER": "upper", "LENGTH": "char_length", "CONCAT": "concat", "STARTS_WITH": "startswith", "ENDS_WITH": "endswith", "CONTAINS": "contains", "COALESCE": "coalesce", "ABS": "abs", "CEIL": "ceil", "FLOOR": "floor", "ROUND": "round", "NOW": "current_timestamp", "UUID": "uuid", "ARRAY": "array", "MAP": "map", "MAP_CONTAINS_KEY": "map_contains_key"}
_SPATIAL = {n.upper() for n in (*FUNCTIONS, *CONSTRUCTORS)}
MAX_JSON = 1 << 20
#: Functions on geography shapes, and their other names.
_GEOGRAPHY = {n.upper(): n for n in GEOGRAPHY} | {"BBOX": "Envelope"}
_UNITS = {"YEAR", "MONTH", "DAY", "HOUR", "MINUTE", "SECOND"}


def quote(name: str) -> str:
    return f"`{name.replace('`', '``')}`"


def text(value: str) -> str:
    """A Python string as a Spark SQL literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def unquote(literal: str) -> str:
    return literal[1:-1].replace("''", "'")


class Scope:
    """What the compiler asks the engine.

    ``kind_of(sql, from_sql)`` tells an expression's type, ``resolve(name)``
    a relation's SQL, ``narrowed(compiler, select)`` the SQL of a SELECT's
    first relation if it is less than the whole table; ``special`` has the
    names of JSON and temporal columns, whose expressions need their types
    looked up; ``unique(select)`` tells whether no two rows can be equal.
    """

    def __init__(self, kind_of: Callable, resolve: Callable, narrowed: Callable, spatial: Callable, special: dict[str, set[str]], unique: Callable) -> None:
        self.kind_of, self.resolve, self.narrowed, self.spatial, self.special, self.unique = kind_of, resolve, narrowed, spatial, special, unique


class Compiler:
    """Compiles one statement."""

    def __init__(self, scope: Scope) -> None:
        self.scope = scope
        self.parameters: set[str] = set()
        self.source = ""
        self.ctes: list[str] = []
        self._kinds: dict[tuple[str, str], T.DataType | None] = {}

    def kind_of(self, sql: str) -> T.DataType | None:
        key = (sql, self.source)
        if key not in self._kinds:
            self._kinds[key] = self.scope.kind_of(sql, self.source)
        return self._kinds[key]

    # queries

    def query(self, q: Query) -> str:
        out, known = "", len(self.ctes)
        if q.ctes:
            parts = []
            if q.recursive:
                self.ctes += [n.lower() for n, *_ in q.ctes]
            for name, columns, inner, _ in q.ctes:
                head = quote(name) + (f"({', '.join(map(quote, columns))})" if columns else "")
                parts.append(f"{head} AS ({self.query(inner)})")
                self.ctes.append(name.lower())
            out = f"WITH {'RECURSIVE ' if q.recursive else ''}{', '.join(parts)} "
        out += self.body(q.body) + self.tail(q)
        del self.ctes[known:]
        return out

    def tail(self, q) -> str:
        out = f" ORDER BY {', '.join(map(self.key, q.order))}" if q.order else ""
        if q.limit is not None:
            out += f" LIMIT {self.expr(q.limit)}"
        if q.offset is not None:
            out += f" OFFSET {self.expr(q.offset)}"
        return out

    def body(self, body) -> str:
        if isinstance(body, Query):
            return f"({self.query(body)})"
        if isinstance(body, Select):
            return self.select(body)
        op, every, left, right = body
        return f"{self.body(left)} {op}{' ALL' if every else ''} {self.body(right)}"

    def select(self, s: Select) -> str:
        outer, self.source = self.source, ""
        if s.source is not None:
            narrow = self.scope.narrowed(self, s) if s.source[0] == "table" and s.source[1].lower() not in self.ctes else None
            first = f"{narrow} AS {quote(s.source[2] or s.source[1].split('.')[-1])}" if narrow else self.from_(s.source)
            self.source = " FROM " + first + "".join(self.join(j) for j in s.joins)
        sql = "SELECT " + ("DISTINCT " if s.distinct and not self._keyed(s) else "") + ", ".join(map(self.item, s.items)) + self.source
        for word, clause in (("WHERE", s.where), ("HAVING", s.having)):
            if clause is not None and word == "WHERE":
                sql += f" WHERE {self.expr(clause)}"
        if s.group:
            sql += f" GROUP BY {', '.join(map(self.expr, s.group))}"
        if s.having is not None:
            sql += f" HAVING {self.expr(s.having)}"
        self.source = outer
        return sql

    def _keyed(self, s: Select) -> bool:
        """Whether the rows of a SELECT differ by a key."""
        return s.source is not None and s.source[0] == "table" and s.source[1].lower() not in self.ctes and self.scope.unique(s)

    def from_(self, source: tuple) -> str:
        if source[0] == "table":
            name = source[1].lower()
            return (quote(name) if name in self.ctes else self.scope.resolve(source[1])) + f" AS {quote(source[2] or source[1].split('.')[-1])}"
        if source[0] == "query":
            return f"({self.query(source[1])})" + (f" AS {quote(source[2])}" if source[2] else "")
        _, e, alias, columns, offset = source
        value = quote(columns[0] if columns else alias or "value")
        inner = f"SELECT posexplode({self.expr(e)}) AS (_p, {value})"
        keep = value + (f", CAST(_p + 1 AS BIGINT) AS {quote(columns[1] if len(columns) > 1 else 'offset')}" if offset else "")
        return f"(SELECT {keep} FROM ({inner}))" + (f" AS {quote(alias)}" if alias else "")

    def join(self, join: tuple) -> str:
        kind, source, on = join
        return f" {kind} JOIN {self.from_(source)}" + (f" ON {self.expr(on)}" if on is not None else "")

    def item(self, item: tuple) -> str:
        e, alias = item
        if e[0] == "star":
            return f"{quote(e[1])}.*" if e[1] else "*"
        name = alias or (e[1][-1] if e[0] == "name" and len(e[1]) > 1 else None)
        return self.expr(e) + (f" AS {quote(name)}" if name else "")

    def key(self, key: tuple) -> str:
        e, down = key
        sql = self.expr(e)
        if self._interval_like(e) and interval.is_interval(self.kind_of(sql)):
            sql = interval.justified(sql)
        return sql + (" DESC NULLS FIRST" if down else " ASC NULLS LAST")

    # expressions

    def expr(self, e: tuple) -> str:
        return getattr(self, f"_{e[0]}")(*e[1:])

    def _num(self, v: str) -> str:
        return v if "." not in v and "e" not in v.lower() else f"CAST('{v}' AS DECIMAL({min(38, len(v))},{len(v.split('.')[1]) if 'e' not in v.lower() else 10}))"

    def _str(self, v: str) -> str:
        return text(unquote(v))

    def _blob(self, v: str) -> str:
        return v

    def _param(self, v: str) -> str:
        name = f"p{v[1:]}"
        self.parameters.add(v[1:])
        return f":{name}"

    def _word(self, v: str) -> str:
        return v

    def _name(self, parts: list[str]) -> str:
        for i, p in enumerate(parts[:-1]):
            if i <= 1 and p in self.scope.special["json"]:
                column = ".".join(map(quote, parts[: i + 1]))
                kind = self.kind_of(column)
                if kind is None and i == 0 and len(parts) > 2 and parts[1] in self.scope.special["json"]:
                    continue  # a relation of that name
                if kind is None or isinstance(kind, T.VariantType):
                    path = "".join(f"[{x}]" if x.isdigit() else f".{x}" for x in parts[i + 1 :])
                    return f"try_variant_get({column}, '${path}', 'string')"
        out = ""
        for x in parts:  # a number is a place in an array
            out = f"(CASE WHEN {x} >= 1 THEN get({out}, {x} - 1) END)" if x.isdigit() and out else f"{out}.{quote(x)}" if out else quote(x)
        return out

    def _interval_like(self, e) -> bool:
        """Whether an expression may be an interval or a point in time, by a look at its parts."""
        if isinstance(e, tuple) and e and e[0] == "typed":
            return True
        if isinstance(e, tuple) and e and e[0] == "name":
            return e[1][-1] in self.scope.special["time"]
        if isinstance(e, tuple) and len(e) > 1 and e[0] == "call" and e[1] in ("NOW", "DATE_TRUNC", "DATE_ADD"):
            return True
        if isinstance(e, tuple) and e and e[0] == "cast" and e[2].split("(")[0] in ("INTERVAL", "DATE", "TIMESTAMP", "TIMESTAMPTZ"):
            return True
        return isinstance(e, tuple | list) and any(self._interval_like(x) for x in e)

    def _field(self, e: tuple, part: str) -> str:
        return f"get({self.expr(e)}, {part} - 1)" if part.isdigit() else f"({self.expr(e)}).{quote(part)}"

    def _star(self, _) -> str:
        return "*"

    def _vector(self, items: list) -> str:
        return "array(" + ", ".join(f"CAST({self.expr(i)} AS FLOAT)" for i in items) + ")"

    def _subquery(self, q: Query) -> str:
        return f"({self._nested(q)})"

    def _nested(self, q: Query) -> str:
        outer = self.source
        out = self.query(q)
        self.source = outer
        return out

    def _exists(self, q: Query) -> str:
        return f"EXISTS ({self._nested(q)})"

    def _not(self, e: tuple) -> str:
        return f"(NOT {self.expr(e)})"

    def _neg(self, e: tuple) -> str:
        sql = self.expr(e)
        return interval.negated(sql) if self._interval_like(e) and interval.is_interval(self.kind_of(sql)) else f"(- {sql})"

    def _isnull(self, e: tuple, no: bool) -> str:
        return f"({self.expr(e)} IS {'NOT ' if no else ''}NULL)"

    def _between(self, e, low, high, no) -> str:
        v, a, b = map(self.expr, (e, low, high))
        if self._interval_like(e) and interval.is_interval(self.kind_of(v)):
            v, a, b = map(interval.justified, (v, a, b))
        inside = f"({v} >= {a} AND {v} <= {b})"
        return f"(CASE WHEN {v} IS NULL OR {a} IS NULL OR {b} IS NULL THEN NULL ELSE {'NOT ' if no else ''}{inside} END)"

    def _like(self, e, pattern, escape, no) -> str:
        if escape is not None:
            mark = self.expr(escape)
        else:
            mark = "'\\u0001'"
        return f"({self.expr(e)} {'NOT ' if no else ''}LIKE {self.expr(pattern)} ESCAPE {mark})"

    def _in(self, e, inner, no) -> str:
        values = self._nested(inner[1]) if isinstance(inner, tuple) else ", ".join(map(self.expr, inner))
        return f"({self.expr(e)} {'NOT ' if no else ''}IN ({values}))"

    def _at(self, e, index) -> str:
        c, i = self.expr(e), self.expr(index)
        return f"try_element_at({c}, {i})" if index[0] == "str" else f"(CASE WHEN {i} >= 1 THEN get({c}, CAST({i} - 1 AS INT)) END)"

    def _case(self, subject, arms, other) -> str:
        out = "CASE" + (f" {self.expr(subject)}" if subject is not None else "")
        out += "".join(f" WHEN {self.expr(a)} THEN {self.expr(b)}" for a, b in arms)
        return f"({out}{f' ELSE {self.expr(other)}' if other is not None else ''} END)"

    def _cast(self, e, kind: str) -> str:
        sql, base = self.expr(e), re.match(r"\w+", kind)[0]
        if base == "JSON":
            big = f"octet_length(CAST({sql} AS STRING)) > {MAX_JSON}"
            return f"parse_json(CASE WHEN {big} THEN raise_error('a JSON document holds at most 1 MiB') ELSE {sql} END)" if e[0] != "str" else f"parse_json({sql})"
        if base == "STRING" and self._interval_like(e) and interval.is_interval(self.kind_of(sql)):
            return interval.text(sql)
        if base == "INTERVAL":
            return interval.literal(unquote(e[1])) if e[0] == "str" else sql
        return f"CAST({sql} AS {spark_type(kind)})"

    def _typed(self, word: str, literal: str, unit: str | None) -> str:
        value = unquote(literal)
        if word == "INTERVAL":
            try:
                return interval.literal(f"{value} {unit}" if unit else value)
            except (ValueError, ArithmeticError) as e:
                raise SqlError(str(e)) from None
        return f"{ {'TIMESTAMP': 'TIMESTAMP_NTZ', 'TIMESTAMPTZ': 'TIMESTAMP'}.get(word, word)} {text(value)}"

    def _bin(self, op: str, left, right) -> str:
        a, b = self.expr(left), self.expr(right)
        if op == "/":
            return self._divide(a, b)
        if op not in ("AND", "OR", "*") and (self._interval_like(left) or self._interval_like(right)):
            sql = interval.operation(op, a, b, self.kind_of(a), self.kind_of(b))
            if sql is not None:
                return sql
        return f"({a} {op} {b})"

    def _divide(self, a: str, b: str) -> str:
        """Decimals truncate at ``scale(a) + 6 - scale(b)`` digits; floats follow IEEE."""
        kinds = [self.kind_of(x) for x in (a, b)]
        if any(isinstance(k, T.FloatType | T.DoubleType) for k in kinds):
            zero = f"CASE WHEN {a} IS NULL OR {b} IS NULL THEN NULL WHEN isnan(CAST({a} AS DOUBLE)) OR {a} = 0 THEN double('NaN') WHEN {a} > 0 THEN double('Infinity') ELSE double('-Infinity') END"
            return f"(CASE WHEN {b} = 0 THEN {zero} ELSE {a} / {b} END)"
        if not all(isinstance(k, T.DecimalType | T.IntegralType) for k in kinds):
            return f"({a} / {b})"
        sa, sb = (k.scale if isinstance(k, T.DecimalType) else 0 for k in kinds)
        scale = max(sa + 6 - sb, 0)
        whole = lambda x, s: f"CAST(CAST({x} AS DECIMAL({min(38, 20 + s)},{s})) * CAST('1e{s}' AS DECIMAL({s + 1},0)) AS DECIMAL(32,0))"
        x, y = f"CAST({whole(a, sa)} * CAST(1000000 AS DECIMAL(7,0)) AS DECIMAL(38,0))", whole(b, sb)
        quotient = f"CAST(({x} - {x} % {y}) / {y} AS DECIMAL({36 - scale},0))"
        return f"CAST({quotient} * CAST('1e-{scale}' AS DECIMAL({scale + 1},{scale})) AS DECIMAL(38,{scale}))"

    def _over(self, call, window) -> str:
        by, order, frame = window
        name = call[1]
        if name not in _WINDOWS | _AGGREGATES - {"ARRAY_AGG", "MAP_AGG"}:
            raise SqlError(f"{name} is no window function")
        inside = f"PARTITION BY {', '.join(map(self.expr, by))} " if by else ""
        if order:
            inside += f"ORDER BY {', '.join(map(self.key, order))} "
        if frame:
            if frame[0] == "RANGE" and any(x[0].isdigit() for x in frame[1:]):
                raise SqlError("RANGE frames take no offsets")
            inside += f"{frame[0]} BETWEEN {frame[1]} AND {frame[2]}"
        over = f" OVER ({inside.strip()})"
        if name == "AVG":
            return self._average(self.expr(call[2][0]), over)
        return self.expr(call) + over

    def _floating(self, arg: str) -> bool:
        return isinstance(self.kind_of(arg), T.FloatType | T.DoubleType)

    def _exact(self, arg: str) -> str:
        """Floats as decimals of 18 digits after the point, so that sums are exact and in no order."""
        return f"CAST({arg} AS DECIMAL(38,18))" if self._floating(arg) else arg

    def _average(self, arg: str, over: str = "") -> str:
        """Truncated at six digits more than the argument has; of floats, at 18."""
        count = f"CAST(count({arg}){over} AS DECIMAL(20,0))"
        if not self._floating(arg):
            return self._divide(f"(sum({arg}){over})", count)
        # digits are moved as text: products of such widths would lose some
        scaled = f"CAST(concat(CAST((sum(CAST({arg} AS DECIMAL(38,12))){over}) AS STRING), 'e18') AS DECIMAL(38,0))"
        return f"CAST(concat(CAST(CAST(({scaled} - {scaled} % {count}) / {count} AS DECIMAL(38,0)) AS STRING), 'e-18') AS DECIMAL(38,18))"

    # functions

    def _call(self, name: str, args: list, names: list) -> str:
        if hasattr(self, f"fn_{name}"):
            return getattr(self, f"fn_{name}")(*([args, names] if name == "STRUCT" else args))
        if name.startswith("ST_") and name[3:] in _SPATIAL:
            self.scope.spatial(name[3:])
            return f"{name.lower()}({', '.join(map(self.expr, args))})"
        if name in _GEOGRAPHY:
            return self._geography(_GEOGRAPHY[name], args)
        if name in _SAME or name in _WINDOWS or name in ("MIN", "MAX", "COUNT"):
            return f"{_SAME.get(name, name.lower())}({', '.join(map(self.expr, args))})"
        raise SqlError(f"unknown function {name}")

    def fn_SUM(self, x) -> str:
        return f"sum({self._exact(self.expr(x))})"

    def fn_AVG(self, x) -> str:
        return self._average(self.expr(x))

    def fn_ARRAY_AGG(self, x) -> str:
        return f"(CASE WHEN count(*) > 0 THEN transform(collect_list(struct({self.expr(x)} AS v)), r -> r.v) END)"

    def fn_MAP_AGG(self, k, v) -> str:
        key = self.expr(k)
        checked = f"CASE WHEN {key} IS NULL THEN raise_error('MAP_AGG: null key') ELSE {key} END"
        return f"(CASE WHEN count(*) > 0 THEN map_from_entries(array_sort(collect_list(struct({checked} AS key, {self.expr(v)} AS value)))) END)"

    def _trimmed(self, x, pattern: str) -> str:
        return f"regexp_replace({self.expr(x)}, {text(pattern)}, '')"

    def fn_TRIM(self, x) -> str:
        return self._trimmed(x, r"(?U)^\s+|\s+$")

    def fn_LTRIM(self, x) -> str:
        return self._trimmed(x, r"(?U)^\s+")

    def fn_RTRIM(self, x) -> str:
        return self._trimmed(x, r"(?U)\s+$")

    def fn_SUBSTRING(self, s, start, length=None) -> str:
        a = self.expr(start)
        n = f", {self.expr(length)}" if length else ""
        bad = f"{a} < 1" + (f" OR {self.expr(length)} < 0" if length else "")
        return f"(CASE WHEN {bad} THEN raise_error('SUBSTRING: start must be at least 1 and length not negative') ELSE substring({self.expr(s)}, {a}{n}) END)"

    def fn_REPLACE(self, s, old, new) -> str:
        c, o, n = map(self.expr, (s, old, new))
        return f"(CASE WHEN {o} = '' THEN concat({n}, array_join(transform(filter(split({c}, ''), x -> x <> ''), x -> concat(x, {n})), '')) ELSE replace({c}, {o}, {n}) END)"

    def _extreme(self, fn: str, args) -> str:
        cols = [self.expr(a) for a in args]
        return f"(CASE WHEN {' OR '.join(f'{c} IS NULL' for c in cols)} THEN NULL ELSE {fn}({', '.join(cols)}) END)"

    def fn_GREATEST(self, *args) -> str:
        return self._extreme("greatest", args)

    def fn_LEAST(self, *args) -> str:
        return self._extreme("least", args)

    def fn_NULLIF(self, a, b) -> str:
        x, y = self.expr(a), self.expr(b)
        return f"(CASE WHEN {x} = {y} THEN NULL ELSE {x} END)"

    def fn_MOD(self, a, b) -> str:
        return f"({self.expr(a)} % {self.expr(b)})"

    def fn_SQRT(self, x) -> str:
        v = self.expr(x)
        return f"(CASE WHEN {v} < 0 THEN raise_error('SQRT of a negative number') ELSE CAST(sqrt({v}) AS DECIMAL(38,8)) END)"

    def fn_POWER(self, a, b) -> str:
        v = f"power({self.expr(a)}, {self.expr(b)})"
        return f"(CASE WHEN isnan({v}) OR abs({v}) = double('Infinity') THEN raise_error('POWER is not finite') ELSE CAST({v} AS DECIMAL(38,8)) END)"

    def _unit(self, e) -> str:
        unit = (unquote(e[1]) if e[0] == "str" else e[1][0] if e[0] == "name" else "").upper()
        if unit not in _UNITS:
            raise SqlError(f"unknown unit {unit}")
        return unit

    def fn_EXTRACT(self, unit, ts) -> str:
        return f"CAST(floor(extract({self._unit(unit)} FROM {self.expr(ts)})) AS BIGINT)"

    def fn_DATE_TRUNC(self, unit, ts) -> str:
        return f"date_trunc('{self._unit(unit)}', {self.expr(ts)})"

    def fn_DATE_ADD(self, ts, n, unit) -> str:
        u, t, k = self._unit(unit), self.expr(ts), self.expr(n)
        if u in ("YEAR", "MONTH"):
            months = f"CAST({k} * 12 AS INT)" if u == "YEAR" else f"CAST({k} AS INT)"
            return f"(CAST(date_add(add_months(trunc({t}, 'MONTH'), {months}), day({t}) - 1) AS TIMESTAMP) + ({t} - date_trunc('DAY', {t})))"
        return f"({t} + {k} * INTERVAL '1' {u})"

    def fn_DATE_DIFF(self, a, b, unit) -> str:
        u, x, y = self._unit(unit), self.expr(a), self.expr(b)
        if u == "YEAR":
            return f"CAST(year({x}) - year({y}) AS BIGINT)"
        if u == "MONTH":
            return f"CAST((year({x}) - year({y})) * 12 + month({x}) - month({y}) AS BIGINT)"
        micros = f"(unix_micros(CAST({x} AS TIMESTAMP)) - unix_micros(CAST({y} AS TIMESTAMP)))"
        size = {"DAY": 86_400_000_000, "HOUR": 3_600_000_000, "MINUTE": 60_000_000, "SECOND": 1_000_000}[u]
        return f"({micros} div {size})"

    # JSON

    def _json(self, e) -> str:
        return f"parse_json(CAST({self.expr(e)} AS STRING))"

    def _path(self, e) -> str:
        if e is None:
            return "'$'"
        if e[0] != "str":
            raise SqlError("a JSON path is a string literal")
        parts = [p for p in unquote(e[1]).removeprefix("$").split(".") if p]
        return text("$" + "".join(f"[{p}]" if p.isdigit() else f".{p}" for p in parts))

    def fn_JSON_GET(self, doc, path) -> str:
        return f"try_variant_get({self._json(doc)}, {self._path(path)}, 'string')"

    def fn_JSON_TYPE(self, doc, path=None) -> str:
        at = f"try_variant_get({self._json(doc)}, {self._path(path)}, 'variant')"
        k = f"schema_of_variant({at})"
        return f"(CASE WHEN {at} IS NULL THEN NULL WHEN is_variant_null({at}) THEN 'null' WHEN {k} LIKE 'OBJECT%' THEN 'object' WHEN {k} LIKE 'ARRAY%' THEN 'array' WHEN {k} = 'STRING' THEN 'string' WHEN {k} = 'BOOLEAN' THEN 'boolean' ELSE 'number' END)"

    def fn_JSON_ARRAY_LENGTH(self, doc, path=None) -> str:
        at = f"try_variant_get({self._json(doc)}, {self._path(path)}, 'variant')"
        bad = f"schema_of_variant({at}) NOT LIKE 'ARRAY%'"
        return f"(CASE WHEN {at} IS NULL OR is_variant_null({at}) THEN NULL WHEN {bad} THEN raise_error('JSON_ARRAY_LENGTH: not an array') ELSE CAST(size(CAST({at} AS ARRAY<VARIANT>)) AS BIGINT) END)"

    def _json_value(self, e) -> str:
        """Any value as JSON text under ``v``."""
        return f"to_json(named_struct('v', {self.expr(e)}), map('ignoreNullFields', 'false'))"

    def fn_JSON_SET(self, doc, path, value) -> str:
        self.scope.spatial("JSON_SET")
        return f"parse_json(quillon_json_set(CAST({self.expr(doc)} AS STRING), {self._str(path[1])}, CASE WHEN {self.expr(value)} IS NOT NULL THEN {self._json_value(value)} END))"

    def fn_JSON_REMOVE(self, doc, path) -> str:
        self.scope.spatial("JSON_REMOVE")
        return f"parse_json(quillon_json_remove(CAST({self.expr(doc)} AS STRING), {self._str(path[1])}))"

    def fn_JSON_CONTAINS(self, doc, target) -> str:
        self.scope.spatial("JSON_CONTAINS")
        sql = self.expr(target)
        text_ = sql if isinstance(self.kind_of(sql), T.StringType) else f"CAST({sql} AS STRING)"
        return f"quillon_json_contains(CAST({self.expr(doc)} AS STRING), {text_})"

    # collections

    def fn_STRUCT(self, args, names) -> str:
        return "named_struct(" + ", ".join(f"{text(n or f'f{i + 1}')}, {self.expr(a)}" for i, (a, n) in enumerate(zip(args, names, strict=True))) + ")"

    def fn_CARDINALITY(self, c) -> str:
        return f"CAST(cardinality({self.expr(c)}) AS BIGINT)"

    fn_ARRAY_LENGTH = fn_MAP_SIZE = fn_CARDINALITY

    def fn_ELEMENT_AT(self, c, i) -> str:
        return self._at(c, i)

    def fn_ARRAY_CONTAINS(self, c, v) -> str:
        return f"exists({self.expr(c)}, x -> x <=> {self.expr(v)})"

    def fn_MAP_KEYS(self, m) -> str:
        return f"array_sort(map_keys({self.expr(m)}))"

    def fn_MAP_VALUES(self, m) -> str:
        return f"transform(array_sort(map_entries({self.expr(m)})), e -> e.value)"

    # vectors

    def _total(self, a, b, term: str) -> str:
        return f"aggregate(zip_with({a}, {b}, (x, y) -> {term}), 0D, (s, t) -> s + t)"

    def fn_INNER_PRODUCT(self, a, b) -> str:
        return self._total(self.expr(a), self.expr(b), "double(x) * double(y)")

    fn_DOT = fn_VECTOR_DOT = fn_INNER_PRODUCT

    def fn_L2(self, a, b) -> str:
        return f"sqrt({self._total(self.expr(a), self.expr(b), '(double(x) - y) * (double(x) - y)')})"

    def fn_L1(self, a, b) -> str:
        return self._total(self.expr(a), self.expr(b), "abs(double(x) - y)")

    fn_MANHATTAN = fn_L1

    def fn_VECTOR_NORM(self, a) -> str:
        v = self.expr(a)
        return f"sqrt({self._total(v, v, 'double(x) * double(y)')})"

    fn_NORM = fn_VECTOR_NORM

    def fn_COSINE(self, a, b) -> str:
        size = f"({self.fn_NORM(a)} * {self.fn_NORM(b)})"
        return f"(CASE WHEN {size} = 0 THEN 0D ELSE {self.fn_DOT(a, b)} / {size} END)"

    def fn_COSINE_DISTANCE(self, a, b) -> str:
        return f"(1 - {self.fn_COSINE(a, b)})"

    def fn_VECTOR_DIM(self, a) -> str:
        return f"CAST(size({self.expr(a)}) AS BIGINT)"

    fn_VECTOR_DIMS = fn_DIMENSIONS = fn_VECTOR_DIM

    def fn_VECTOR_NORMALIZE(self, a) -> str:
        n = self.fn_NORM(a)
        return f"(CASE WHEN {n} = 0 THEN raise_error('NORMALIZE of a zero vector') ELSE transform({self.expr(a)}, x -> float(x / {n})) END)"

    fn_NORMALIZE = fn_VECTOR_NORMALIZE

    def fn_VECTOR_ADD(self, a, b) -> str:
        return f"zip_with({self.expr(a)}, {self.expr(b)}, (x, y) -> x + y)"

    def fn_VECTOR_SUBTRACT(self, a, b) -> str:
        return f"zip_with({self.expr(a)}, {self.expr(b)}, (x, y) -> x - y)"

    fn_VECTOR_SUB = fn_VECTOR_SUBTRACT

    def fn_VECTOR_SCALE(self, a, s) -> str:
        return f"transform({self.expr(a)}, x -> float(x * {self.expr(s)}))"

    # geography

    def fn_POINT(self, lon, lat) -> str:
        x, y = self.expr(lon), self.expr(lat)
        return f"(CASE WHEN abs({x}) > 180 OR abs({y}) > 90 THEN raise_error('POINT out of range') ELSE named_struct('lon', double({x}), 'lat', double({y})) END)"

    fn_LOCATION = fn_ST_MAKEPOINT = fn_POINT

    def fn_BOX(self, w, s, e, n) -> str:
        return "named_struct(" + ", ".join(f"'{k}', double({self.expr(v)})" for k, v in zip("wsen", (w, s, e, n), strict=True)) + ")"

    def fn_LON(self, p) -> str:
        return f"({self.expr(p)}).lon"

    def fn_LAT(self, p) -> str:
        return f"({self.expr(p)}).lat"

    fn_LONGITUDE, fn_LATITUDE = fn_LON, fn_LAT

    def _shape(self, e) -> tuple[str, str]:
        """A shape's SQL and what it is: a point, a box, or text."""
        sql = self.expr(e)
        kind = self.kind_of(sql)
        names = kind.names if isinstance(kind, T.StructType) else []
        return sql, "point" if "lon" in names else "box" if "w" in names else "text"

    def _text_of(self, e) -> str:
        sql, kind = self._shape(e)
        if kind == "point":
            return f"concat('GEOGRAPHY SRID=4326;POINT(', ({sql}).lon, ' ', ({sql}).lat, ')')"
        if kind == "text":
            return sql
        ring = lambda w, e: f"'((', {w}, ' ', b.s, ',', {e}, ' ', b.s, ',', {e}, ' ', b.n, ',', {w}, ' ', b.n, ',', {w}, ' ', b.s, '))'"
        one = f"concat('GEOGRAPHY SRID=4326;POLYGON', {ring('b.w', 'b.e')})"
        two = f"concat('GEOGRAPHY SRID=4326;MULTIPOLYGON(', {ring('b.w', '180')}, ',', {ring('-180', 'b.e')}, ')')"
        return f"get(transform(array({sql}), b -> CASE WHEN b.w <= b.e THEN {one} ELSE {two} END), 0)"

    def _geography(self, name: str, args: list) -> str:
        self.scope.spatial(f"GEO_{name.upper()}")
        shapes = GEOGRAPHY[name][1]
        return f"geo_{name.lower()}({', '.join(self._text_of(a) if i < shapes else f'CAST({self.expr(a)} AS DOUBLE)' for i, a in enumerate(args))})"

    def _wkt(self, e, kind: str) -> str:
        self.scope.spatial(f"GEO_AS{kind}")
        return f"geo_as{kind.lower()}({self.expr(e)})"

    def fn_LINESTRING(self, text) -> str:
        return self._wkt(text, "LINESTRING")

    fn_ST_MAKELINE = fn_LINESTRING

    def fn_POLYGON(self, text) -> str:
        return self._wkt(text, "POLYGON")

    fn_ST_MAKEPOLYGON = fn_POLYGON

    def fn_DISTANCE(self, a, b) -> str:
        (p, kp), (q, kq) = self._shape(a), self._shape(b)
        if (kp, kq) != ("point", "point"):
            return self._geography("Distance", [a, b])
        p, q = f"({p})", f"({q})"
        h = f"power(sin(radians({q}.lat - {p}.lat) / 2), 2) + cos(radians({p}.lat)) * cos(radians({q}.lat)) * power(sin(radians({q}.lon - {p}.lon) / 2), 2)"
        return f"(2 * {EARTH}D * asin(least(1D, sqrt({h}))))"

    def fn_DWITHIN(self, a, b, metres) -> str:
        return f"({self.fn_DISTANCE(a, b)} <= {self.expr(metres)})"

    def _inside(self, p, b, over: str, under: str) -> str:
        x, k = f"({self.expr(p)})", f"({self.expr(b)})"
        side = f"CASE WHEN {k}.w <= {k}.e THEN {x}.lon {over} {k}.w AND {x}.lon {under} {k}.e ELSE {x}.lon {over} {k}.w OR {x}.lon {under} {k}.e END"
        return f"(({side}) AND {x}.lat {over} {k}.s AND {x}.lat {under} {k}.n)"

    def _in_box(self, p, b) -> bool:
        return self._shape(p)[1] == "point" and self._shape(b)[1] == "box"

    def fn_WITHIN(self, p, b) -> str:
        return self._geography("Within", [p, b]) if not self._in_box(p, b) else self._inside(p, b, ">", "<")

    def fn_COVERS(self, b, p) -> str:
        return self._geography("Covers", [b, p]) if not self._in_box(p, b) else self._inside(p, b, ">=", "<=")
