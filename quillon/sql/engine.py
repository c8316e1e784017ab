"""The engine: tables with metadata, and ``sql(text, params)``."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from copy import deepcopy
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T
from pyspark.sql.types import VariantType

from quillon.functions import cells, geometry, interval, jsonedit, vectors
from quillon.functions.vectors import literal
from quillon.operators import relational
from quillon.retrieval import hybrid, nearest, postings, search, vectorindex
from quillon.sources import storage
from quillon.sql.catalog import Index, Table
from quillon.sql.compile import Compiler, Scope, quote, unquote
from quillon.sql.definitions import Definitions
from quillon.sql.parser import Parser, Query, Select, SqlError
from quillon.sql.writes import Writes
from quillon.streaming.changes import Log

DEFAULT_K = 10
MAX_VIEWS = 8
#: Rows of a WHERE that a table must have at most for it to be filtered before its vector index is asked.
FILTER_FIRST = 50_000
_WRITES = {"INSERT", "UPSERT", "UPDATE", "DELETE", "ALTER", "CREATE", "DROP", "REBUILD"}


class Engine(Definitions, Writes):
    """Tables, views and indexes of one session, and its change log."""

    def __init__(self, spark: SparkSession) -> None:
        storage.ship(spark)
        self.spark = spark
        self.tables: dict[str, Table] = {}
        self.views: dict[str, tuple[Query, str]] = {}
        self.indexes: dict[str, Index] = {}
        self.changes = Log(spark)
        self.access: list[str] = []  # how the last query reached its tables
        self._functions: set[str] = set()
        self._superseded: list[str] = []
        self._opened: list[str] = []
        self._tag = uuid.uuid4().hex[:8]

    def register(self, name: str, rows: DataFrame, pk: tuple[str, ...] | list[str] = (), analyzer: str = "simple") -> None:
        """Make a DataFrame a table; ``pk`` decides ties of ranked results."""
        self._set(name.lower(), Table(rows, tuple(pk) or (rows.columns[0],), analyzer))

    def _set(self, name: str, table: Table, full: DataFrame | None = None) -> None:
        """Make a version of a table the current one; ``full`` has the partition's number, too."""
        self.tables[name] = table
        if full is None and table.layout is not None and table.uris:
            full = self._read(table.uris, table.rows.schema, table.layout)
        (table.rows if full is None else full).createOrReplaceTempView(self._view(name))

    def _view(self, name: str) -> str:
        return f"t_{self._tag}_{name.lower().replace('.', '_')}"

    def table(self, name: str) -> Table:
        if name.lower() not in self.tables:
            raise SqlError(f"no table {name}")
        return self.tables[name.lower()]

    def vacuum(self) -> None:
        """Delete the files of versions that no table has any more."""
        held = {u for t in self.tables.values() for u in t.uris}
        for uri in set(self._superseded) - held:
            storage.remove(self.spark, uri)
        self._superseded = []

    def stream(self, text: str, params: dict | list | None = None):
        """Rows of a query one by one, a partition at a time in memory."""
        return self.sql(text, params).toLocalIterator(prefetchPartitions=True)

    def prepare(self, text: str) -> Callable[..., DataFrame]:
        """A statement that is parsed now and run with parameters later."""
        p = Parser(text)
        if p.word() in ("SELECT", "WITH", "("):
            q = p.query()
            p.done()
            return lambda params=None: self.run(deepcopy(q), _arguments(params))
        return lambda params=None: self.sql(text, params)

    def _fresh(self, name: str) -> str:
        return storage.fresh(self.spark, name)

    def _keep(self, rows: DataFrame) -> DataFrame:
        return storage.keep(rows)

    # statements

    def sql(self, text: str, params: dict | list | None = None) -> DataFrame:
        """Run one statement. Queries are lazy; writes return their RETURNING or how many rows they wrote."""
        args = _arguments(params)
        p = Parser(text)
        first = p.word()
        run: dict[str, Callable] = {
            "EXPLAIN": self._explain, "CREATE": self._create, "DROP": self._drop, "INSERT": self._insert, "UPSERT": self._upsert, "UPDATE": self._update,
            "DELETE": self._delete, "SHOW": self._show, "ANALYZE": self._analyze, "ALTER": self._alter, "REBUILD": self._rebuild, "SUBSCRIBE": self._subscribe,
        }
        if first not in run:
            q = p.query()
            p.done()
            return self.run(q, args)
        p.at += 1
        if first not in _WRITES:
            return run[first](p, args)
        before = dict(self.tables), dict(self.views), dict(self.indexes)
        try:
            return run[first](p, args)
        except Exception:
            changed = [n for n, t in before[0].items() if self.tables.get(n) is not t]
            self.tables, self.views, self.indexes = before
            for n in changed:  # a statement that fails leaves nothing behind
                self._set(n, self.tables[n])
            raise

    def run(self, q: Query, args: dict) -> DataFrame:
        local = dict(self.tables)
        self.access = [] if not self._opened else self.access
        try:
            q = self._expand(q, args)
            return self._query(q, args)
        finally:
            self.tables = local

    def _expand(self, q: Query, args: dict) -> Query:
        """Give CTEs that Spark cannot run (or must not inline) views of their own."""
        left = []
        for name, columns, inner, kept in q.ctes:
            ranked = self._ranked(inner)
            union = not isinstance(inner.body, Select) and isinstance(inner.body, tuple) and inner.body[0] == "UNION" and not inner.body[1] and q.recursive and _mentions(inner, name)
            if not (kept or ranked or union):
                left.append((name, columns, inner, kept))
                continue
            scope = Query(None, ctes=list(left), recursive=q.recursive)
            if union:
                rows = self._recursive(name, columns, inner, scope, args)
            else:
                rows = self._query(replace(inner, ctes=[*left, *inner.ctes]), args)
                rows = rows.toDF(*columns) if columns else rows
                rows = self._keep(rows) if kept else rows
            self._local(name, rows)
        return replace(q, ctes=left)

    def _local(self, name: str, rows: DataFrame) -> None:
        """A relation of this statement only."""
        unique = f"{name.lower()}__{uuid.uuid4().hex[:8]}"
        rows.createOrReplaceTempView(self._view(unique))
        self.tables[name.lower()] = Table(rows, (rows.columns[0],), statistics={"view": self._view(unique)})

    def _recursive(self, name, columns, inner: Query, scope: Query, args: dict) -> DataFrame:
        _, _, base, step = inner.body
        start = self._query(replace(scope, body=base), args)
        names = columns or start.columns

        def advance(new: DataFrame) -> DataFrame:
            self._local(name, new)
            return self._query(replace(scope, body=step), args).toDF(*names)

        return relational.recursive_union(start.toDF(*names), advance, True, self._keep)

    def _ranked(self, q: Query) -> bool:
        return isinstance(q.body, Select) and bool(q.body.search or q.body.nearest)

    def _expanded_view(self, name: str) -> str:
        """A view's rows as they are now."""
        if name in self._opened:
            raise SqlError(f"view {name} refers to itself")
        if len(self._opened) >= MAX_VIEWS:
            raise SqlError("views are nested too deep")
        self._opened.append(name)
        try:
            rows = self.run(self.views[name][0], {})
        finally:
            self._opened.pop()
        rows.createOrReplaceTempView(view := f"{self._view(name)}_{uuid.uuid4().hex[:8]}")
        return quote(view)

    def _resolve(self, name: str) -> str:
        low = name.lower()
        if low in self.tables:
            table = self.tables[low]
            if table.layout is not None and table.uris:  # without the partition's number
                return f"(SELECT {', '.join(map(quote, table.rows.columns))} FROM {quote(self._view(low))})"
            return quote(table.statistics.get("view", self._view(low)))
        if low in self.views:
            return self._expanded_view(low)
        if low.startswith("system."):
            view = f"{self._view(low)}_{uuid.uuid4().hex[:8]}"
            self._system(low[7:]).createOrReplaceTempView(view)
            return quote(view)
        return quote(name)  # Spark says what is missing

    def _compiler(self, table: str | None = None) -> Compiler:
        """A compiler of a statement, or of expressions on one table."""
        special = {"json": set(), "time": set()}
        for t in self.tables.values():
            for f in t.rows.schema:
                if isinstance(f.dataType, VariantType):
                    special["json"].add(f.name)
                elif isinstance(f.dataType, T.TimestampType | T.TimestampNTZType | T.DateType) or interval.is_interval(f.dataType):
                    special["time"].add(f.name)

        def kind_of(sql: str, source: str) -> T.DataType | None:
            try:
                return self.spark.sql(f"SELECT {sql} AS x{source}").schema[0].dataType
            except Exception:  # noqa: BLE001  outer references and parameters have no type yet
                return None

        out = Compiler(Scope(kind_of, self._resolve, self._narrowed, self._spatial, special, self._unique))
        out.source = f" FROM {quote(self._view(table))} AS {quote(table)}" if table else ""
        return out

    def _spatial(self, name: str) -> None:
        """Register a Python function the first time a statement uses it."""
        if name not in self._functions:
            if name.startswith("JSON_"):
                self.spark.udf.register(f"quillon_{name.lower()}", jsonedit.sql_function(name))
            else:
                self.spark.udf.register(name.lower() if name.startswith("GEO_") else f"st_{name.lower()}", geometry.function(name))
            self._functions.add(name)

    def _query(self, q: Query, args: dict) -> DataFrame:
        if self._ranked(q):
            return self._rank(q, args)
        compiler = self._compiler()
        return self._spark(compiler.query(q), compiler, args)

    def _spark(self, sql: str, compiler: Compiler, args: dict) -> DataFrame:
        missing = compiler.parameters - set(args)
        if missing:
            raise SqlError(f"no value for ${sorted(missing)[0]}")
        return self.spark.sql(sql, args={f"p{k}": args[k] for k in compiler.parameters})

    def _value(self, e: tuple, args: dict):
        """The value of a constant expression."""
        if e[0] == "param":
            return args[e[1][1:]]
        if e[0] == "str":
            return unquote(e[1])
        compiler = self._compiler()
        return self._spark(f"SELECT {compiler.expr(e)} AS x", compiler, args).first()[0]

    # indexes

    def _built(self, index: Index) -> Index:
        """The index with its side table, written if it is not there or stale."""
        if index.data is not None:
            return index
        table = self.table(index.table)
        rows = table.rows
        if index.kind == "FULLTEXT":
            data = postings.Postings.build(rows, index.columns, table.pk, index.option("ANALYZER", table.analyzer))
        elif index.kind == "SPATIAL":
            data = cells.Cells.build(rows, index.columns[0])
        elif index.kind == "VECTOR":
            column, metric = index.columns[0], index.option("METRIC", "cosine").lower()
            if index.using == "SPARSE":
                data = vectorindex.Sparse.build(rows, column, table.pk)
            elif index.using == "HNSW":
                data = vectorindex.Shards.build(rows, column, table.pk, metric, index.option("QUANTIZATION", "NONE"))
            else:
                data = vectorindex.Lists.build(rows, column, table.pk, metric, int(index.option("LISTS")), index.option("PROBES"), index.option("SUBSPACES") if index.using == "IVFPQ" else None)
        else:
            data = self._sorted_index(index, table)
        index = replace(index, data=data)
        self.indexes[index.name] = index
        return index

    def _sorted_index(self, index: Index, table: Table) -> tuple[str, T.StructType]:
        """Keys, included columns and primary key of the rows that WHERE admits, sorted by key."""
        compiler = self._compiler(index.table)
        names = list(dict.fromkeys((*index.columns, *index.include, *table.pk)))
        shown = {c: compiler.expr(k) for c, k in zip(index.columns, index.keys, strict=True)}
        where = f" WHERE {compiler.expr(index.where)}" if index.where is not None else ""
        items = ", ".join(f"{shown.get(c, quote(c))} AS {quote(c)}" for c in names)
        rows = self._spark(f"SELECT {items} FROM {quote(self._view(index.table))} AS {quote(index.table)}{where}", compiler, {})
        uri = self._fresh("index")
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        rows.repartitionByRange(parts, *index.columns).sortWithinPartitions(*index.columns).write.parquet(uri)
        return uri, rows.schema

    def _stale(self, name: str) -> None:
        """Side tables of a table that was rewritten are made again when they are needed."""
        self.indexes = {k: replace(i, data=None) if i.table == name else i for k, i in self.indexes.items()}

    def _extend(self, name: str, new: DataFrame) -> None:
        """Rows were added: postings are added, other side tables become stale."""
        for k, i in self.indexes.items():
            if i.table == name and i.kind == "FULLTEXT" and i.data is not None:
                i.data.add(new)
            elif i.table == name:
                self.indexes[k] = replace(i, data=None)

    def _narrowed(self, compiler: Compiler, s: Select) -> str | None:
        """Partitions that WHERE leaves, or an index that covers the query, in place of the table."""
        name = s.source[1].lower()
        table = self.tables.get(name)
        if table is None or s.where is None or "view" in table.statistics:
            return None
        alias = s.source[2] or name
        parts = _conjuncts(s.where)
        if table.layout is not None and table.uris and (hit := self._partitions(table, alias, parts)) is not None:
            kept = [table.layout.partitions[k].name for k in hit]
            self.access.append(f"{name} partitions=[{', '.join(kept)}]")
            test = f"_part IN ({', '.join(map(str, hit))})" if hit else "FALSE"
            return f"(SELECT {', '.join(map(quote, table.rows.columns))} FROM {quote(self._view(name))} WHERE {test})"
        if s.joins:
            return None
        return self._cell_scan(name, alias, parts) or self._index_scan(name, table, alias, s, parts)

    def _unique(self, s: Select) -> bool:
        """Whether a SELECT has an enforced key among its columns, so that DISTINCT changes nothing."""
        table = self.tables.get(s.source[1].lower())
        if table is None or s.joins or s.group or not table.fields or "view" in table.statistics:
            return False
        alias = s.source[2] or s.source[1]
        shown = {c for e, _ in s.items if (c := _column(e, alias)) is not None} | ({*table.pk} if any(e[0] == "star" for e, _ in s.items) else set())
        not_null = {f.name for f in table.fields if f.not_null}
        keys = [table.pk, *(c for _, c in table.uniques if set(c) <= not_null)]
        if hit := any(k and set(k) <= shown for k in keys):
            self.access.append(f"{s.source[1].lower()} distinct by key")
        return hit

    def _constant(self, e):
        """A literal's value, or None."""
        if e[0] == "num":
            return float(e[1]) if "." in e[1] or "e" in e[1].lower() else int(e[1])
        if e[0] == "neg" and (v := self._constant(e[1])) is not None:
            return -v
        return unquote(e[1]) if e[0] == "str" else self._value(e, {}) if e[0] == "typed" and e[1] != "INTERVAL" else None

    def _partitions(self, table: Table, alias: str, parts: list) -> list[int] | None:
        """Numbers of the partitions that may hold a row, from comparisons of the partition columns with literals."""
        layout = table.layout
        kinds = {f.name: f.dataType for f in table.rows.schema}
        equal: dict[str, list] = {}
        low, high, below = None, None, False
        first = layout.columns[0]
        for e in parts:
            if e[0] == "in" and isinstance(e[2], list) and not e[3] and (c := _column(e[1], alias)) in layout.columns:
                values = [self._constant(x) for x in e[2]]
                if None not in values:
                    equal[c] = values
            elif e[0] == "between" and not e[4] and _column(e[1], alias) == first:
                low, high = self._constant(e[2]), self._constant(e[3])
            elif e[0] == "bin" and e[1] in ("=", "<", "<=", ">", ">="):
                op, a, b = e[1:]
                if _column(a, alias) is None:
                    op, a, b = {"<": ">", "<=": ">=", ">": "<", ">=": "<="}.get(op, op), b, a
                c, v = _column(a, alias), self._constant(b)
                if c in layout.columns and v is not None:
                    if op == "=":
                        equal[c] = [v]
                    elif c == first and op[0] == ">":
                        low = v
                    elif c == first:
                        high, below = v, op == "<"
        if set(layout.columns) <= set(equal):
            rows = [()]
            for c in layout.columns:
                rows = [(*r, v) for r in rows for v in equal[c]]
            if len(rows) > 1000:
                return None
            frame = self.spark.range(1).select(F.explode(F.array(*(F.struct(*(F.lit(v).cast(kinds[c]).alias(c) for c, v in zip(layout.columns, r, strict=True))) for r in rows))).alias("r")).select("r.*")
            return sorted({x[0] for x in frame.select(layout.part(kinds)).collect()} - {None})
        if layout.kind == "LIST" and len(layout.columns) > 1 and equal:
            at = [(layout.columns.index(c), v) for c, v in equal.items()]
            return [k for k, p in enumerate(layout.partitions) if any(all(str(row[i]) in map(str, v) for i, v in at) for row in p.values)]
        if layout.kind == "RANGE" and (low is not None or high is not None or first in equal):
            if first in equal:
                low, high, below = min(equal[first]), max(equal[first]), False
            same = lambda v: self.spark.range(1).select(F.lit(v).cast(kinds[first])).first()[0]
            low, high = (None if v is None else same(v) for v in (low, high))
            out, before = [], None
            for k, p in enumerate(layout.partitions):
                upper = None if p.less_than is None else same(p.less_than[0])
                # bounds of several columns leave both partitions at a border
                if (upper is None or low is None or low < upper or (len(layout.columns) > 1 and low == upper)) and (before is None or high is None or high > before or (high == before and not (below and len(layout.columns) == 1))):
                    out.append(k)
                before = upper
            return out
        return None

    def _cell_scan(self, name: str, alias: str, parts: list) -> str | None:
        """Rows near a point or in a box, from the spatial index."""
        for e in parts:
            box = None
            if e[0] == "call" and e[1] == "DWITHIN" and (c := _column(e[2][0], alias)) and (at := self._point(e[2][1])) and (m := self._constant(e[2][2])) is not None:
                box = cells.around(*at, float(m))
            elif e[0] == "call" and e[1] == "WITHIN" and (c := _column(e[2][0], alias)) and e[2][1][:2] == ("call", "BOX"):
                sides = [self._constant(x) for x in e[2][1][2]]
                box = None if None in sides else tuple(map(float, sides))
            elif e[0] == "bin" and e[1] in ("<", "<=") and e[2][:2] == ("call", "DISTANCE") and (c := _column(e[2][2][0], alias)) and (at := self._point(e[2][2][1])) and (m := self._constant(e[3])) is not None:
                box = cells.around(*at, float(m))
            if box is None:
                continue
            index = next((i for i in self.indexes.values() if i.table == name and i.kind == "SPATIAL" and i.columns == (c,)), None)
            if index is None:
                continue
            index = self._built(index)
            view = f"{self._view(index.name)}_{uuid.uuid4().hex[:8]}"
            index.data.within(*box).createOrReplaceTempView(view)
            self.access.append(f"{name} spatial {index.name}")
            return quote(view)
        return None

    def _point(self, e) -> tuple[float, float] | None:
        if e[:2] not in (("call", "POINT"), ("call", "LOCATION")):
            return None
        at = [self._constant(x) for x in e[2]]
        return None if len(at) != 2 or None in at else (float(at[0]), float(at[1]))

    def _index_scan(self, name: str, table: Table, alias: str, s: Select, parts: list) -> str | None:
        """A sorted index whose first key WHERE compares with a constant and that has every column of the query.

        Expressions and JSON paths that the index holds are replaced by its
        columns in the SELECT.
        """
        for index in self.indexes.values():
            if index.table != name or index.kind != "BTREE":
                continue
            keys = dict(zip(index.columns, index.keys, strict=True))
            first = keys[index.columns[0]]
            bare = lambda e: _bare(e, alias)  # noqa: B023, E731
            compared = [e for e in parts if (e[0] == "bin" and e[1] in ("=", "<", "<=", ">", ">=") and any(bare(x) == first for x in e[2:])) or (e[0] in ("between", "in", "isnull") and bare(e[1]) == first)]
            if not compared or (index.where is not None and not all(c in [bare(x) for x in parts] for c in _conjuncts(index.where))):
                continue
            held = {*index.columns, *index.include, *table.pk}
            hidden = {c: e for c, e in keys.items() if c.startswith("_k")}
            fields = ("items", "where", "group", "having", "order")
            swapped = {f: _swapped(getattr(s, f), hidden, alias) for f in fields}
            if "'star'" in repr(swapped["items"]).replace("('call', 'COUNT', [('star', None)]", "") or "subquery" in repr(swapped) or "exists" in repr(swapped) or not _names_of(swapped, alias) <= held:
                continue
            for f, v in swapped.items():
                setattr(s, f, v)
            index = self._built(index)
            uri, schema = index.data
            view = f"{self._view(index.name)}_{uuid.uuid4().hex[:8]}"
            self.spark.read.schema(schema).parquet(uri).createOrReplaceTempView(view)
            self.access.append(f"{name} index {index.name}")
            return quote(view)
        return None

    # ranked retrieval

    def _rank(self, q: Query, args: dict) -> DataFrame:
        """SEARCH, NEAREST and both: rank the FROM table, then run the rest on it."""
        s = q.body
        if s.source is None or s.source[0] != "table":
            raise SqlError("SEARCH and NEAREST rank a table")
        name, alias = s.source[1].lower(), s.source[2] or s.source[1]
        base = self.table(name)
        rows = base.rows
        if s.where is not None and not s.joins:
            compiler = self._compiler()
            plain = Select(items=[(("star", None), None)], source=("table", name, alias), where=s.where)
            rows = self._spark(compiler.select(plain), compiler, args)
        limit = None if q.limit is None else int(self._value(q.limit, args))
        offset = 0 if q.offset is None else int(self._value(q.offset, args))
        depth = None if limit is None or s.joins or q.order or s.facet else limit + offset
        terms: list[str] = []
        hits, analyzer = None, base.analyzer
        if s.search:
            hits, terms, analyzer = self._searched(name, base, s, args)
            if s.where is not None and not s.joins:
                hits = hits.join(rows.select(*base.pk), list(base.pk), "left_semi")
        if s.facet:
            if hits is None:
                raise SqlError("FACET needs SEARCH")
            return search.facet(self._full(base, hits), s.facet, limit).drop("rank")
        ranked = self._ordered(name, base, rows, hits, s, args, depth)
        view = f"{alias}__ranked"
        self._local(view, ranked)
        plain = replace(s, search=None, nearest=[], source=("table", view, alias), where=s.where if s.joins else None, items=[self._marked(i, terms, view) for i in s.items])
        if plain.items != s.items:
            self._local(view, self._with_marks(ranked, s.items, terms, analyzer))
        order = q.order or [(("name", [alias, "_rank"]), False), *((("name", [alias, k]), False) for k in base.pk)]
        if any(i[0] == ("star", None) or i[0] == ("star", alias) for i in s.items):
            plain = replace(plain, items=[x for i in plain.items for x in (self._starred(base, alias) if i[0] in (("star", None), ("star", alias)) and not s.joins else [i])])
        compiler = self._compiler()
        sql = compiler.select(plain) + compiler.tail(replace(q, order=order))
        return self._spark(sql, compiler, args)

    def _searched(self, name: str, base: Table, s: Select, args: dict) -> tuple[DataFrame, list[str], str]:
        """Matching keys (or rows) with ``_score``, the terms that the query stands for, and the analyser."""
        columns, text = s.search
        fields, weights, phrase = tuple(c for c, _ in columns), dict(columns), self._value(text, args)
        index = next((i for i in self.indexes.values() if i.table == name and i.kind == "FULLTEXT" and i.columns == fields), None)
        if index is not None:
            data = self._built(index).data
            self.access.append(f"{name} fulltext {index.name}")
            query = data.expanded(phrase)
            hits = data.matched(phrase, weights, query=query)
        else:
            data = search.Index(base.rows, fields, base.pk, base.analyzer)
            query = search.expanded(data, phrase)
            hits = search.matched(data, phrase, weights, query=query)
        return hits, sorted({t for slot in query.groups for t in slot.terms}), data.analyzer

    def _full(self, base: Table, hits: DataFrame) -> DataFrame:
        """Hits with all columns of their rows."""
        return hits if set(base.rows.columns) <= set(hits.columns) else base.rows.join(hits, list(base.pk))

    def _starred(self, base: Table, alias: str) -> list:
        return [(("name", [alias, c]), None) for c in base.rows.columns]

    def _marked(self, item: tuple, terms: list[str], view: str) -> tuple:
        e, alias = item
        if e[0] == "call" and e[1] in ("HIGHLIGHT", "SNIPPET"):
            if not terms:
                raise SqlError(f"{e[1]} needs SEARCH")
            return ("name", [_mark_name(e)]), alias or e[1].lower()
        return item

    def _with_marks(self, rows: DataFrame, items: list, terms: list[str], analyzer: str) -> DataFrame:
        for e, _ in items:
            if e[0] == "call" and e[1] in ("HIGHLIGHT", "SNIPPET"):
                column = F.col(e[2][0][1][-1])
                rest = [unquote(a[1]) if a[0] == "str" else int(a[1]) for a in e[2][1:]]
                fn = search.highlight if e[1] == "HIGHLIGHT" else search.snippet
                rows = rows.withColumn(_mark_name(e), fn(column, terms, *rest, analyzer=analyzer))
        return rows

    def _candidates(self, name: str, base: Table, rows: DataFrame, column: str, target, metric: str, depth: int | None, filtered: bool) -> DataFrame | None:
        """Keys and distances from a vector index; None where an exact scan is the plan.

        A selective WHERE is applied first and its rows are ranked exactly;
        under a wide one the index gives more candidates, by its selectivity,
        of which those that pass are kept. If too few pass, the scan decides.
        """
        index = next((i for i in self.indexes.values() if i.table == name and i.kind == "VECTOR" and i.columns == (column,)), None)
        if index is None:
            return None
        if index.using == "SPARSE":
            found = self._built(index).data.search(target, None if filtered else depth, metric)
            self.access.append(f"{name} sparse {index.name}")
            return found.join(rows.select(*base.pk), list(base.pk), "left_semi") if filtered else found
        if depth is None or metric != self.indexes[index.name].option("METRIC", "cosine").lower():
            return None
        wide = depth
        if filtered:
            most = base.statistics.get("rows") or base.rows.count()
            left = rows.count()
            if left <= FILTER_FIRST:
                self.access.append(f"{name} strategy filter-ann")
                return None
            wide = min(most, -(-depth * most * 2 // max(left, 1)))
        data = self._built(index).data
        found = data.search(target, wide)
        if filtered:
            self.access.append(f"{name} strategy ann-filter")
            found = self._keep(found.join(rows.select(*base.pk), list(base.pk), "left_semi"))
            if found.count() < depth:
                return None
        self.access.append(f"{name} {index.using.lower()} {index.name}")
        return found

    def _query_vector(self, base: Table, column: str, value) -> object:
        """A query vector; for a sparse column a dense one's non-zero elements."""
        if isinstance(base.rows.schema[column].dataType, T.StructType):
            return dict(value) if isinstance(value, dict) else {i: float(v) for i, v in enumerate(value) if v}
        return [float(x) for x in value]

    def _measure(self, base: Table, column: str, target, metric: str):
        if isinstance(target, dict):
            return nearest.sparse_distance(column, target, metric)
        return vectors.distance(metric, F.col(column), literal(target))

    def _ordered(self, name: str, base: Table, rows: DataFrame, hits: DataFrame | None, s: Select, args: dict, depth: int | None) -> DataFrame:
        """The candidates with ``_rank``."""
        pk = base.pk
        if not s.nearest:
            whole = set(base.rows.columns) <= set(hits.columns)  # a scan gives rows, an index keys
            best = (hits if whole else hits.select(*pk, "_score")).withColumn("_rank", -F.col("_score"))
            if depth is not None:
                best = best.orderBy("_rank", *pk).limit(depth)
            if not whole:
                best = base.rows.join(F.broadcast(best) if depth is not None and depth <= FILTER_FIRST else best, list(pk))
            return best.select(*base.rows.columns, "_rank")
        near = []
        for column, vector, metric in s.nearest:
            c = column[1][-1]
            bits = any(f.name == c and f.kind.startswith("BITVECTOR") for f in base.fields)
            near.append((c, self._query_vector(base, c, self._value(vector, args)), metric or ("hamming" if bits else "cosine")))
        if hits is None and len(near) == 1:
            c, target, metric = near[0]
            found = self._candidates(name, base, rows, c, target, metric, depth, s.where is not None and not s.joins)
            if found is not None:
                return base.rows.join(found, list(pk)).withColumn("_rank", F.col("_distance")).select(*base.rows.columns, "_rank")
            self.access.append(f"{name} flat")
            best = rows.filter(F.col(c).isNotNull()).withColumn("_rank", self._measure(base, c, target, metric))
            best = best.filter("_rank <> 0") if isinstance(target, dict) and metric == "inner_product" else best
            return best if depth is None else best.orderBy("_rank", *pk).limit(depth)
        depth = DEFAULT_K if depth is None and not s.joins else depth
        candidates = rows if hits is None else self._full(base, hits)
        self.access.append(f"{name} strategy {'search-ann' if hits is not None else 'filter-ann'}")
        channels = [self._measure(base, c, v, m) for c, v, m in near]
        if hits is not None:
            channels.insert(0, -F.col("_score"))
        fused = hybrid.fuse_scored(candidates, pk, channels, depth).withColumn("_rank", -F.col("_score")).drop("_score")
        return rows.join(fused, list(pk)).select(*rows.columns, "_rank")

    # changes

    def _log(self, name: str, table: Table, operation: str, before: DataFrame | None, after: DataFrame | None) -> None:
        self.changes.commit(name, operation, before, after, table.pk, table.images)

    def _subscribe(self, p: Parser, args: dict) -> DataFrame:
        """SUBSCRIBE TO table [WHERE operation = '...'] [AFTER lsn]: a streaming DataFrame."""
        p.need("TO")
        name = p.name().lower()
        self.table(name)
        operation = after = None
        if p.take("WHERE"):
            e = p.expr()
            if e[0] != "bin" or e[1] != "=" or e[2] != ("name", ["operation"]) or e[3][0] != "str":
                raise SqlError("SUBSCRIBE takes WHERE operation = '...' only")
            operation = unquote(e[3][1])
        if p.take("AFTER"):
            after = int(p._number())
        p.done()
        try:
            return self.changes.subscribe(name, operation, after)
        except ValueError as e:
            raise SqlError(str(e)) from None


def _arguments(params: dict | list | None) -> dict:
    """Parameters by name; those of a list by their number."""
    return {str(i + 1): v for i, v in enumerate(params)} if isinstance(params, list) else dict(params or {})


def _mark_name(e: tuple) -> str:
    return "_" + e[1].lower() + "_" + "_".join(str(x[1][-1] if x[0] == "name" else "".join(ch if ch.isalnum() else str(ord(ch)) for ch in x[1])) for x in e[2])


def _mentions(q: Query, name: str) -> bool:
    return f"'{name.lower()}'" in repr(q).lower()


def _conjuncts(e: tuple) -> list:
    return _conjuncts(e[2]) + _conjuncts(e[3]) if e[:2] == ("bin", "AND") else [e]


def _column(e: tuple, alias: str) -> str | None:
    """The column of the relation that an expression is, if it is one."""
    e = _bare(e, alias)
    return e[1][0] if e[0] == "name" and len(e[1]) == 1 else None


def _bare(e, alias: str):
    """An expression without the relation's name before its columns; JSON_GET of a constant path is the path."""
    if isinstance(e, tuple) and e[:2] == ("call", "JSON_GET") and len(e[2]) == 2 and e[2][0][0] == "name" and e[2][1][0] == "str":
        path = [p for p in unquote(e[2][1][1]).removeprefix("$").split(".") if p]
        return _bare(("name", [*e[2][0][1], *path]), alias)
    if isinstance(e, tuple) and len(e) == 2 and e[0] == "name":
        return ("name", list(e[1][1:])) if len(e[1]) > 1 and e[1][0] == alias else ("name", list(e[1]))
    return type(e)(_bare(x, alias) for x in e) if isinstance(e, tuple | list) else e


def _swapped(e, hidden: dict, alias: str):
    """An expression with what an index holds replaced by the index's columns."""
    for c, key in hidden.items():
        if _bare(e, alias) == key:
            return "name", [c]
    if isinstance(e, tuple) and len(e) == 2 and isinstance(e[0], tuple) and (e[1] is None or isinstance(e[1], str)):  # an item and its alias
        inner = _swapped(e[0], hidden, alias)
        return inner, e[1] or (e[0][1][-1] if inner != e[0] and e[0][0] == "name" else None)
    return type(e)(_swapped(x, hidden, alias) for x in e) if isinstance(e, tuple | list) else e


def _names_of(e, alias: str) -> set[str]:
    """Columns that expressions read."""
    if isinstance(e, tuple) and len(e) == 2 and e[0] == "name":
        return {_bare(e, alias)[1][0]}
    if isinstance(e, dict):
        return {n for x in e.values() for n in _names_of(x, alias)}
    return {n for x in e for n in _names_of(x, alias)} if isinstance(e, tuple | list) else set()
