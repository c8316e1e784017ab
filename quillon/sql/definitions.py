"""CREATE, ALTER and DROP of tables, views and indexes; SHOW, system.*, ANALYZE, EXPLAIN."""

from __future__ import annotations

import json
from dataclasses import replace

from pyspark.sql import DataFrame, functions as F, types as T

from quillon.sql.catalog import Field, Foreign, Index, Layout, Partition, Table, spark_type
from quillon.sql.compile import quote, unquote
from quillon.sql.parser import Parser, SqlError

_FULLTEXT = ("simple", "english", "french", "german", "spanish")


def text_of(p: Parser, start: int) -> str:
    """The tokens from ``start`` on, as text."""
    return " ".join(v for _, v in p.tokens[start : p.at])


class Definitions:
    """The defining half of the engine."""

    # tables

    def _create(self, p: Parser, args: dict) -> DataFrame:
        swap = p.take("OR", "REPLACE")
        if p.take("VIEW"):
            return self._create_view(p, args, swap)
        if p.take("TABLE"):
            return self._create_table(p, args)
        return self._create_index(p, args)

    def _create_table(self, p: Parser, args: dict) -> DataFrame:
        quiet = p.take("IF", "NOT", "EXISTS")
        name = p.name().lower()
        if name in self.tables or name in self.views:
            if quiet:
                return self._names([name])
            raise SqlError(f"{name} exists")
        if p.take("PRIMARY", "KEY", "("):
            pk = p.listed(p.name)
            p.need(")", "AS")
            q = p.query()
            p.done()
            rows = self.run(q, args)
            if void := [f.name for f in rows.schema if isinstance(f.dataType, T.NullType)]:
                raise SqlError(f"CAST the NULL of {void[0]}")
            table = Table(rows.limit(0), tuple(pk))
            rows = self._keep(rows)
            self._check_rows(name, table, rows)
            self._check_keys(name, table, None, rows)
            self._store(name, table, rows)
            return self._names([name])
        p.need("(")
        fields, pk, checks, uniques, foreign = [], (), [], [], []
        for _ in iter(int, 1):
            if (rule := self._constraint(p, name, len(checks), len(foreign))) is not None:
                kind, value = rule
                pk = value if kind == "pk" else pk
                checks += [value] if kind == "check" else []
                uniques += [value] if kind == "unique" else []
                foreign += [value] if kind == "foreign" else []
            else:
                f, own, more, unique, parent = self._column(p, name, len(checks))
                fields.append(f)
                pk = (f.name,) if own else pk
                checks += more
                uniques += [(f"uq_{name}_{f.name}", (f.name,))] if unique else []
                foreign += [parent] if parent else []
            if not p.take(","):
                break
        p.need(")")
        layout = self._layout(p)
        p.done()
        if not pk:
            raise SqlError("a table has a PRIMARY KEY")
        known = {f.name for f in fields}
        if len(known) != len(fields):
            raise SqlError("a column is named twice")
        for c in (*pk, *(c for _, k in uniques for c in k), *(c for f in foreign for c in f.columns), *(layout.columns if layout else ())):
            if c not in known:
                raise SqlError(f"no column {c}")
        if layout and not set(layout.columns) <= set(pk):
            raise SqlError("the primary key holds every partition column")
        schema = T.StructType.fromDDL(", ".join(f"{quote(f.name)} {spark_type(f.kind)}" for f in fields))
        fields = [replace(f, not_null=f.not_null or f.name in pk) for f in fields]
        table = Table(self.spark.createDataFrame([], schema), tuple(pk), "simple", tuple(fields), tuple(checks), tuple(uniques), tuple(foreign), layout=layout)
        self.tables[name] = table  # a table may refer to itself
        try:
            self._check_foreign(foreign)
            self._check_rows(name, table, table.rows)
        except Exception:
            del self.tables[name]
            raise
        self._store(name, table, table.rows)
        return self._names([name])

    def _check_foreign(self, foreign: list[Foreign]) -> None:
        for f in foreign:
            parent = self.table(f.parent)
            keys = [set(parent.pk), *(set(c) for _, c in parent.uniques), *(set(i.columns) for i in self.indexes.values() if i.table == f.parent and i.unique)]
            if set(f.parent_columns) not in keys or len(f.columns) != len(f.parent_columns):
                raise SqlError(f"{f.name} refers to no unique key of {f.parent}")

    def _column(self, p: Parser, table: str, number: int) -> tuple[Field, bool, list, bool, Foreign | None]:
        """name, type and rules of one column."""
        name, kind = p.name(), p.type()
        spark_type(kind)
        own = unique = not_null = False
        default, checks, parent = None, [], None
        while True:
            if p.take("PRIMARY", "KEY"):
                own = True
            elif p.take("NOT", "NULL"):
                not_null = True
            elif p.take("NULL"):
                pass
            elif p.take("UNIQUE"):
                unique = True
            elif p.take("DEFAULT"):
                default = p._unary()
            elif p.take("CHECK"):
                checks.append(self._check_clause(p, f"ck_{table}_{number + len(checks) + 1}"))
            elif p.take("REFERENCES"):
                parent = self._references(p, f"fk_{table}_{name}"[:63], (name,))
            else:
                return Field(name, kind, not_null, default), own, checks, unique, parent

    def _check_clause(self, p: Parser, name: str) -> tuple[str, tuple, str]:
        p.need("(")
        start = p.at
        e = p.expr()
        text = text_of(p, start)
        p.need(")")
        if any(x in repr(e) for x in ("'subquery'", "'over'", "'param'", "'exists'", "'NOW'", "'UUID'", "'AI'", "'SUM'", "'COUNT'", "'AVG'", "'MIN'", "'MAX'")):
            raise SqlError("a CHECK depends on its row alone")
        return name, e, text

    def _references(self, p: Parser, name: str, columns: tuple[str, ...]) -> Foreign:
        parent = p.name().lower()
        p.need("(")
        keys = tuple(p.listed(p.name))
        p.need(")")
        p.take("MATCH", "SIMPLE")
        actions = {"DELETE": "RESTRICT", "UPDATE": "RESTRICT"}
        while p.take("ON"):
            event = p.name().upper()
            if p.take("SET", "NULL"):
                action = "SET NULL"
            elif p.take("SET", "DEFAULT"):
                action = "SET DEFAULT"
            elif p.take("NO", "ACTION"):
                action = "RESTRICT"
            else:
                action = p.name().upper()
            if event not in actions or action not in ("RESTRICT", "CASCADE", "SET NULL", "SET DEFAULT"):
                raise SqlError(f"no referential action ON {event} {action}")
            actions[event] = action
        return Foreign(name, columns, parent, keys, actions["DELETE"], actions["UPDATE"])

    def _constraint(self, p: Parser, table: str, checks: int, foreign: int) -> tuple[str, object] | None:
        """A rule of the table, if one comes next."""
        name = p.name() if p.take("CONSTRAINT") else None
        if p.take("PRIMARY", "KEY", "("):
            out = ("pk", tuple(p.listed(p.name)))
        elif p.take("UNIQUE", "("):
            columns = tuple(p.listed(p.name))
            out = ("unique", (name or f"uq_{table}_{'_'.join(columns)}", columns))
        elif p.take("CHECK"):
            return "check", self._check_clause(p, name or f"ck_{table}_{checks + 1}")
        elif p.take("FOREIGN", "KEY", "("):
            columns = tuple(p.listed(p.name))
            p.need(")", "REFERENCES")
            return "foreign", self._references(p, name or f"fk_{table}_{'_'.join(columns)}"[:63], columns)
        else:
            if name:
                raise SqlError("expected CHECK, UNIQUE or FOREIGN KEY")
            return None
        p.need(")")
        return out

    def _tuple(self, p: Parser) -> tuple:
        """Literals in brackets."""
        p.need("(")
        out = tuple(self._value(e, {}) for e in p.listed(p._unary))
        p.need(")")
        return out

    def _partition(self, p: Parser, kind: str, columns: int) -> Partition:
        p.need("PARTITION")
        name = p.name()
        if kind == "HASH":
            p.need("MODULUS")
            p._number()
            p.need("REMAINDER")
            return Partition(name, remainder=int(p._number()))
        p.need("VALUES")
        if kind == "RANGE":
            p.need("LESS", "THAN")
            return Partition(name) if p.take("MAXVALUE") else Partition(name, self._tuple(p))
        p.need("IN")
        if columns == 1:
            return Partition(name, values=tuple((v,) for v in self._tuple(p)))
        p.need("(")
        values = tuple(p.listed(lambda: self._tuple(p)))
        p.need(")")
        return Partition(name, values=values)

    def _layout(self, p: Parser) -> Layout | None:
        if not p.take("PARTITION", "BY"):
            return None
        kind = p.name().upper()
        if kind not in ("RANGE", "HASH", "LIST"):
            raise SqlError("PARTITION BY RANGE, HASH or LIST")
        p.need("(")
        columns = tuple(p.listed(p.name))
        p.need(")", "(")
        parts = p.listed(lambda: self._partition(p, kind, len(columns)))
        p.need(")")
        if kind == "HASH":
            parts = sorted(parts, key=lambda x: x.remainder)
            if [x.remainder for x in parts] != list(range(len(parts))):
                raise SqlError("HASH needs every remainder")
        return Layout(kind, columns, tuple(parts))

    def _alter(self, p: Parser, args: dict) -> DataFrame:
        p.need("TABLE")
        name = p.name().lower()
        table = self.table(name)
        fields = table.declared()
        rows = table.rows
        if p.take("ADD", "PARTITION") or p.take("ATTACH", "PARTITION"):
            p.at -= 1
            part = self._partition(p, table.layout.kind if table.layout else "", len(table.layout.columns) if table.layout else 0)
            p.done()
            last = table.layout.partitions[-1]
            if table.layout.kind == "HASH" or (table.layout.kind == "RANGE" and (last.less_than is None or (part.less_than is not None and part.less_than <= last.less_than))):
                raise SqlError("the partition can't be added")
            self._version(name, replace(table, layout=replace(table.layout, partitions=(*table.layout.partitions, part))), table.uris, rows.schema)
        elif p.take("DROP", "PARTITION") or p.take("DETACH", "PARTITION"):
            gone = p.name()
            p.done()
            left = tuple(x for x in (table.layout.partitions if table.layout else ()) if x.name != gone)
            if table.layout is None or len(left) == len(table.layout.partitions) or not left or table.layout.kind == "HASH":
                raise SqlError(f"no partition {gone} to drop")
            at = [x.name for x in table.layout.partitions].index(gone)
            full = self._read(table.uris, rows.schema, table.layout)
            self._store(name, replace(table, layout=replace(table.layout, partitions=left)), full.filter(F.col("_part") != at).drop("_part"))
        elif p.take("ADD"):
            if (rule := self._constraint(p, name, len(table.checks), len(table.foreign))) is not None:
                p.done()
                kind, value = rule
                if kind == "check":
                    changed = replace(table, checks=(*table.checks, value))
                    self._check_rows(name, replace(table, fields=(), checks=(value,), layout=None), rows)
                elif kind == "unique":
                    changed = replace(table, uniques=(*table.uniques, value))
                    self._check_keys(name, replace(table, pk=(), uniques=(value,)), None, rows)
                elif kind == "foreign":
                    self._check_foreign([value])
                    self._check_parents(name, replace(table, foreign=(value,)), rows)
                    changed = replace(table, foreign=(*table.foreign, value))
                else:
                    raise SqlError("a PRIMARY KEY can't be added")
                self._set(name, changed)
            else:
                p.take("COLUMN")
                f, own, checks, unique, parent = self._column(p, name, len(table.checks))
                p.done()
                if own or unique or parent or any(x.name == f.name for x in fields):
                    raise SqlError(f"{f.name} can't be added")
                widened = replace(table, fields=(*fields, f), checks=(*table.checks, *checks), rows=rows.withColumn(f.name, F.lit(None).cast(T.StructType.fromDDL(f"x {spark_type(f.kind)}")[0].dataType)))
                filled = self._keep(self._filled(name, widened, rows))
                self._check_rows(name, widened, filled)
                self._store(name, replace(widened, uris=table.uris), filled)
        elif p.take("DROP", "CONSTRAINT"):
            gone = p.name()
            p.done()
            changed = replace(table, checks=tuple(c for c in table.checks if c[0] != gone), uniques=tuple(u for u in table.uniques if u[0] != gone), foreign=tuple(f for f in table.foreign if f.name != gone))
            if changed == table:
                raise SqlError(f"no constraint {gone}")
            self._set(name, changed)
        elif p.take("DROP"):
            p.take("COLUMN")
            gone = p.name()
            p.done()
            used = {*table.pk, *(c for f in table.foreign for c in f.columns), *(table.layout.columns if table.layout else ()), *(c for _, f in self._children(name) for c in f.parent_columns)}
            if gone in used or gone not in rows.columns or any(f"'{gone}'" in repr(e) for _, e, _ in table.checks):
                raise SqlError(f"{gone} can't be dropped")
            self.indexes = {k: i for k, i in self.indexes.items() if i.table != name or gone not in (*i.columns, *i.include)}
            kept = replace(table, fields=tuple(f for f in fields if f.name != gone), uniques=tuple(u for u in table.uniques if gone not in u[1]))
            self._store(name, kept, rows.drop(gone))
        elif p.take("RENAME", "TO"):
            new = p.name().lower()
            p.done()
            if new in self.tables or new in self.views:
                raise SqlError(f"{new} exists")
            self._rename_table(name, new)
        elif p.take("RENAME"):
            p.take("COLUMN")
            old = p.name()
            p.need("TO")
            new = p.name()
            p.done()
            if old not in rows.columns or new in rows.columns:
                raise SqlError(f"{old} can't be renamed")
            self._rename_column(name, table, old, new)
        elif p.take("ALTER"):
            p.take("COLUMN")
            column = p.name()
            if column not in rows.columns:
                raise SqlError(f"no column {column}")
            at = next(f for f in fields if f.name == column)
            if p.take("SET", "NOT", "NULL"):
                if not rows.filter(F.col(column).isNull()).isEmpty():
                    raise SqlError(f"{column} holds NULL")
                at2 = replace(at, not_null=True)
            elif p.take("DROP", "NOT", "NULL"):
                if column in table.pk:
                    raise SqlError(f"{column} is part of the primary key")
                at2 = replace(at, not_null=False)
            elif p.take("SET", "DEFAULT"):
                at2 = replace(at, default=p._unary())
            else:
                p.need("DROP", "DEFAULT")
                at2 = replace(at, default=None)
            p.done()
            self._set(name, replace(table, fields=tuple(at2 if f is at else f for f in fields)))
        else:
            p.need("SET", "CDC", "IMAGES")
            mode = p.name().upper()
            p.done()
            if mode not in ("KEYS", "FULL"):
                raise SqlError("CDC IMAGES are KEYS or FULL")
            self._set(name, replace(table, images=mode))
        return self._names([name])

    def _rename_table(self, name: str, new: str) -> None:
        table = self.tables.pop(name)
        self._set(new, table, self._read(table.uris, table.rows.schema, table.layout) if table.layout else None)
        self.spark.catalog.dropTempView(self._view(name))
        self.indexes = {k: replace(i, table=new) if i.table == name else i for k, i in self.indexes.items()}
        for other, t in list(self.tables.items()):
            if any(f.parent == name for f in t.foreign):
                self.tables[other] = replace(t, foreign=tuple(replace(f, parent=new) if f.parent == name else f for f in t.foreign))

    def _rename_column(self, name: str, table: Table, old: str, new: str) -> None:
        to = lambda names: tuple(new if c == old else c for c in names)
        fields = tuple(replace(f, name=new) if f.name == old else f for f in table.declared())
        foreign = tuple(replace(f, columns=to(f.columns), parent_columns=to(f.parent_columns) if f.parent == name else f.parent_columns) for f in table.foreign)
        checks = tuple((n, _renamed(e, old, new), t) for n, e, t in table.checks)
        layout = replace(table.layout, columns=to(table.layout.columns)) if table.layout else None
        changed = replace(table, pk=to(table.pk), fields=fields, foreign=foreign, checks=checks, uniques=tuple((n, to(c)) for n, c in table.uniques), layout=layout)
        self.indexes = {k: replace(i, columns=to(i.columns), include=to(i.include), keys=_renamed(i.keys, old, new), where=_renamed(i.where, old, new), data=None) if i.table == name else i for k, i in self.indexes.items()}
        for other, t in list(self.tables.items()):
            if other != name and any(f.parent == name for f in t.foreign):
                self.tables[other] = replace(t, foreign=tuple(replace(f, parent_columns=to(f.parent_columns)) if f.parent == name else f for f in t.foreign))
        self._store(name, changed, table.rows.withColumnRenamed(old, new))

    # views

    def _create_view(self, p: Parser, args: dict, swap: bool) -> DataFrame:
        name = p.name().lower()
        p.need("AS")
        start = p.at
        q = p.query()
        text = text_of(p, start)
        p.done()
        if name in self.tables or (name in self.views and not swap):
            raise SqlError(f"{name} exists")
        before = self.views.get(name)
        self.views[name] = (q, text)
        try:
            self.run(q, args)  # a view must run, without itself
        except Exception:
            self.views.pop(name)
            if before:
                self.views[name] = before
            raise
        return self._names([name])

    def _drop(self, p: Parser, args: dict) -> DataFrame:
        kind = p.name().upper()
        if kind not in ("TABLE", "VIEW", "INDEX"):
            raise SqlError("DROP TABLE, VIEW or INDEX")
        quiet = p.take("IF", "EXISTS")
        name = p.name().lower()
        p.done()
        held = {"TABLE": self.tables, "VIEW": self.views, "INDEX": self.indexes}[kind]
        if name not in held:
            if quiet:
                return self._names([name])
            raise SqlError(f"no {kind.lower()} {name}")
        if kind == "TABLE":
            if any(child != name for child, _ in self._children(name)):
                raise SqlError(f"{name} is referred to")
            self._superseded += list(self.tables[name].uris)
            self.indexes = {k: i for k, i in self.indexes.items() if i.table != name}
            self.spark.catalog.dropTempView(self._view(name))
        if kind == "INDEX" and held[name].unique and any(set(f.parent_columns) == set(held[name].columns) for _, f in self._children(held[name].table)):
            raise SqlError(f"{name} supports a foreign key")
        held.pop(name)
        return self._names([name])

    # indexes

    def _create_index(self, p: Parser, args: dict) -> DataFrame:
        unique = p.take("UNIQUE")
        kind = next((k for k in ("FULLTEXT", "VECTOR", "SPATIAL") if not unique and p.take(k)), "BTREE")
        p.need("INDEX")
        name = p.name().lower()
        p.need("ON")
        table_name = p.name().lower()
        table = self.table(table_name)
        if name in self.indexes:
            raise SqlError(f"index {name} exists")
        p.need("(")
        keys = tuple(p.listed(p.expr))
        p.need(")")
        include, where, where_text, using, options = (), None, "", "", {}
        if p.take("INCLUDE", "("):
            include = tuple(p.listed(p.name))
            p.need(")")
        if p.take("USING"):
            using = p.name().upper()
        if p.take("WITH", "("):
            for _ in iter(int, 1):
                option = p.name().upper()
                p.need("=")
                token, value = p.tokens[p.at]
                p.at += 1
                options[option] = unquote(value) if token == "str" else int(value)
                if not p.take(","):
                    break
            p.need(")")
        if p.take("WHERE"):
            start = p.at
            where = p.expr()
            where_text = text_of(p, start)
        p.done()
        columns = tuple(k[1][0] if k[0] == "name" and len(k[1]) == 1 else f"_k{i}" for i, k in enumerate(keys))
        plain = all(k[0] == "name" and len(k[1]) == 1 for k in keys)
        if kind != "BTREE" and not plain:
            raise SqlError(f"a {kind} index takes columns")
        for c in (*(k[1][0] for k in keys if k[0] == "name"), *include):
            if c not in table.rows.columns:
                raise SqlError(f"no column {c}")
        if kind == "FULLTEXT" and options.get("ANALYZER", table.analyzer) not in _FULLTEXT:
            raise SqlError("the ANALYZER is simple, english, french, german or spanish")
        if kind == "VECTOR" and using not in ("HNSW", "IVF", "IVFPQ", "SPARSE"):
            raise SqlError("USING HNSW, IVF, IVFPQ or SPARSE")
        if kind == "VECTOR" and using.startswith("IVF") and "LISTS" not in options:
            raise SqlError("LISTS is required")
        index = Index(name, table_name, kind, columns, unique, keys, include, where, where_text, using, tuple(sorted(options.items())))
        if unique:
            if not plain:
                raise SqlError("a UNIQUE index takes columns")
            self._check_keys(table_name, replace(table, pk=(), uniques=((name, columns),)), None, table.rows)
        self.indexes[name] = index
        try:
            self._built(index)
        except Exception:
            self.indexes.pop(name)
            raise
        return self._names([name])

    def _rebuild(self, p: Parser, args: dict) -> DataFrame:
        p.need("INDEX")
        name = p.name().lower()
        p.done()
        if name not in self.indexes:
            raise SqlError(f"no index {name}")
        self._built(replace(self.indexes[name], data=None))
        return self._names([name])

    # what there is

    def _names(self, names: list[str]) -> DataFrame:
        return self.spark.createDataFrame([(n,) for n in names], "name string")

    def _show(self, p: Parser, args: dict) -> DataFrame:
        what = p.name().upper()
        p.done()
        if what == "TABLES":
            return self._names(sorted({**self.tables, **self.views}))
        if what.lower() in ("views", "indexes", "columns", "partitions"):
            return self._system(what.lower())
        raise SqlError(f"SHOW {what} is not supported")

    def _system(self, name: str) -> DataFrame:
        """A virtual table of the catalog."""
        tables = sorted(self.tables.items())
        yes = lambda x: bool(x)
        kind = lambda i: i.kind if i.kind != "VECTOR" else i.using
        rows, schema = [], ""
        if name == "tables":
            rows, schema = [(n, len(t.rows.columns), ",".join(t.pk)) for n, t in tables], "name string, column_count long, pk string"
        elif name == "columns":
            schema = "table_name string, column_name string, ordinal long, type string, not_null boolean, is_primary boolean, default_value string"
            rows = [(n, f.name, i + 1, f.kind, f.not_null or f.name in t.pk, f.name in t.pk, None if f.default is None else str(f.default[1])) for n, t in tables for i, f in enumerate(t.declared())]
        elif name == "indexes":
            schema = "table_name string, index_name string, kind string, is_unique boolean, columns string, include_columns string, predicate string, status string"
            rows = [(i.table, i.name, kind(i), yes(i.unique), ",".join(i.columns), ",".join(i.include), i.where_text, "ready" if i.data is not None else "stale") for _, i in sorted(self.indexes.items())]
        elif name == "views":
            rows, schema = [(n, t) for n, (_, t) in sorted(self.views.items())], "view_name string, definition string"
        elif name == "checks":
            rows, schema = [(n, c, text) for n, t in tables for c, _, text in t.checks], "table_name string, constraint_name string, predicate string"
        elif name == "foreign_keys":
            schema = "table_name string, constraint_name string, ordinal long, column_name string, ref_table string, ref_column string, on_delete string, on_update string"
            rows = [(n, f.name, k + 1, c, f.parent, r, f.on_delete, f.on_update) for n, t in tables for f in t.foreign for k, (c, r) in enumerate(zip(f.columns, f.parent_columns, strict=True))]
        elif name == "partitions":
            schema = "table_name string, partition_name string, kind string, columns string, bound string"
            rows = [(n, x.name, t.layout.kind, ",".join(t.layout.columns), str(x.less_than if t.layout.kind == "RANGE" else x.values if t.layout.kind == "LIST" else x.remainder)) for n, t in tables if t.layout for x in t.layout.partitions]
        elif name == "table_stats":
            schema = "table_name string, row_count long, analyzed_rows long"
            rows = [(n, t.rows.count(), t.statistics.get("rows")) for n, t in tables]
        elif name == "column_stats":
            schema = "table_name string, column_name string, distinct_values long, null_count long, least string, most string"
            rows = [(n, c, *v) for n, t in tables for c, v in t.statistics.get("columns", {}).items()]
        elif name == "change_streams":
            rows, schema = [(n, self.changes.last(n)) for n, _ in tables], "table_name string, lsn long"
        elif name == "capabilities":
            rows, schema = [(n, "supported") for n in ("sql", "json", "fulltext", "vector", "hybrid", "spatial", "partitioning", "cdc")], "name string, status string"
        else:
            raise SqlError(f"no table system.{name}")
        return self.spark.createDataFrame(rows, schema)

    def _analyze(self, p: Parser, args: dict) -> DataFrame:
        """Statistics of one or all tables, kept for planning and in ``system.column_stats``."""
        names = list(self.tables) if p.tokens[p.at][0] == "end" or p.word() == ";" else [p.name().lower()]
        p.done()
        out = []
        for name in names:
            table = self.table(name)
            plain = [f.name for f in table.rows.schema if isinstance(f.dataType, T.NumericType | T.StringType | T.DateType | T.TimestampType | T.TimestampNTZType | T.BooleanType)]
            aggs = [x for k, c in enumerate(plain) for x in (F.approx_count_distinct(c).alias(f"d{k}"), F.count_if(F.col(c).isNull()).alias(f"n{k}"), F.min(c).cast("string").alias(f"a{k}"), F.max(c).cast("string").alias(f"b{k}"))]
            r = table.rows.agg(F.count(F.lit(1)).alias("rows"), *aggs).first()
            columns = {c: (r[f"d{k}"], r[f"n{k}"], r[f"a{k}"], r[f"b{k}"]) for k, c in enumerate(plain)}
            self._set(name, replace(table, statistics={"rows": r["rows"], "columns": columns}))
            out += [(name, r["rows"], c, *v) for c, v in columns.items()]
        return self.spark.createDataFrame(out, "table_name string, rows long, column string, distinct_values long, null_count long, least string, most string")

    def _explain(self, p: Parser, args: dict) -> DataFrame:
        """EXPLAIN [ANALYZE] [(ANALYZE, FORMAT JSON | TEXT)]: Spark's plan, run first if asked."""
        analyze, form = p.take("ANALYZE"), "TEXT"
        if p.word() == "(" and p.word(1) in ("ANALYZE", "FORMAT"):
            p.need("(")
            for _ in iter(int, 1):
                if p.take("FORMAT"):
                    form = p.name().upper()
                else:
                    p.need("ANALYZE")
                    analyze = True
                if not p.take(","):
                    break
            p.need(")")
        q = p.query()
        p.done()
        rows = self.run(q, args)
        counted = rows.count() if analyze else None
        execution = rows._jdf.queryExecution()
        if form == "JSON":
            plan = json.loads(execution.optimizedPlan().toJSON())
            tree = [{"operator": n["class"].rpartition(".")[2], "children": n["num-children"]} for n in plan]
            return self.spark.createDataFrame([(json.dumps({"plan": tree, "rows": counted, "access": self.access}),)], "plan string")
        mode = self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
        lines = [f"access: {x}" for x in self.access] + ([f"rows: {counted}"] if analyze else []) + execution.explainString(mode).split("\n")
        return self.spark.createDataFrame([(x,) for x in lines], "plan string")


def _renamed(e, old: str, new: str):
    """An expression with a column's name changed."""
    if isinstance(e, tuple) and len(e) == 2 and e[0] == "name":
        return "name", [new if x == old else x for x in e[1]]
    if isinstance(e, tuple | list):
        return type(e)(_renamed(x, old, new) for x in e)
    return e
