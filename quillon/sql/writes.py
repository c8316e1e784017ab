"""INSERT, UPSERT, UPDATE and DELETE, with the rules of a table.

A statement makes a new version of a table's rows; old files stay until
``Engine.vacuum``, so DataFrames made before it keep their rows. INSERT only
adds files; UPDATE and DELETE of a partitioned table write the partitions
that they touch. Every statement is one transaction of the change log.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from quillon.functions import vectors
from quillon.sources import storage
from quillon.sql.catalog import BOUNDS, Foreign, Layout, Table, split_type
from quillon.sql.compile import quote, unquote
from quillon.sql.parser import Parser, SqlError

MAX_CASCADE = 8


class Writes:
    """The writing half of the engine."""

    # clauses

    def _returning(self, p: Parser) -> list | None:
        return p.listed(p._item) if p.take("RETURNING") else None

    def _answer(self, name: str, rows: DataFrame, items: list | None, args: dict) -> DataFrame:
        """RETURNING's columns over the written rows, or how many there are."""
        if items is None:
            return rows.agg(F.count(F.lit(1)).alias("affected"))
        compiler = self._compiler()
        rows.createOrReplaceTempView(view := f"{self._view(name)}_returned")
        stars = [quote(c) for c in self.table(name).rows.columns]
        sql = ", ".join(", ".join(stars) if e[0] == "star" else compiler.item((e, a)) for e, a in items)
        return self._spark(f"SELECT {sql} FROM {quote(view)} AS {quote(name)}", compiler, args)

    def _proposed(self, p: Parser, table: Table, args: dict) -> DataFrame:
        """Rows of VALUES or a query, under the names of their columns."""
        columns = list(table.rows.columns)
        if p.take("("):
            columns = p.listed(p.name)
            p.need(")")
        unknown = set(columns) - set(table.rows.columns)
        if unknown:
            raise SqlError(f"no column {sorted(unknown)[0]}")
        if not p.take("VALUES"):
            return self.run(p.query(), args).toDF(*columns)
        compiler = self._compiler()
        defaults = {f.name: f.default for f in table.fields}

        def row() -> str:
            p.need("(")
            cells = p.listed(lambda: None if p.take("DEFAULT") else p.expr())
            p.need(")")
            if len(cells) != len(columns):
                raise SqlError("VALUES: a row has another number of columns")
            exprs = [defaults.get(c) or ("word", "NULL") if e is None else e for c, e in zip(columns, cells, strict=True)]
            if any(e[:2] == ("call", "AI") for e in exprs):
                raise SqlError("leave an AI() column out instead of DEFAULT")
            plain.append(all(e[0] in ("num", "str", "word", "blob") or (e[0] == "neg" and e[1][0] == "num") for e in exprs))
            return ", ".join(map(compiler.expr, exprs))

        plain: list[bool] = []
        found = p.listed(row)
        # literals make one local relation; anything else is a projection for each row
        sql = f"SELECT * FROM VALUES {', '.join(f'({x})' for x in found)}" if all(plain) else " UNION ALL ".join(f"SELECT {x}" for x in found)
        return self._spark(sql, compiler, args).toDF(*columns)

    # rules

    def _stored(self, column: Column, kind: str, to: T.DataType, source: T.DataType | None = None) -> Column:
        """A value (of type ``source``) as its column holds it."""
        if isinstance(to, T.VariantType):
            return column if source is None or isinstance(source, T.VariantType) else F.parse_json(column.cast("string"))
        base = kind.split("(")[0].split("<")[0]
        if base == "CHAR" and "(" in kind:
            n = int(kind[5:-1])
            text = column.cast("string")
            kept = F.when(F.char_length(text) > n, F.when(F.rtrim(F.substr(text, F.lit(n + 1))) == "", F.substr(text, F.lit(1), F.lit(n))).otherwise(text)).otherwise(text)
            return F.rpad(kept, F.greatest(F.lit(n), F.char_length(kept)), " ")
        if base == "VECTOR":
            element = split_type(kind)[0]
            return vectors.quantised(column.cast(to), element) if element in ("F16", "I8") else column.cast(to)
        return column.cast(to)

    def _filled(self, name: str, table: Table, new: DataFrame) -> DataFrame:
        """Full rows: columns cast, those not named by their default."""
        kinds = {f.name: f.kind for f in table.declared()}
        defaults = {f.name: f.default for f in table.fields}
        compiler = self._compiler()
        out = []
        for f in table.rows.schema:
            default = defaults.get(f.name)
            if f.name in new.columns:
                value = self._stored(F.col(f.name), kinds[f.name], f.dataType, new.schema[f.name].dataType)
            elif default is None:
                value = F.lit(None).cast(f.dataType)
            elif default[:2] == ("call", "AI"):
                most = table.rows.agg(F.max(f.name)).first()[0] or 0
                value = (F.lit(most) + 1 + F.monotonically_increasing_id()).cast(f.dataType)
            else:
                value = self._stored(F.expr(compiler.expr(default)), kinds[f.name], f.dataType, T.StringType() if default[0] == "str" else None)
            out.append(value.alias(f.name))
        return new.select(*out)

    def _check_rows(self, name: str, table: Table, rows: DataFrame) -> None:
        """Rules that one row decides: NOT NULL, CHECK, bounds, lengths, labels."""
        bad: list[tuple[str, Column]] = []
        for f in table.declared():
            c, kind = F.col(f.name), f.kind
            base = kind.split("(")[0].split("<")[0]
            if f.not_null or f.name in table.pk:
                bad.append((f"{f.name} is NOT NULL", c.isNull()))
            if base in BOUNDS:
                low, high = BOUNDS[base]
                bad.append((f"{f.name} is out of range", (c < F.lit(low)) | (c > F.lit(high).cast("decimal(20,0)"))))
            elif base in ("VARCHAR", "CHAR") and "(" in kind:
                bad.append((f"{f.name} is too long", F.char_length(c) > int(kind[len(base) + 1 : -1])))
            elif base == "ENUM":
                bad.append((f"{f.name} has no such label", ~c.isin(*(unquote(x.strip()) for x in kind[5:-1].split(",")))))
            elif base in ("VECTOR", "BITVECTOR") and "<" in kind:
                size = int(split_type(kind)[-1])
                odd = F.exists(c, lambda x: F.isnan(x) | (F.abs(x) == float("inf")))
                if base == "BITVECTOR":
                    odd = F.exists(c, lambda x: (x != 0) & (x != 1))
                bad.append((f"{f.name} has {size} finite elements", (F.size(c) != size) | odd))
        compiler = self._compiler(name if name in self.tables else None)
        bad += [(f"CHECK {n}", ~F.expr(compiler.expr(e))) for n, e, _ in table.checks]
        bad += [("no partition takes the row", table.layout.part({f.name: f.dataType for f in table.rows.schema}).isNull())] if table.layout else []
        if not bad:
            return
        first = F.coalesce(*(F.when(F.coalesce(test, F.lit(False)), F.lit(text)) for text, test in bad))
        if broken := rows.select(first.alias("rule")).filter("rule IS NOT NULL").head(1):
            raise SqlError(f"{name}: {broken[0].rule}")

    def _check_keys(self, name: str, table: Table, old: DataFrame | None, new: DataFrame) -> None:
        """Primary and unique keys (a null counts as a value) stay unique."""
        uniques = [("the primary key", table.pk), *table.uniques, *((i.name, i.columns) for i in self.indexes.values() if i.table == name and i.unique)]
        for label, key in uniques:
            if not key:
                continue
            keys = new.select(*key)
            if old is not None:
                # only keys that are written need a look
                on = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in key]
                keys = keys.unionAll(old.alias("a").join(keys.distinct().alias("b"), on, "left_semi").select(*key))
            if not keys.groupBy(*key).count().filter("count > 1").isEmpty():
                raise SqlError(f"{name}: {label} is taken")

    def _check_parents(self, name: str, table: Table, new: DataFrame) -> None:
        for f in table.foreign:
            whole = new.dropna(subset=list(f.columns)).select(*f.columns)
            parent = new.select(*f.columns).toDF(*f.parent_columns) if f.parent == name else None
            keys = self.table(f.parent).rows.select(*f.parent_columns)
            keys = keys.unionAll(parent.select(*f.parent_columns)) if parent is not None else keys
            on = [F.col(f"a.{c}") == F.col(f"b.{k}") for c, k in zip(f.columns, f.parent_columns, strict=True)]
            if not whole.alias("a").join(keys.alias("b"), on, "left_anti").isEmpty():
                raise SqlError(f"{name}: {f.name}: no such row in {f.parent}")

    def _children(self, name: str) -> list[tuple[str, Foreign]]:
        return [(child, f) for child, t in self.tables.items() for f in t.foreign if f.parent == name]

    def _settle_children(self, name: str, gone: DataFrame, moved: DataFrame | None, depth: int) -> None:
        """Referential actions for parent rows that went (``gone``) or changed their key (``moved``: old and new_ columns)."""
        if depth > MAX_CASCADE:
            raise SqlError("the cascade is too deep")
        for child, f in self._children(name):
            keys = list(f.parent_columns)
            same = [F.col(f"_c.{c}") == F.col(f"_p.{k}") for c, k in zip(f.columns, keys, strict=True)]
            if moved is not None:
                changed = moved.filter(~F.struct(*keys).eqNullSafe(F.struct(*(f"new_{k}" for k in keys))))
                lost, action = changed, f.on_update
            else:
                lost, action = gone, f.on_delete
            table = self.table(child)
            lost = lost.dropna(subset=keys)
            hit = table.rows.alias("_c").join(lost.select(*keys).distinct().alias("_p"), same, "left_semi")
            if hit.isEmpty():
                continue
            if action == "RESTRICT":
                raise SqlError(f"{child}: {f.name}: rows still refer to {name}")
            hit = self._keep(hit)
            rest = table.rows.alias("_c").join(lost.select(*keys).distinct().alias("_p"), same, "left_anti")
            if action == "CASCADE" and moved is None:
                self._store(child, table, rest)
                self._log(child, table, "DELETE", hit, None)
                self._settle_children(child, hit, None, depth + 1)
                continue
            if action == "CASCADE":
                pair = lost.select(*keys, *(f"new_{k}" for k in keys))
                joined = hit.alias("_c").join(pair.alias("_p"), same)
                values = {c: F.col(f"_p.new_{k}") for c, k in zip(f.columns, keys, strict=True)}
                after = joined.select(*(values[c].alias(c) if c in values else F.col(f"_c.{c}") for c in hit.columns))
            else:
                compiler = self._compiler()
                defaults = {x.name: x.default for x in table.fields}
                value = lambda c: F.expr(compiler.expr(defaults[c])) if action == "SET DEFAULT" and defaults.get(c) else F.lit(None)  # noqa: B023, E731
                after = hit.select(*(value(c).cast(hit.schema[c].dataType).alias(c) if c in f.columns else F.col(c) for c in hit.columns))
            after = self._keep(after)
            self._check_rows(child, table, after)
            self._store(child, table, rest.unionByName(after))
            self._check_parents(child, self.table(child), after) if action == "SET DEFAULT" else None
            self._log(child, table, "UPDATE", hit, after)

    # versions

    def _laid(self, rows: DataFrame, layout: Layout | None) -> tuple[str, ...]:
        """Write rows in the table's layout; the folder, or one for each partition."""
        uri = self._fresh("table")
        if layout is None:
            rows.write.parquet(uri)
            return (uri,)
        rows.withColumn("_part", self._part_of(rows, layout)).write.partitionBy("_part").parquet(uri)
        return tuple(f"{uri}/{n}" for n in storage.folders(self.spark, uri) if n.startswith("_part="))

    def _part_of(self, rows: DataFrame, layout: Layout) -> Column:
        return layout.part({f.name: f.dataType for f in rows.schema})

    def _touched(self, layout: Layout, *sides: DataFrame) -> set[int]:
        """Numbers of the partitions that rows lie in."""
        return {r[0] for s in sides for r in s.select(self._part_of(s, layout)).distinct().collect()}  # as many as partitions at most

    def _read(self, uris: tuple[str, ...], schema: T.StructType, layout: Layout | None) -> DataFrame:
        if layout is None:
            return self.spark.read.schema(schema).parquet(*uris)
        schema = T.StructType([*schema.fields, T.StructField("_part", T.IntegerType())])
        roots: dict[str, list[str]] = {}
        for u in uris:
            roots.setdefault(u.rpartition("/")[0], []).append(u)
        frames = [self.spark.read.schema(schema).option("basePath", root).parquet(*own) for root, own in roots.items()]
        out = frames[0] if frames else self.spark.createDataFrame([], schema)
        for f in frames[1:]:
            out = out.unionByName(f)
        return out

    def _version(self, name: str, table: Table, uris: tuple[str, ...], schema: T.StructType) -> None:
        """Make files the table's rows; the partition's number is only seen by the scan."""
        full = self._read(uris, schema, table.layout)
        self._set(name, replace(table, rows=full.drop("_part") if table.layout else full, uris=uris), full)

    def _store(self, name: str, table: Table, rows: DataFrame, touched: set[int] | None = None) -> None:
        """A version of ``rows``; with ``touched`` only these partitions are written, others keep their files."""
        kept: tuple[str, ...] = ()
        if touched is not None and table.layout is not None and table.uris:
            kept = tuple(u for u in table.uris if int(u.rpartition("=")[2]) not in touched)
            rows = rows.filter(self._part_of(rows, table.layout).isin(*touched)) if touched else rows.limit(0)
        uris = self._laid(rows, table.layout)
        self._superseded += [u for u in table.uris if u not in kept]
        self._version(name, table, (*kept, *uris), rows.schema)
        self._stale(name)

    def _append(self, name: str, table: Table, new: DataFrame) -> None:
        if not table.uris:
            self._store(name, table, table.rows.unionByName(new))
            return
        uris = self._laid(new, table.layout)
        self._version(name, table, (*table.uris, *uris), table.rows.schema)
        self._extend(name, new)

    # statements

    def _insert(self, p: Parser, args: dict) -> DataFrame:
        p.need("INTO")
        name = p.name().lower()
        table = self.table(name)
        proposed = self._proposed(p, table, args)
        items = self._returning(p)
        p.done()
        new = self._keep(self._filled(name, table, proposed))
        self._check_rows(name, table, new)
        self._check_keys(name, table, table.rows, new)
        self._check_parents(name, table, new)
        self._append(name, table, new)
        self._log(name, table, "INSERT", None, new)
        return self._answer(name, new, items, args)

    def _target(self, name: str, table: Table, given: list[str]) -> tuple[str, ...]:
        """The key that UPSERT goes by when it names none."""
        if set(table.pk) <= set(given):
            return table.pk
        named = [c for _, c in table.uniques] + [i.columns for i in self.indexes.values() if i.table == name and i.unique]
        fits = [c for c in named if set(c) <= set(given)]
        if len(fits) != 1:
            raise SqlError("UPSERT requires ON UNIQUE")
        return fits[0]

    def _upsert(self, p: Parser, args: dict) -> DataFrame:
        """Proposed rows in order: each one inserts or changes what stands under its key."""
        p.need("INTO")
        name = p.name().lower()
        table = self.table(name)
        proposed = self._proposed(p, table, args)
        given = proposed.columns
        key = None
        if p.take("ON", "UNIQUE"):
            p.need("(")
            key = tuple(p.listed(p.name))
            p.need(")")
            known = [set(table.pk), *(set(c) for _, c in table.uniques), *(set(i.columns) for i in self.indexes.values() if i.table == name and i.unique)]
            if set(key) not in known:
                raise SqlError("ON UNIQUE names no unique key")
        key = key or self._target(name, table, given)
        changes = self._assignments(p) if p.take("SET") else None
        items = self._returning(p)
        p.done()
        new = self._filled(name, table, proposed).withColumn("_seq", F.monotonically_increasing_id())
        new = self._keep(new)
        turn = Window.partitionBy(*key).orderBy("_seq")
        if changes is None:  # the last proposed row of a key decides
            new = new.withColumn("_turn", F.row_number().over(Window.partitionBy(*key).orderBy(F.col("_seq").desc()))).filter("_turn = 1")
            rounds = [new.drop("_turn")]
            changes_of = {c: ("name", ["excluded", c]) for c in given if c not in table.pk and c not in key}
        else:
            new = self._keep(new.withColumn("_turn", F.row_number().over(turn)))
            most = new.agg(F.max("_turn")).first()[0] or 0
            rounds = [new.filter(F.col("_turn") == k + 1).drop("_turn") for k in range(most)]
            changes_of = changes
        rows, written = table.rows, None
        for one in rounds:
            rows, touched = self._merged(name, table, rows, one.drop("_seq"), key, changes_of, args)
            rows, touched = self._keep(rows), self._keep(touched)
            if written is not None:
                on = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in key]
                earlier = written.alias("a").join(touched.alias("b"), on, "left_anti").select(written.columns)
                first = written.alias("a").join(touched.alias("b"), on).select("b.*", F.col("a._before").alias("_earlier"))
                touched = self._keep(earlier.unionByName(first.withColumn("_before", F.col("_earlier")).drop("_earlier")))
            written = touched
        if written is None:
            return self._answer(name, table.rows.limit(0), items, args)
        plain = written.select(*table.rows.columns)
        self._check_rows(name, table, plain)
        self._check_keys(name, table, None, rows)
        self._check_parents(name, table, plain)
        self._store(name, table, rows)
        fresh = written.filter("_before IS NULL")
        old = written.filter("_before IS NOT NULL")
        self._log(name, table, "INSERT", None, fresh.select(*table.rows.columns))
        self._log(name, table, "UPDATE", old.select("_before.*"), old.select(*table.rows.columns))
        return self._answer(name, written.drop("_before"), items, args)

    def _merged(self, name: str, table: Table, rows: DataFrame, new: DataFrame, key: tuple[str, ...], changes: dict, args: dict) -> tuple[DataFrame, DataFrame]:
        """All rows after one proposed row for each key, and those written (with _before and excluded)."""
        columns = table.rows.columns
        old = rows.select("*", F.struct(*columns).alias("_before"))
        side = new.select(F.struct(*columns).alias("excluded"))
        on = None
        for k in key:
            same = F.col(k).eqNullSafe(F.col(f"excluded.{k}"))
            on = same if on is None else on & same
        joined = old.join(side, on, "full")
        joined.createOrReplaceTempView(view := f"{self._view(name)}_merge")
        compiler = self._compiler()
        kinds = {f.name: f.dataType.simpleString() for f in table.rows.schema}
        test = lambda c: f"CAST({compiler.expr(changes[c])} AS {kinds[c]})" if c in changes else quote(c)
        values = [f"CASE WHEN _before IS NULL THEN excluded.{quote(c)} WHEN excluded IS NULL THEN {quote(c)} ELSE {test(c)} END AS {quote(c)}" for c in columns]
        full = self._spark(f"SELECT {', '.join(values)}, _before, excluded FROM {quote(view)} AS {quote(name)}", compiler, args)
        full = self._keep(full)
        return full.select(*columns), full.filter("excluded IS NOT NULL")

    def _assignments(self, p: Parser) -> dict:
        out = {}
        while True:
            column = p.name()
            p.need("=")
            out[column] = p._sum()
            if not p.take(","):
                return out

    def _chosen(self, p: Parser, name: str, table: Table, args: dict) -> tuple[DataFrame, DataFrame, list | None]:
        """Rows that WHERE and LIMIT (in key order) choose, the rest, and RETURNING's items."""
        where = p.expr() if p.take("WHERE") else None
        limit = p.expr() if p.take("LIMIT") else None
        items = self._returning(p)
        p.done()
        compiler = self._compiler(name)
        test = f"coalesce({compiler.expr(where)}, FALSE)" if where is not None else "TRUE"
        flagged = self._spark(f"SELECT *, {test} AS _hit FROM {quote(self._view(name))} AS {quote(name)}", compiler, args).drop("_part")
        hit = flagged.filter("_hit").drop("_hit")
        rest = flagged.filter("NOT _hit").drop("_hit")
        if limit is not None:
            hit = self._keep(hit.orderBy(*table.pk).limit(int(self._value(limit, args))))
            on = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in table.pk]
            rest = table.rows.alias("a").join(hit.select(*table.pk).alias("b"), on, "left_anti")
        return hit, rest, items

    def _update(self, p: Parser, args: dict) -> DataFrame:
        name = p.name().lower()
        table = self.table(name)
        p.need("SET")
        changes = self._assignments(p)
        hit, rest, items = self._chosen(p, name, table, args)
        hit.createOrReplaceTempView(view := f"{self._view(name)}_hit")
        compiler = self._compiler(name)
        columns = table.rows.columns
        kinds = {f.name: f.kind for f in table.declared()}
        new = [f"{compiler.expr(changes[c])} AS {quote('new_' + c)}" if c in changes else f"{quote(c)} AS {quote('new_' + c)}" for c in columns]
        both = self._spark(f"SELECT *, {', '.join(new)} FROM {quote(view)} AS {quote(name)}", compiler, args)
        cast = [self._stored(F.col(f"new_{f.name}"), kinds[f.name], f.dataType, both.schema[f"new_{f.name}"].dataType).alias(f"new_{f.name}") for f in table.rows.schema]
        both = self._keep(both.select(*columns, *cast))
        after = both.select(*(F.col(f"new_{c}").alias(c) for c in columns))
        self._check_rows(name, table, after)
        whole = rest.unionByName(after)
        if set(changes) & {*table.pk, *(c for _, k in table.uniques for c in k), *(c for i in self.indexes.values() if i.table == name and i.unique for c in i.columns)}:
            self._check_keys(name, table, rest, after)
        if set(changes) & {c for f in table.foreign for c in f.columns}:
            self._check_parents(name, table, after)
        self._store(name, table, whole, self._touched(table.layout, hit, after) if table.layout else None)
        if set(changes) & {k for _, f in self._children(name) for k in f.parent_columns}:
            self._settle_children(name, both, both, 1)
        self._log(name, table, "UPDATE", both.select(*columns), after)
        return self._answer(name, after, items, args)

    def _delete(self, p: Parser, args: dict) -> DataFrame:
        p.need("FROM")
        name = p.name().lower()
        table = self.table(name)
        hit, rest, items = self._chosen(p, name, table, args)
        hit = self._keep(hit)
        self._store(name, table, rest, self._touched(table.layout, hit) if table.layout else None)
        self._settle_children(name, hit, None, 1)
        self._log(name, table, "DELETE", hit, None)
        return self._answer(name, hit, items, args)
