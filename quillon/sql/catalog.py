"""What the engine knows of a table besides its rows."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from quillon.sql.parser import SqlError

_TYPES = {
    "STRING": "STRING", "TEXT": "STRING", "UUID": "STRING", "BLOB": "BINARY", "BOOL": "BOOLEAN", "INT8": "TINYINT", "INT16": "SMALLINT",
    "INT32": "INT", "INT64": "BIGINT", "UINT8": "SMALLINT", "UINT16": "INT", "UINT32": "BIGINT", "UINT64": "DECIMAL(20,0)", "FLOAT32": "FLOAT", "FLOAT64": "DOUBLE",
    "DATE": "DATE", "TIMESTAMP": "TIMESTAMP_NTZ", "TIMESTAMPTZ": "TIMESTAMP", "JSON": "VARIANT", "VARCHAR": "STRING", "CHAR": "STRING", "ENUM": "STRING",
    "INTERVAL": "STRUCT<months: INT, days: INT, micros: BIGINT>", "POINT": "STRUCT<lon: DOUBLE, lat: DOUBLE>", "LOCATION": "STRUCT<lon: DOUBLE, lat: DOUBLE>",
    "BOX": "STRUCT<w: DOUBLE, s: DOUBLE, e: DOUBLE, n: DOUBLE>", "LINESTRING": "STRING", "POLYGON": "STRING", "GEOMETRY": "STRING", "GEOGRAPHY": "STRING",
    "VECTOR": "ARRAY<FLOAT>", "BITVECTOR": "ARRAY<FLOAT>", "SPARSEVECTOR": "STRUCT<dim: INT, idx: ARRAY<INT>, val: ARRAY<FLOAT>>",
}

#: Integer types that hold more than the dialect's type: (least, most).
BOUNDS = {"UINT8": (0, 2**8 - 1), "UINT16": (0, 2**16 - 1), "UINT32": (0, 2**32 - 1), "UINT64": (0, 2**64 - 1)}


def split_type(kind: str) -> list[str]:
    """Arguments of a type at its first level of brackets."""
    inner, depth, out = kind[kind.index("<") + 1 : -1], 0, [""]
    for ch in inner:
        depth += (ch in "<(") - (ch in ">)")
        if ch == "," and not depth:
            out.append("")
        else:
            out[-1] += ch
    return [x.strip() for x in out]


def spark_type(kind: str) -> str:
    """Spark's name of a type of the dialect."""
    base = re.match(r"\w+", kind)[0]
    if base in ("DECIMAL", "NUMERIC"):
        return kind.replace("NUMERIC", "DECIMAL")
    if base == "ARRAY":
        return f"ARRAY<{spark_type(split_type(kind)[0])}>"
    if base == "MAP":
        return "MAP<" + ", ".join(map(spark_type, split_type(kind))) + ">"
    if base == "STRUCT":
        return "STRUCT<" + ", ".join(f"`{n}`: {spark_type(t)}" for n, _, t in (f.partition(" ") for f in split_type(kind))) + ">"
    if base not in _TYPES:
        raise SqlError(f"unknown type {kind}")
    return _TYPES[base]


@dataclass(frozen=True)
class Field:
    name: str
    kind: str  # in the dialect
    not_null: bool = False
    default: tuple | None = None  # an expression


@dataclass(frozen=True)
class Foreign:
    name: str
    columns: tuple[str, ...]
    parent: str
    parent_columns: tuple[str, ...]
    on_delete: str = "RESTRICT"
    on_update: str = "RESTRICT"


@dataclass(frozen=True)
class Index:
    """A secondary index: what was asked for and the side table that holds it."""

    name: str
    table: str
    kind: str  # BTREE, FULLTEXT, VECTOR, SPATIAL
    columns: tuple[str, ...]
    unique: bool = False
    keys: tuple = ()  # expressions of a BTREE index
    include: tuple[str, ...] = ()
    where: tuple | None = None
    where_text: str = ""
    using: str = ""
    options: tuple = ()
    data: object = None  # what reads it; None until built

    def option(self, name: str, default=None):
        return dict(self.options).get(name, default)


@dataclass(frozen=True)
class Partition:
    name: str
    less_than: tuple | None = None  # RANGE (None: MAXVALUE)
    values: tuple = ()  # LIST: tuples
    remainder: int = 0  # HASH


@dataclass(frozen=True)
class Layout:
    """PARTITION BY: where a row goes is a derived column ``_part`` of the file layout."""

    kind: str
    columns: tuple[str, ...]
    partitions: tuple[Partition, ...]

    def part(self, types: dict[str, str]) -> Column:
        """Number of a row's partition; null if no partition takes it."""
        cols = [F.col(c) for c in self.columns]
        lit = lambda v, c: F.lit(v).cast(types[c])
        if self.kind == "HASH":
            return F.pmod(F.xxhash64(*cols), F.lit(len(self.partitions))).cast("int")
        out = F.lit(None).cast("int")
        for k in reversed(range(len(self.partitions))):
            p = self.partitions[k]
            if self.kind == "LIST":
                rows = [[lit(v, c) for v, c in zip(row, self.columns, strict=True)] for row in p.values]
                hit = F.lit(False)
                for row in rows:
                    same = F.lit(True)
                    for c, v in zip(cols, row, strict=True):
                        same = same & c.eqNullSafe(v)
                    hit = hit | same
            elif p.less_than is None:
                hit = F.lit(True)
            else:
                hit = F.struct(*cols) < F.struct(*(lit(v, c) for v, c in zip(p.less_than, self.columns, strict=True)))
            out = F.when(hit, F.lit(k)).otherwise(out)
        return out


@dataclass(frozen=True)
class Table:
    """A version of a table: rows, primary key, analyser of its text columns, rules."""

    rows: DataFrame
    pk: tuple[str, ...]
    analyzer: str = "simple"
    fields: tuple[Field, ...] = ()
    checks: tuple[tuple[str, tuple, str], ...] = ()  # name, expression, text
    uniques: tuple[tuple[str, tuple[str, ...]], ...] = ()
    foreign: tuple[Foreign, ...] = ()
    images: str = "KEYS"
    layout: Layout | None = None
    uris: tuple[str, ...] = ()  # files of the rows, if the engine wrote all of them
    statistics: dict = field(default_factory=dict)

    def declared(self) -> tuple[Field, ...]:
        """Columns as declared, or as the rows have them."""
        return self.fields or tuple(Field(f.name, f.dataType.simpleString().upper(), f.name in self.pk) for f in self.rows.schema)
