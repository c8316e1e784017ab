"""Cells of points for a spatial index: Morton codes and the ranges that cover a box."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from quillon.functions import geo
from quillon.sources.storage import fresh

BITS = 31
MOST_RANGES = 32


def _cover(west: int, south: int, east: int, north: int, most: int) -> list[tuple[int, int]]:
    """Ranges of Morton codes, at most ``most``, that hold every cell of a rectangle."""

    def code(x: int, y: int) -> int:
        return sum(((x >> b & 1) << (2 * b)) | ((y >> b & 1) << (2 * b + 1)) for b in range(BITS))

    todo, out = [(0, 0, BITS)], []
    while todo and len(todo) + len(out) < most:
        x, y, size = todo.pop(0)
        side = 1 << size
        if x > east or y > north or x + side - 1 < west or y + side - 1 < south:
            continue
        if (west <= x and x + side - 1 <= east and south <= y and y + side - 1 <= north) or not size:
            out.append((x, y, size))
            continue
        half = side >> 1
        todo += [(x + i * half, y + j * half, size - 1) for j in (0, 1) for i in (0, 1)]
    ranges = sorted((c, c + (1 << (2 * size)) - 1) for c, size in ((code(x, y), size) for x, y, size in out + todo if not (x > east or y > north or x + (1 << size) - 1 < west or y + (1 << size) - 1 < south)))
    merged: list[tuple[int, int]] = []
    for a, b in ranges:
        if merged and a <= merged[-1][1] + 1:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    return merged


def cover(west: float, south: float, east: float, north: float, most: int = MOST_RANGES) -> list[tuple[int, int]]:
    """Ranges that hold the codes of all points in a box (west may exceed east)."""
    if west > east:
        return sorted(cover(west, south, 180.0, north, most) + cover(-180.0, south, east, north, most))
    cell = lambda v, low, span: min(max(int(math.floor((v - low) / span * (1 << BITS))), 0), (1 << BITS) - 1)
    return _cover(cell(west, -180, 360), cell(south, -90, 180), cell(east, -180, 360), cell(north, -90, 180), most)


def around(lon: float, lat: float, metres: float) -> tuple[float, float, float, float]:
    """A box that holds the circle around a point."""
    reach = math.degrees(metres / geo.EARTH) * (1 + 1e-9)
    south, north = max(lat - reach, -90.0), min(lat + reach, 90.0)
    if abs(lat) + reach >= 89.9:
        return -180.0, south, 180.0, north
    wide = math.degrees(math.asin(min(1.0, math.sin(math.radians(reach)) / math.cos(math.radians(lat))))) * (1 + 1e-9)
    if wide >= 180:
        return -180.0, south, 180.0, north
    west, east = lon - wide, lon + wide
    return west + 360 if west < -180 else west, south, east - 360 if east > 180 else east, north


@dataclass
class Cells:
    """Rows sorted by the Morton code of a point: a box reads only the row groups of its ranges."""

    uri: str
    column: str
    schema: StructType
    spark: object

    @classmethod
    def build(cls, rows: DataFrame, column: str) -> Cells:
        spark = rows.sparkSession
        coded = rows.withColumn("_cell", F.when(F.col(column).isNotNull(), geo.geohash(F.col(column), BITS)))
        uri = fresh(spark, "cells")
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        coded.repartitionByRange(parts, "_cell").sortWithinPartitions("_cell").write.parquet(uri)
        return cls(uri, column, coded.schema, spark)

    def within(self, west: float, south: float, east: float, north: float) -> DataFrame:
        """All rows that may lie in a box; the exact test is the caller's."""
        rows = self.spark.read.schema(self.schema).parquet(self.uri)
        test: Column = F.lit(False)
        for a, b in cover(west, south, east, north):
            test = test | F.col("_cell").between(a, b)
        return rows.filter(test).drop("_cell")
