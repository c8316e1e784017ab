"""Points and boxes on the sphere as native trigonometry (degrees, metres)."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

EARTH = 6371008.8  # mean radius, metres


def point(lon: Column, lat: Column) -> Column:
    """A point; longitudes and latitudes out of range are errors."""
    bad = (F.abs(lon) > 180) | (F.abs(lat) > 90)
    return F.when(bad, F.raise_error(F.lit("POINT out of range"))).otherwise(F.struct(lon.cast("double").alias("lon"), lat.cast("double").alias("lat")))


def box(west: Column, south: Column, east: Column, north: Column) -> Column:
    """A box; west may exceed east, the box then crosses the antimeridian."""
    return F.struct(west.alias("w"), south.alias("s"), east.alias("e"), north.alias("n"))


def distance(a: Column, b: Column) -> Column:
    """Great-circle (haversine) distance of two points."""
    p, q = F.radians(a["lat"]), F.radians(b["lat"])
    dp, dl = q - p, F.radians(b["lon"] - a["lon"])
    h = F.pow(F.sin(dp / 2), 2) + F.cos(p) * F.cos(q) * F.pow(F.sin(dl / 2), 2)
    return 2 * EARTH * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def within_box(p: Column, b: Column, strict: bool = True) -> Column:
    """WITHIN (strict) or COVERS (with the border) of a point in a box."""
    lon, lat = p["lon"], p["lat"]
    over, under = (lambda x, y: x > y, lambda x, y: x < y) if strict else (lambda x, y: x >= y, lambda x, y: x <= y)
    across = F.when(b["w"] <= b["e"], over(lon, b["w"]) & under(lon, b["e"])).otherwise(over(lon, b["w"]) | under(lon, b["e"]))
    return across & over(lat, b["s"]) & under(lat, b["n"])


def dwithin(a: Column, lon: float, lat: float, metres: float) -> Column:
    """Within a distance of a fixed point: cheap bounds first, then the distance."""
    reach = math.degrees(metres / EARTH) * (1 + 1e-9)
    near = F.abs(a["lat"] - lat) <= reach
    pole = abs(lat) + reach
    if pole < 89.9:
        wide = math.degrees(math.asin(min(1.0, math.sin(math.radians(reach)) / math.cos(math.radians(lat))))) * (1 + 1e-9)
        delta = F.abs(a["lon"] - lon)
        near = near & (F.least(delta, 360 - delta) <= wide)
    return near & (distance(a, F.struct(F.lit(lon).alias("lon"), F.lit(lat).alias("lat"))) <= metres)


def geohash(p: Column, bits: int = 31) -> Column:
    """Morton code of a point: ``bits`` bits of each coordinate, interleaved."""
    cell = lambda v, low, span: F.least(F.floor((v - low) / span * (1 << bits)), F.lit((1 << bits) - 1)).cast("long")
    return _spread(cell(p["lon"], -180.0, 360.0)).bitwiseOR(F.shiftleft(_spread(cell(p["lat"], -90.0, 180.0)), 1))


def _spread(v: Column) -> Column:
    """Bits of a number below 2**32 moved to the even places."""
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))
    return v
