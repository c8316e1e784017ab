"""General geometries (ST_ functions) on WKT text, in Arrow batches.

A geometry column is text: WKT, or EWKT with its SRID in front; a geography's
has GEOGRAPHY before that. ``st`` makes a Column of any function here. Planar
for geometries; lengths, distances and areas of geographies are on the sphere.
"""

from __future__ import annotations

import json
import math
import re
import struct
from dataclasses import dataclass, replace
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, functions as F

from quillon.functions.geo import EARTH

KINDS = ("POINT", "LINESTRING", "POLYGON", "MULTIPOINT", "MULTILINESTRING", "MULTIPOLYGON", "GEOMETRYCOLLECTION")
_NAMES = dict(zip(KINDS, ("Point", "LineString", "Polygon", "MultiPoint", "MultiLineString", "MultiPolygon", "GeometryCollection"), strict=True))
_GEOGRAPHY = "GEOGRAPHY "
_MEMBER = {"MULTIPOINT": "POINT", "MULTILINESTRING": "LINESTRING", "MULTIPOLYGON": "POLYGON"}


@dataclass(frozen=True)
class Geometry:
    """``data``: a pair, pairs, rings of pairs, or member geometries (empty: ())."""

    kind: str
    data: tuple
    srid: int = 0
    geography: bool = False

    @property
    def empty(self) -> bool:
        return not self.data or (self.kind in KINDS[3:] and all(m.empty for m in self.data))

    def parts(self) -> list[Geometry]:
        return [p for m in self.data for p in m.parts()] if self.kind in KINDS[3:] else [] if self.empty else [self]

    def points(self) -> list[tuple[float, float]]:
        if self.kind in KINDS[3:]:
            return [p for m in self.data for p in m.points()]
        if self.empty:
            return []
        return [self.data] if self.kind == "POINT" else list(self.data) if self.kind == "LINESTRING" else [p for r in self.data for p in r]

    def segments(self) -> list[tuple]:
        out = []
        for p in self.parts():
            for line in [p.data] if p.kind == "LINESTRING" else p.data if p.kind == "POLYGON" else []:
                out += zip(line[:-1], line[1:], strict=True)
        return out


# text and binary forms


@lru_cache(maxsize=4096)
def parse(text: str) -> Geometry:
    """A geometry from its text; texts that come again are parsed once for each worker."""
    srid = 0
    if text.startswith(_GEOGRAPHY):
        return replace(parse(text[len(_GEOGRAPHY) :]), geography=True)
    if m := re.match(r"\s*SRID=(\d+);", text, re.IGNORECASE):
        srid, text = int(m[1]), text[m.end() :]
    tokens = re.findall(r"[A-Za-z]+|[-+]?\d*\.?\d+(?:[eE][-+]?\d+)?|[(),]", text)
    if "".join(tokens).replace(" ", "") != re.sub(r"\s+", "", text):
        raise ValueError("malformed WKT")
    at = 0

    def take(want: str | None = None) -> str:
        nonlocal at
        if at >= len(tokens) or (want and tokens[at] != want):
            raise ValueError("malformed WKT")
        at += 1
        return tokens[at - 1]

    def pair() -> tuple[float, float]:
        p = float(take()), float(take())
        if not all(map(math.isfinite, p)):
            raise ValueError("coordinates must be finite")
        return p

    def several(item) -> tuple:
        take("(")
        out = [item()]
        while tokens[at : at + 1] == [","]:
            take()
            out.append(item())
        take(")")
        return tuple(out)

    def bare() -> tuple[float, float]:
        if tokens[at : at + 1] == ["("]:
            take()
            p = pair()
            take(")")
            return p
        return pair()

    def line() -> tuple:
        return several(pair)

    def one() -> Geometry:
        kind = take().upper()
        if kind not in KINDS:
            raise ValueError(f"unknown geometry {kind}")
        if tokens[at : at + 1] and tokens[at].upper() == "EMPTY":
            take()
            return Geometry(kind, (), srid)
        if kind == "POINT":
            return Geometry(kind, several(pair)[0], srid)
        if kind == "LINESTRING":
            return Geometry(kind, line(), srid)
        if kind == "POLYGON":
            return Geometry(kind, several(line), srid)
        if kind == "MULTIPOINT":
            return Geometry(kind, tuple(Geometry("POINT", p, srid) for p in several(bare)), srid)
        if kind == "MULTILINESTRING":
            return Geometry(kind, tuple(Geometry("LINESTRING", x, srid) for x in several(line)), srid)
        if kind == "MULTIPOLYGON":
            return Geometry(kind, tuple(Geometry("POLYGON", x, srid) for x in several(lambda: several(line))), srid)
        return Geometry(kind, several(one), srid)

    out = one()
    if at != len(tokens):
        raise ValueError("malformed WKT")
    _check(out)
    return out


def _check(g: Geometry) -> None:
    for p in g.parts():
        if p.kind == "LINESTRING" and len(p.data) < 2:
            raise ValueError("a line has two points at least")
        if p.kind == "POLYGON" and any(len(r) < 4 or r[0] != r[-1] for r in p.data):
            raise ValueError("a ring is closed and has four points at least")


def _number(x: float) -> str:
    return str(int(x)) if x == int(x) and abs(x) < 1e15 else repr(x)


def as_text(g: Geometry) -> str:
    def pair(p):
        return f"{_number(p[0])} {_number(p[1])}"

    def line(x):
        return "(" + ",".join(map(pair, x)) + ")"

    def inner(g):
        if g.kind == "POINT":
            return f"({pair(g.data)})"
        if g.kind == "LINESTRING":
            return line(g.data)
        if g.kind == "POLYGON":
            return "(" + ",".join(map(line, g.data)) + ")"
        return "(" + ",".join(as_text(m) if g.kind == KINDS[6] else inner(m) for m in g.data) + ")"

    return f"{g.kind} EMPTY" if not g.data else g.kind + inner(g)


def as_ewkt(g: Geometry) -> str:
    return (f"SRID={g.srid};" if g.srid else "") + as_text(g)


def as_binary(g: Geometry, with_srid: bool = False) -> bytes:
    code = KINDS.index(g.kind) + 1
    head = struct.pack("<BI", 1, code | (0x20000000 if with_srid and g.srid else 0)) + (struct.pack("<I", g.srid) if with_srid and g.srid else b"")
    line = lambda x: struct.pack("<I", len(x)) + b"".join(struct.pack("<2d", *p) for p in x)
    if g.kind == "POINT":
        return head + struct.pack("<2d", *(g.data or (math.nan, math.nan)))
    if g.kind == "LINESTRING":
        return head + line(g.data)
    if g.kind == "POLYGON":
        return head + struct.pack("<I", len(g.data)) + b"".join(map(line, g.data))
    return head + struct.pack("<I", len(g.data)) + b"".join(as_binary(m) for m in g.data)


def as_geojson(g: Geometry) -> str:
    def shape(g):
        if g.kind == KINDS[6]:
            return {"type": _NAMES[g.kind], "geometries": [shape(m) for m in g.data]}
        return {"type": _NAMES[g.kind], "coordinates": [shape(m)["coordinates"] for m in g.data] if g.kind in KINDS[3:] else g.data}

    return json.dumps(shape(g), separators=(",", ":"))


def from_geojson(text: str) -> Geometry:
    def deep(x):
        return tuple(map(deep, x)) if isinstance(x, list) else float(x)

    def build(o):
        kind = o["type"].upper()
        if kind == KINDS[6]:
            return Geometry(kind, tuple(build(m) for m in o["geometries"]), 4326)
        data = deep(o["coordinates"])
        return Geometry(kind, tuple(Geometry(_MEMBER[kind], m, 4326) for m in data) if kind in _MEMBER else data, 4326)

    out = build(json.loads(text))
    _check(out)
    return out


# accessors


def set_srid(g: Geometry, srid: int) -> Geometry:
    return Geometry(g.kind, tuple(set_srid(m, srid) for m in g.data) if g.kind in KINDS[3:] else g.data, int(srid))


def _mapped(g: Geometry, f) -> Geometry:
    if g.kind in KINDS[3:]:
        return Geometry(g.kind, tuple(_mapped(m, f) for m in g.data), g.srid)
    if g.empty:
        return g
    if g.kind == "POINT":
        return Geometry(g.kind, f(g.data), g.srid)
    return Geometry(g.kind, tuple(map(f, g.data)) if g.kind == "LINESTRING" else tuple(tuple(map(f, r)) for r in g.data), g.srid)


def transform(g: Geometry, srid: int) -> Geometry:
    """Between 4326 and 3857 only."""
    radius = 6378137.0
    if g.srid == srid:
        return g
    if (g.srid, srid) == (4326, 3857):
        f = lambda p: (math.radians(p[0]) * radius, math.log(math.tan(math.pi / 4 + math.radians(p[1]) / 2)) * radius)
    elif (g.srid, srid) == (3857, 4326):
        f = lambda p: (math.degrees(p[0] / radius), math.degrees(2 * math.atan(math.exp(p[1] / radius)) - math.pi / 2))
    else:
        raise ValueError("only 4326 and 3857 are known")
    return set_srid(_mapped(g, f), srid)


def x(g: Geometry) -> float | None:
    return _point(g)[0]


def y(g: Geometry) -> float | None:
    return _point(g)[1]


def _point(g: Geometry):
    if g.kind != "POINT":
        raise ValueError("not a point")
    return g.data or (None, None)


def dimension(g: Geometry) -> int:
    return max((KINDS.index(p.kind) for p in g.parts()), default=0)


def num_geometries(g: Geometry) -> int:
    return len(g.data) if g.kind in KINDS[3:] else 0 if g.empty else 1


def geometry_n(g: Geometry, n: int) -> Geometry | None:
    members = g.data if g.kind in KINDS[3:] else (g,)
    return members[n - 1] if 1 <= n <= len(members) else None


def _line(g: Geometry) -> tuple:
    if g.kind != "LINESTRING":
        raise ValueError("not a line")
    return g.data


def point_n(g: Geometry, n: int) -> Geometry | None:
    return Geometry("POINT", _line(g)[n - 1], g.srid) if 1 <= n <= len(_line(g)) else None


def end_point(g: Geometry) -> Geometry | None:
    return point_n(g, len(_line(g)))


def exterior_ring(g: Geometry) -> Geometry:
    return Geometry("LINESTRING", g.data[0], g.srid)


def interior_ring_n(g: Geometry, n: int) -> Geometry | None:
    return Geometry("LINESTRING", g.data[n], g.srid) if 1 <= n < len(g.data) else None


def boundary(g: Geometry) -> Geometry:
    rings = [Geometry("LINESTRING", r, g.srid) for p in g.parts() if p.kind == "POLYGON" for r in p.data]
    if rings:
        return rings[0] if len(rings) == 1 else Geometry("MULTILINESTRING", tuple(rings), g.srid)
    ends = [Geometry("POINT", e, g.srid) for p in g.parts() if p.kind == "LINESTRING" and p.data[0] != p.data[-1] for e in (p.data[0], p.data[-1])]
    return Geometry("MULTIPOINT", tuple(ends), g.srid)


def reverse(g: Geometry) -> Geometry:
    if g.kind in KINDS[3:]:
        return Geometry(g.kind, tuple(map(reverse, g.data)), g.srid)
    return g if g.kind == "POINT" else Geometry(g.kind, g.data[::-1] if g.kind == "LINESTRING" else tuple(r[::-1] for r in g.data), g.srid)


# measures


def haversine(p, q) -> float:
    a, b = math.radians(p[1]), math.radians(q[1])
    h = math.sin((b - a) / 2) ** 2 + math.cos(a) * math.cos(b) * math.sin(math.radians(q[0] - p[0]) / 2) ** 2
    return 2 * EARTH * math.asin(min(1.0, math.sqrt(h)))


def spheroid(p, q) -> float:
    """Vincenty's inverse formula on WGS84; haversine where it does not settle."""
    a, f = 6378137.0, 1 / 298.257223563
    b = a * (1 - f)
    u, v = (math.atan((1 - f) * math.tan(math.radians(t[1]))) for t in (p, q))
    gap = lam = math.radians(q[0] - p[0])
    for _ in range(200):
        sin_s = math.hypot(math.cos(v) * math.sin(lam), math.cos(u) * math.sin(v) - math.sin(u) * math.cos(v) * math.cos(lam))
        if sin_s == 0:
            return 0.0
        cos_s = math.sin(u) * math.sin(v) + math.cos(u) * math.cos(v) * math.cos(lam)
        sigma = math.atan2(sin_s, cos_s)
        sin_a = math.cos(u) * math.cos(v) * math.sin(lam) / sin_s
        cos2 = 1 - sin_a**2
        mid = cos_s - 2 * math.sin(u) * math.sin(v) / cos2 if cos2 else 0.0
        c = f / 16 * cos2 * (4 + f * (4 - 3 * cos2))
        old, lam = lam, gap + (1 - c) * f * sin_a * (sigma + c * sin_s * (mid + c * cos_s * (2 * mid**2 - 1)))
        if abs(lam - old) < 1e-12:
            k = cos2 * (a * a - b * b) / (b * b)
            big = 1 + k / 16384 * (4096 + k * (-768 + k * (320 - 175 * k)))
            small = k / 1024 * (256 + k * (-128 + k * (74 - 47 * k)))
            step = small * sin_s * (mid + small / 4 * (cos_s * (2 * mid**2 - 1) - small / 6 * mid * (4 * sin_s**2 - 3) * (4 * mid**2 - 3)))
            return b * big * (sigma - step)
    return haversine(p, q)


def _ring_area(r) -> float:
    return sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(r[:-1], r[1:], strict=True)) / 2


def _sphere_area(r) -> float:
    total = sum(math.radians(q[0] - p[0]) * (2 + math.sin(math.radians(p[1])) + math.sin(math.radians(q[1]))) for p, q in zip(r[:-1], r[1:], strict=True))
    return abs(total) * EARTH**2 / 2


def area(g: Geometry, geography: bool = False) -> float:
    measure = _sphere_area if geography else lambda r: abs(_ring_area(r))
    return float(sum(measure(p.data[0]) - sum(map(measure, p.data[1:])) for p in g.parts() if p.kind == "POLYGON"))


def _walk(lines, geography: bool) -> float:
    step = haversine if geography else math.dist
    return float(sum(step(p, q) for line in lines for p, q in zip(line[:-1], line[1:], strict=True)))


def length(g: Geometry, geography: bool = False) -> float:
    return _walk([p.data for p in g.parts() if p.kind == "LINESTRING"], geography)


def perimeter(g: Geometry, geography: bool = False) -> float:
    return _walk([r for p in g.parts() if p.kind == "POLYGON" for r in p.data], geography)


def centroid(g: Geometry) -> Geometry:
    polygons = [p for p in g.parts() if p.kind == "POLYGON"]
    lines = [s for p in g.parts() if p.kind == "LINESTRING" for s in p.segments()]
    if polygons:
        weight = sx = sy = 0.0
        for p in polygons:
            for i, r in enumerate(p.data):
                sign = (1 if i == 0 else -1) * (1 if _ring_area(r) >= 0 else -1)
                for (ax, ay), (bx, by) in zip(r[:-1], r[1:], strict=True):
                    cross = (ax * by - bx * ay) * sign
                    weight += cross / 2
                    sx += (ax + bx) * cross / 6
                    sy += (ay + by) * cross / 6
    elif lines:
        weight = sum(math.dist(p, q) for p, q in lines)
        sx, sy = (sum((p[i] + q[i]) / 2 * math.dist(p, q) for p, q in lines) for i in (0, 1))
    else:
        pts = g.points()
        weight, sx, sy = len(pts), sum(p[0] for p in pts), sum(p[1] for p in pts)
    return Geometry("POINT", (sx / weight, sy / weight) if weight else (), g.srid)


def envelope(g: Geometry) -> Geometry:
    pts = g.points()
    if not pts:
        return Geometry("POLYGON", (), g.srid)
    (w, s), (e, n) = (min(p[0] for p in pts), min(p[1] for p in pts)), (max(p[0] for p in pts), max(p[1] for p in pts))
    return Geometry("POLYGON", (((w, s), (e, s), (e, n), (w, n), (w, s)),), g.srid)


# predicates


def _turn(a, b, c) -> float:
    return (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])


def _on(a, b, p) -> bool:
    return _turn(a, b, p) == 0 and min(a[0], b[0]) <= p[0] <= max(a[0], b[0]) and min(a[1], b[1]) <= p[1] <= max(a[1], b[1])


def _cross(a, b, c, d) -> bool:
    """Whether two segments cross at a point inside both."""
    return _turn(a, b, c) * _turn(a, b, d) < 0 and _turn(c, d, a) * _turn(c, d, b) < 0


def _meet(a, b, c, d) -> bool:
    return _cross(a, b, c, d) or _on(a, b, c) or _on(a, b, d) or _on(c, d, a) or _on(c, d, b)


def side(polygon: Geometry, p) -> int:
    """1 inside a polygon, 0 on its border, -1 outside."""
    inside = False
    for r in polygon.data:
        for a, b in zip(r[:-1], r[1:], strict=True):
            if _on(a, b, p):
                return 0
            if (a[1] > p[1]) != (b[1] > p[1]) and p[0] < (b[0] - a[0]) * (p[1] - a[1]) / (b[1] - a[1]) + a[0]:
                inside = not inside
    return 1 if inside else -1


def _place(g: Geometry, p) -> int:
    """Like ``side`` for any geometry; inner points of lines count as inside."""
    best = -1
    for part in g.parts():
        if part.kind == "POINT":
            best = max(best, 1 if part.data == p else -1)
        elif part.kind == "POLYGON":
            best = max(best, side(part, p))
        elif any(_on(a, b, p) for a, b in part.segments()):
            best = max(best, 0 if p in (part.data[0], part.data[-1]) and part.data[0] != part.data[-1] else 1)
    return best


def intersects(a: Geometry, b: Geometry) -> bool:
    if any(_place(b, p) >= 0 for p in a.points()) or any(_place(a, p) >= 0 for p in b.points()):
        return True
    return any(_meet(*s, *t) for s in a.segments() for t in b.segments())


def _samples(g: Geometry, other: Geometry) -> list:
    """Points that show every stretch of a geometry between crossings with another."""
    out = [p.data for p in g.parts() if p.kind == "POINT"]
    cuts = other.segments()
    for a, b in g.segments():
        at = {0.0, 1.0}
        for c, d in cuts:
            den = (b[0] - a[0]) * (d[1] - c[1]) - (b[1] - a[1]) * (d[0] - c[0])
            if den:
                t = ((c[0] - a[0]) * (d[1] - c[1]) - (c[1] - a[1]) * (d[0] - c[0])) / den
                if 0 < t < 1:
                    at.add(t)
            else:
                size = (b[0] - a[0]) ** 2 + (b[1] - a[1]) ** 2
                for p in (c, d):
                    if size and _on(a, b, p):
                        at.add(((p[0] - a[0]) * (b[0] - a[0]) + (p[1] - a[1]) * (b[1] - a[1])) / size)
        stops = sorted(at)
        out += [(a[0] + (b[0] - a[0]) * (s + t) / 2, a[1] + (b[1] - a[1]) * (s + t) / 2) for s, t in zip(stops[:-1], stops[1:], strict=True)]
    return out


def _interior(g: Geometry, other: Geometry) -> list:
    """Sample points of the interior (of polygons: beside each stretch of the border)."""
    out = []
    for p in g.parts():
        if p.kind != "POLYGON":
            out += _samples(p, other)
            continue
        ring = _samples(Geometry("POLYGON", p.data), other)
        pts = p.points()
        span = max(max(q[0] for q in pts) - min(q[0] for q in pts), max(q[1] for q in pts) - min(q[1] for q in pts)) * 1e-7
        out += [q for m in [*ring, centroid(p).data] for dx in (-span, 0, span) for dy in (-span, 0, span) if side(p, q := (m[0] + dx, m[1] + dy)) == 1]
    return out


def covers(a: Geometry, b: Geometry) -> bool:
    if a.empty or b.empty:
        return False
    shown = [*b.points(), *_samples(b, a), *_interior(b, a)]
    return all(_place(a, p) >= 0 or (b.segments() and _near_border(a, p)) for p in shown)


def _near_border(g: Geometry, p) -> bool:
    """Midpoints are rounded: on the border within an ulp-sized distance."""
    scale = max(1.0, abs(p[0]), abs(p[1]))
    return any(_to_segment(p, a, b) <= 1e-12 * scale for a, b in g.segments())


def contains(a: Geometry, b: Geometry) -> bool:
    return covers(a, b) and any(_place(a, p) == 1 for p in _interior(b, a))


def _interiors_meet(a: Geometry, b: Geometry) -> bool:
    if any(_place(a, p) == 1 for p in _interior(b, a)) or any(_place(b, p) == 1 for p in _interior(a, b)):
        return True
    return dimension(a) == dimension(b) == 1 and any(_cross(*s, *t) for s in a.segments() for t in b.segments())


def touches(a: Geometry, b: Geometry) -> bool:
    return intersects(a, b) and not _interiors_meet(a, b)


def equals(a: Geometry, b: Geometry) -> bool:
    return covers(a, b) and covers(b, a)


def overlaps(a: Geometry, b: Geometry) -> bool:
    if dimension(a) != dimension(b) or not _interiors_meet(a, b) or covers(a, b) or covers(b, a):
        return False
    return dimension(a) != 1 or any(_place(b, p) == 1 for p in _samples(a, b))


def crosses(a: Geometry, b: Geometry) -> bool:
    if dimension(a) > dimension(b):
        return crosses(b, a)
    if dimension(a) == dimension(b):
        return dimension(a) == 1 and any(_cross(*s, *t) for s in a.segments() for t in b.segments()) and not overlaps(a, b)
    inside = [_place(b, p) == 1 for p in _interior(a, b)]
    return any(inside) and not covers(b, a)


# distance


def _to_segment(p, a, b) -> float:
    dx, dy = b[0] - a[0], b[1] - a[1]
    size = dx * dx + dy * dy
    t = 0.0 if not size else min(1.0, max(0.0, ((p[0] - a[0]) * dx + (p[1] - a[1]) * dy) / size))
    return math.dist(p, (a[0] + t * dx, a[1] + t * dy))


def distance(a: Geometry, b: Geometry, geography: bool = False) -> float | None:
    if a.empty or b.empty:
        return None
    if intersects(a, b):
        return 0.0
    if geography:
        return min(haversine(p, q) for p in _dense(a) for q in _dense(b))
    pairs = [math.dist(p, q) for p in a.points() for q in b.points()]
    pairs += [_to_segment(p, *s) for p in a.points() for s in b.segments()] + [_to_segment(p, *s) for p in b.points() for s in a.segments()]
    return min(pairs)


def _dense(g: Geometry) -> list:
    out = list(g.points())
    for a, b in g.segments():
        out += [(a[0] + (b[0] - a[0]) * k / 64, a[1] + (b[1] - a[1]) * k / 64) for k in range(1, 64)]
    return out


def dwithin(a: Geometry, b: Geometry, reach: float, geography: bool = False) -> bool:
    d = distance(a, b, geography)
    return d is not None and d <= reach


# constructions


def convex_hull(g: Geometry) -> Geometry:
    pts = sorted(set(g.points()))
    if len(pts) < 3:
        return Geometry("POINT", pts[0], g.srid) if len(pts) == 1 else Geometry("LINESTRING", tuple(pts), g.srid)
    half = []
    for order in (pts, pts[::-1]):
        chain = []
        for p in order:
            while len(chain) > 1 and _turn(chain[-2], chain[-1], p) <= 0:
                chain.pop()
            chain.append(p)
        half.append(chain[:-1])
    ring = [*half[0], *half[1]]
    return Geometry("LINESTRING", tuple(ring), g.srid) if len(ring) < 3 else Geometry("POLYGON", ((*ring, ring[0]),), g.srid)


def _thin(line: tuple, tolerance: float) -> tuple:
    """Douglas-Peucker, with a stack."""
    keep, todo = {0, len(line) - 1}, [(0, len(line) - 1)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        far, at = max((_to_segment(line[i], line[a], line[b]), i) for i in range(a + 1, b))
        if far > tolerance:
            keep.add(at)
            todo += [(a, at), (at, b)]
    return tuple(line[i] for i in sorted(keep))


def simplify(g: Geometry, tolerance: float) -> Geometry:
    if g.kind in KINDS[3:]:
        return Geometry(g.kind, tuple(simplify(m, tolerance) for m in g.data), g.srid)
    if g.kind == "LINESTRING":
        return Geometry(g.kind, _thin(g.data, tolerance), g.srid)
    if g.kind == "POLYGON":
        rings = [_thin(r, tolerance) for r in g.data]
        return Geometry(g.kind, tuple(t if len(t) > 3 else r for t, r in zip(rings, g.data, strict=True)), g.srid)
    return g


def segmentize(g: Geometry, most: float) -> Geometry:
    if most <= 0:
        raise ValueError("the length must be positive")

    def line(x):
        out = [x[0]]
        for a, b in zip(x[:-1], x[1:], strict=True):
            n = max(1, math.ceil(math.dist(a, b) / most))
            out += [(a[0] + (b[0] - a[0]) * k / n, a[1] + (b[1] - a[1]) * k / n) for k in range(1, n + 1)]
        return tuple(out)

    if g.kind in KINDS[3:]:
        return Geometry(g.kind, tuple(segmentize(m, most) for m in g.data), g.srid)
    return g if g.kind == "POINT" else Geometry(g.kind, line(g.data) if g.kind == "LINESTRING" else tuple(map(line, g.data)), g.srid)


def buffer(g: Geometry, radius: float, sides: int = 32) -> Geometry:
    """A circle around a point; around anything else the hull of such circles."""
    if radius <= 0:
        raise ValueError("the radius must be positive")
    around = [(p[0] + radius * math.cos(2 * math.pi * k / sides), p[1] + radius * math.sin(2 * math.pi * k / sides)) for p in g.points() for k in range(sides)]
    return convex_hull(Geometry("MULTIPOINT", tuple(Geometry("POINT", p, g.srid) for p in around), g.srid))


def _convex(r) -> bool:
    turns = [_turn(r[i], r[i + 1], r[(i + 2) % (len(r) - 1)]) for i in range(len(r) - 1)]
    return all(t >= 0 for t in turns) or all(t <= 0 for t in turns)


def intersection(a: Geometry, b: Geometry) -> Geometry:
    """Of polygons, the second without holes and convex; or one inside the other."""
    if not intersects(a, b):
        return Geometry("GEOMETRYCOLLECTION", (), a.srid)
    if covers(a, b):
        return b
    if covers(b, a):
        return a
    if a.kind != "POLYGON" or b.kind != "POLYGON" or len(a.data) > 1 or len(b.data) > 1 or not _convex(b.data[0]):
        raise ValueError("INTERSECTION: unsupported shapes")
    clip = b.data[0] if _ring_area(b.data[0]) > 0 else b.data[0][::-1]
    out = list(a.data[0][:-1])
    for c, d in zip(clip[:-1], clip[1:], strict=True):
        old, out = out, []
        for p, q in zip(old, [*old[1:], *old[:1]], strict=True):
            s, t = _turn(c, d, p), _turn(c, d, q)
            if s >= 0:
                out.append(p)
            if s * t < 0:
                k = s / (s - t)
                out.append((p[0] + (q[0] - p[0]) * k, p[1] + (q[1] - p[1]) * k))
    return Geometry("POLYGON", ((*out, out[0]),), a.srid) if len(out) > 2 else Geometry("GEOMETRYCOLLECTION", (), a.srid)


def union(a: Geometry, b: Geometry) -> Geometry:
    """Of disjoint shapes, or one inside the other."""
    if covers(a, b):
        return a
    if covers(b, a):
        return b
    if intersects(a, b):
        raise ValueError("UNION: unsupported shapes")
    parts = tuple(a.parts() + b.parts())
    kinds = {p.kind for p in parts}
    return Geometry("MULTI" + kinds.pop() if len(kinds) == 1 else KINDS[6], parts, a.srid)


def difference(a: Geometry, b: Geometry) -> Geometry:
    """Of disjoint shapes, or one inside the other."""
    if not intersects(a, b):
        return a
    if covers(b, a):
        return Geometry(a.kind, (), a.srid)
    if a.kind == b.kind == "POLYGON" and contains(a, b) and not touches(Geometry("LINESTRING", a.data[0]), b):
        return Geometry("POLYGON", (*a.data, b.data[0][::-1]), a.srid)
    raise ValueError("DIFFERENCE: unsupported shapes")


def sym_difference(a: Geometry, b: Geometry) -> Geometry:
    return union(a, b) if not intersects(a, b) else difference(a, b) if covers(a, b) else difference(b, a)


#: ST_ name (without the prefix): function, number of geometry arguments, result type (geometry: EWKT text)
FUNCTIONS = {
    "AsText": (as_text, 1, "string"), "AsEWKT": (as_ewkt, 1, "string"), "AsBinary": (as_binary, 1, "binary"), "AsEWKB": (lambda g: as_binary(g, True), 1, "binary"), "AsGeoJSON": (as_geojson, 1, "string"),
    "SRID": (lambda g: g.srid, 1, "long"), "SetSRID": (set_srid, 1, "geometry"), "Transform": (transform, 1, "geometry"), "GeometryType": (lambda g: "ST_" + _NAMES[g.kind], 1, "string"),
    "X": (x, 1, "double"), "Y": (y, 1, "double"), "NPoints": (lambda g: len(g.points()), 1, "long"), "NumGeometries": (num_geometries, 1, "long"), "GeometryN": (geometry_n, 1, "geometry"),
    "Dimension": (dimension, 1, "long"), "IsEmpty": (lambda g: g.empty, 1, "boolean"), "PointN": (point_n, 1, "geometry"), "StartPoint": (lambda g: point_n(g, 1), 1, "geometry"), "EndPoint": (end_point, 1, "geometry"),
    "ExteriorRing": (exterior_ring, 1, "geometry"), "InteriorRingN": (interior_ring_n, 1, "geometry"), "NumInteriorRings": (lambda g: max(0, len(g.data) - 1), 1, "long"), "Boundary": (boundary, 1, "geometry"), "Reverse": (reverse, 1, "geometry"),
    "Area": (area, 1, "double"), "Length": (length, 1, "double"), "Perimeter": (perimeter, 1, "double"), "Centroid": (centroid, 1, "geometry"), "Envelope": (envelope, 1, "geometry"),
    "Distance": (distance, 2, "double"), "DWithin": (dwithin, 2, "boolean"), "DistanceSpheroid": (lambda a, b: spheroid(_point(a), _point(b)), 2, "double"),
    "Intersects": (intersects, 2, "boolean"), "Disjoint": (lambda a, b: not intersects(a, b), 2, "boolean"), "Contains": (contains, 2, "boolean"), "Within": (lambda a, b: contains(b, a), 2, "boolean"),
    "Covers": (covers, 2, "boolean"), "CoveredBy": (lambda a, b: covers(b, a), 2, "boolean"), "Touches": (touches, 2, "boolean"), "Overlaps": (overlaps, 2, "boolean"), "Crosses": (crosses, 2, "boolean"), "Equals": (equals, 2, "boolean"),
    "ConvexHull": (convex_hull, 1, "geometry"), "Simplify": (simplify, 1, "geometry"), "Segmentize": (segmentize, 1, "geometry"), "Buffer": (buffer, 1, "geometry"),
    "Intersection": (intersection, 2, "geometry"), "Union": (union, 2, "geometry"), "Difference": (difference, 2, "geometry"), "SymDifference": (sym_difference, 2, "geometry"),
}


def _value(g: Geometry) -> str:
    """The text of a column."""
    return (_GEOGRAPHY if g.geography else "") + as_ewkt(g)


def _given(text: str, srid: int | None, default: int) -> Geometry:
    g = parse(text)
    return set_srid(g, int(srid if srid is not None else g.srid or default))


def _geographic(text: str, srid: int | None = None) -> Geometry:
    return replace(_given(text, srid, 4326), geography=True)


#: Functions of plain values that make a geometry.
CONSTRUCTORS = {
    "GeomFromText": lambda t, srid=None: _given(t, srid, 0), "GeometryFromText": lambda t, srid=None: _given(t, srid, 0), "GeomFromEWKT": lambda t: _given(t, None, 0),
    "GeogFromText": _geographic, "GeographyFromText": _geographic, "GeomFromGeoJSON": from_geojson,
    "Point": lambda x, y, srid=0: Geometry("POINT", (float(x), float(y)), int(srid)),
}

#: Functions that measure a geography on the sphere.
_MEASURES = {"AREA", "LENGTH", "PERIMETER", "DISTANCE", "DWITHIN"}


def _of_kind(kind: str):
    def make(text: str) -> Geometry:
        g = parse(text)
        if g.kind != kind or any(abs(x) > 180 or abs(y) > 90 for x, y in g.points()):
            raise ValueError(f"{kind} in degrees is asked for")
        return replace(set_srid(g, 4326), geography=True)

    return make


def _geo_type(g: Geometry) -> str:
    return g.kind


def _strictly_within(a: Geometry, b: Geometry) -> bool:
    """Every point of ``a`` lies inside ``b`` and none on its border."""
    return contains(b, a) and not intersects(a, boundary(b)) if b.kind in ("POLYGON", "MULTIPOLYGON") else contains(b, a)


#: Functions of the fixed geography shapes: name: (function, shapes, type).
GEOGRAPHY = {
    "Distance": (lambda a, b: distance(a, b, True), 2, "double"), "Distance_Spheroid": (lambda a, b: min(spheroid(p, q) for p in _dense(a) for q in _dense(b)) if not intersects(a, b) else 0.0, 2, "double"),
    "Intersects": (intersects, 2, "boolean"), "Disjoint": (lambda a, b: not intersects(a, b), 2, "boolean"), "Within": (_strictly_within, 2, "boolean"), "Covers": (covers, 2, "boolean"),
    "LineLength": (lambda g: length(g, True), 1, "double"), "Area": (lambda g: area(g, True), 1, "double"), "Perimeter": (lambda g: perimeter(g, True), 1, "double"),
    "Centroid": (centroid, 1, "geometry"), "Envelope": (envelope, 1, "geometry"), "GeometryType": (_geo_type, 1, "string"), "NPoints": (lambda g: len(g.points()), 1, "long"), "NRings": (lambda g: len(g.data) if g.kind == "POLYGON" else None, 1, "long"),
}


def _found(name: str) -> tuple:
    """function, leading geometries, type of what it gives."""
    name = name.upper()
    if name.startswith("GEO_AS"):
        return _of_kind(name[6:]), 0, "geometry"
    if name.startswith("GEO_"):
        return {k.upper(): v for k, v in GEOGRAPHY.items()}[name[4:]]
    by_name = {k.upper(): v for k, v in FUNCTIONS.items()}
    if name in by_name:
        fn, count, kind = by_name[name]
        if name not in _MEASURES:
            return fn, count, kind

        def measure(*args):
            kinds = {g.geography for g in args[:count]}
            if len(kinds) > 1:
                raise ValueError(f"ST_{name} takes two geometries or two geographies")
            return fn(*args, kinds.pop())

        return measure, count, kind
    return {k.upper(): v for k, v in CONSTRUCTORS.items()}[name], 0, "geometry"


def function(name: str):
    """A pandas UDF of all of a function's arguments; null gives null."""
    fn, count, kind = _found(name)

    @F.pandas_udf("string" if kind == "geometry" else kind)
    def run(*columns: pd.Series) -> pd.Series:
        out = []
        for row in zip(*columns, strict=True):
            shapes = [parse(x) for x in row[:count] if x is not None]
            value = None if any(v is None for v in row) else fn(*shapes, *row[count:])
            if isinstance(value, Geometry):
                on_sphere = value.geography or (name.upper() != "TRANSFORM" and any(g.geography for g in shapes))
                value = _value(replace(value, srid=value.srid or (shapes[0].srid if shapes else 0), geography=on_sphere))
            out.append(value)
        return pd.Series(out, dtype=object)

    return run


def st(name: str, *arguments: Column) -> Column:
    """``ST_<name>`` of columns: geometries first."""
    return function(name)(*arguments)
