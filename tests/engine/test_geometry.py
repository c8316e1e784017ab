import math

import pytest
from pyspark.sql import functions as F

from quillon.functions import geometry as G

SQUARE, INNER, BESIDE = "POLYGON((0 0,4 0,4 4,0 4,0 0))", "POLYGON((1 1,2 1,2 2,1 2,1 1))", "POLYGON((4 0,8 0,8 4,4 4,4 0))"
PARTLY = "POLYGON((2 2,6 2,6 6,2 6,2 2))"
HOLED = "POLYGON((0 0,4 0,4 4,0 4,0 0),(1 1,2 1,2 2,1 2,1 1))"


def of(name, *geometries, args=()):
    fn, _, _ = G.FUNCTIONS[name]
    value = fn(*map(G.parse, geometries), *args)
    return G.as_text(value) if isinstance(value, G.Geometry) else value


@pytest.mark.parametrize("text", ["POINT(1 2)", "LINESTRING(0 0,1 1.5)", HOLED, "MULTIPOINT((1 2),(3 4))", "MULTIPOLYGON(((0 0,1 0,1 1,0 0)))", "GEOMETRYCOLLECTION(POINT(1 2),LINESTRING(0 0,1 1))", "POINT EMPTY"])
def test_round_trips(text):
    g = G.parse(text)
    assert G.as_text(g) == text
    if "EMPTY" not in text:
        assert G.as_text(G.from_geojson(G.as_geojson(g))) == text


@pytest.mark.parametrize("bad", ["POINT(1)", "POLYGON((0 0,1 1,0 0))", "LINESTRING(0 0)", "CIRCLE(1 2)", "POINT(1 2) x"])
def test_malformed(bad):
    with pytest.raises(ValueError):
        G.parse(bad)


@pytest.mark.parametrize(
    ("name", "pair", "want"),
    [
        ("Contains", (SQUARE, INNER), True), ("Contains", (SQUARE, PARTLY), False), ("Within", (INNER, SQUARE), True), ("Covers", (SQUARE, SQUARE), True), ("Contains", (SQUARE, "LINESTRING(0 0,4 0)"), False),
        ("Covers", (SQUARE, "LINESTRING(0 0,4 0)"), True), ("Touches", (SQUARE, BESIDE), True), ("Touches", (SQUARE, PARTLY), False), ("Overlaps", (SQUARE, PARTLY), True), ("Overlaps", (SQUARE, INNER), False),
        ("Crosses", ("LINESTRING(-1 2,5 2)", SQUARE), True), ("Crosses", ("LINESTRING(0 0,2 2)", "LINESTRING(0 2,2 0)"), True), ("Disjoint", (INNER, BESIDE), True), ("Intersects", (HOLED, "POINT(1.5 1.5)"), False),
        ("Equals", (SQUARE, "POLYGON((4 4,0 4,0 0,4 0,4 4))"), True), ("Contains", (HOLED, INNER), False), ("Intersects", ("POINT(4 4)", SQUARE), True),
    ],
)
def test_predicates(name, pair, want):
    assert of(name, *pair) is want


def test_measures():
    assert of("Area", HOLED) == 15 and of("Perimeter", SQUARE) == 16 and of("Length", "LINESTRING(0 0,3 4)") == 5
    assert of("Distance", INNER, BESIDE) == 2 and of("Distance", "POINT(0 0)", "LINESTRING(3 -1,3 1)") == 3
    assert of("Centroid", SQUARE) == "POINT(2 2)" and of("Envelope", "LINESTRING(1 2,3 0)") == "POLYGON((1 0,3 0,3 2,1 2,1 0))"
    assert abs(of("DistanceSpheroid", "POINT(0 0)", "POINT(1 0)") - 111319.4908) < 1e-3
    assert abs(G.haversine((0, 0), (1, 0)) - 111195.0797) < 1e-3
    world = G.area(G.parse("POLYGON((0 0,90 0,90 89.999999,0 89.999999,0 0))"), geography=True)
    assert abs(world / (math.pi / 2 * G.EARTH**2) - 1) < 1e-6


def test_constructions():
    assert of("ConvexHull", "MULTIPOINT((0 0),(2 0),(1 1),(2 2),(0 2))") == "POLYGON((0 0,2 0,2 2,0 2,0 0))"
    assert of("Simplify", "LINESTRING(0 0,1 0.01,2 0)", args=(0.1,)) == "LINESTRING(0 0,2 0)"
    assert of("Segmentize", "LINESTRING(0 0,4 0)", args=(2,)) == "LINESTRING(0 0,2 0,4 0)"
    assert G.area(G.intersection(G.parse(SQUARE), G.parse(PARTLY))) == 4
    assert of("Union", INNER, BESIDE).startswith("MULTIPOLYGON") and of("Difference", SQUARE, INNER).count("(") == 3
    with pytest.raises(ValueError):
        of("Union", SQUARE, PARTLY)
    there = G.transform(G.parse("SRID=4326;POINT(12.5 41.9)"), 3857)
    back = G.transform(there, 4326)
    assert abs(back.data[0] - 12.5) < 1e-9 and abs(back.data[1] - 41.9) < 1e-9 and abs(there.data[0] - 1391493.6) < 1


def test_columns(spark):
    rows = spark.createDataFrame([("SRID=4326;POINT(12.5 41.9)",), ("LINESTRING(0 0,1 1,2 0)",), (None,)], "g string")
    got = rows.select(G.st("NPoints", F.col("g")).alias("n"), G.st("SRID", F.col("g")).alias("s"), G.st("Intersects", F.col("g"), F.lit(SQUARE)).alias("i"), G.st("Envelope", F.col("g")).alias("e")).collect()
    assert [(r.n, r.s, r.i) for r in got] == [(1, 4326, False), (3, 0, True), (None, None, None)]
