"""Relations: rings from broken, reversed and nested members, by known areas."""

import random

from pyspark.sql import functions as F

from geoloom.functions import geometry as G
from geoloom.sources import osm


def square(x, y, side):
    return [(x, y), (x + side, y), (x + side, y + side), (x, y + side), (x, y)]


def cut(rng, ring):
    """The ring as lines between some of its corners, in any direction and order."""
    places = sorted(rng.sample(range(1, len(ring) - 1), rng.randint(1, len(ring) - 2)))
    parts = [ring[a : b + 1] for a, b in zip([0, *places], [*places, len(ring) - 1], strict=True)]
    return [p[::-1] if rng.random() < 0.5 else p for p in parts]


def area(polygons):
    return sum(osm._area(p[0]) - sum(map(osm._area, p[1:])) for p in polygons)


def test_rings_in_any_order():
    rng = random.Random(1)
    for _ in range(300):
        # A square, a hole, an island in it with a hole of its own, and a square beside.
        rings = [square(0, 0, 100), square(10, 10, 60), square(20, 20, 30), square(25, 25, 5), square(200, 0, 10)]
        lines = [p for r in rings for p in cut(rng, r)]
        rng.shuffle(lines)
        found, lost = osm.rings_of(lines + lines[:2])
        polygons = osm.nested(found)
        assert lost == 0 and len(found) == 5 and area(polygons) == 10_000 - 3600 + 900 - 25 + 100
        assert sorted(len(p) for p in polygons) == [1, 2, 2]


def test_what_does_not_close():
    rings, lost = osm.rings_of([[(0, 0), (1, 0)], [(1, 0), (1, 1)], [(5, 5), (6, 6), (5, 5)], [(1, 1)]])
    assert (rings, lost) == ([], 3)
    # A stray line at a corner, a gap in another ring.
    rings, lost = osm.rings_of([*cut(random.Random(2), square(0, 0, 4)), [(0, 0), (-3, -3)], [(9, 9), (10, 9), (10, 10)]])
    assert (len(rings), lost, osm._area(rings[0])) == (1, 2, 16)


def test_rings_that_touch():
    """Two squares share a corner, and a hole touches its square's corner from inside."""
    a, b = square(0, 0, 4), square(4, 4, 4)
    rings, lost = osm.rings_of([a[:3], a[2:], b[:3], b[2:]])
    assert lost == 0 and sorted(map(osm._area, rings)) == [16, 16]
    hole = [(0, 0), (2, 1), (1, 2), (0, 0)]
    polygons = osm.nested([a, hole])
    assert len(polygons) == 1 and area(polygons) == 16 - 1.5


def test_relations(spark):
    lines = {1: "LINESTRING (0 0, 4 0, 4 4)", 2: "LINESTRING (0 0, 0 4, 4 4)", 3: "LINESTRING (1 1, 2 1, 2 2, 1 1)", 4: "LINESTRING (0 0, 9 9)"}
    ways = spark.createDataFrame(list(lines.items()), "id long, t string").select("id", G.from_wkt(F.col("t")).alias("geometry"))
    member = lambda *refs: [("way", r, "outer") for r in refs] + [("node", 1, "label")]
    relations = [(1, {"type": "multipolygon"}, member(2, 1, 3, 3)), (2, {"type": "multipolygon"}, member(1, 4, 77)), (3, {"type": "route"}, member(1, 2)), (4, {"type": "multipolygon"}, []), (5, {"type": "multipolygon"}, None)]
    df = spark.createDataFrame(relations, "id long, tags map<string,string>, members array<struct<type: string, ref: long, role: string>>")
    out = osm.relation_areas(df, ways, {"type": "multipolygon"}).orderBy("id").select("id", G.area(F.col("geometry")).alias("a"), "lost").collect()
    assert [tuple(r) for r in out] == [(1, 15.5, 0), (2, None, 3), (4, None, 0), (5, None, 0)]
    assert osm.relation_areas(df, ways).count() == 5
