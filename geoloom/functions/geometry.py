"""Planar geometry as a struct column, with measures and predicates as SQL expressions.

A geometry is struct(kind, dim, parts): parts is an array of parts, a part an array of rings (or one point list), a ring
an array of (x, y). A point is [[[p]]], a line [[[p, q, ...]]], a polygon [[outer, hole, ...]] with closed rings; Multi
kinds have several parts. Everything here is higher-order functions, so it runs in the JVM.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

XY = "struct<x: double, y: double>"
GEOMETRY = f"struct<kind: string, dim: int, parts: array<array<array<{XY}>>>>"
DIMS = {"Point": 0, "MultiPoint": 0, "LineString": 1, "MultiLineString": 1, "Polygon": 2, "MultiPolygon": 2}


def named(**fields: Column) -> Column:
    """A struct whose field names hold inside lambdas too, where aliases can get lost."""
    return F.named_struct(*[c for n, v in fields.items() for c in (F.lit(n), v)])


def xy(x: Column, y: Column) -> Column:
    return named(x=x.cast("double"), y=y.cast("double"))


def geometry(kind: str, parts: Column) -> Column:
    return named(kind=F.lit(kind), dim=F.lit(DIMS[kind]), parts=parts).cast(GEOMETRY)


def point(x: Column, y: Column) -> Column:
    return F.when(x.isNotNull() & y.isNotNull(), geometry("Point", F.array(F.array(F.array(xy(x, y))))))


def line(*points: Column) -> Column:
    return geometry("LineString", F.array(F.array(F.array(*points))))


def line_of(points: Column) -> Column:
    return geometry("LineString", F.array(F.array(points)))


def polygon_of(ring: Column) -> Column:
    return geometry("Polygon", F.array(F.array(ring)))


def box(xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Column:
    return polygon_of(F.array(xy(xmin, ymin), xy(xmax, ymin), xy(xmax, ymax), xy(xmin, ymax), xy(xmin, ymin)))


def px(g: Column) -> Column:
    """x of a point."""
    return g["parts"][0][0][0]["x"]


def py(g: Column) -> Column:
    return g["parts"][0][0][0]["y"]


def rings(g: Column) -> Column:
    return F.flatten(g["parts"])


def vertices(g: Column) -> Column:
    return F.flatten(rings(g))


def segments(ring: Column) -> Column:
    """(a, b) of consecutive vertices; none for a single point."""
    n = F.size(ring)
    return F.zip_with(F.slice(ring, 1, F.greatest(n - 1, F.lit(0))), F.slice(ring, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: named(a=a, b=b))


def _sum(values: Column, of: Callable[[Column], Column]) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + of(v))


def ring_area(ring: Column) -> Column:
    """Signed, by the shoelace formula around the first vertex."""
    o = ring[0]
    return _sum(segments(ring), lambda s: ((s["a"]["x"] - o["x"]) * (s["b"]["y"] - o["y"]) - (s["b"]["x"] - o["x"]) * (s["a"]["y"] - o["y"])) / 2)


def area(g: Column) -> Column:
    """Of polygons, holes taken off; null for other kinds."""
    of_part = lambda p: 2 * F.abs(ring_area(p[0])) - _sum(p, lambda r: F.abs(ring_area(r)))
    return F.when(g["dim"] == 2, _sum(g["parts"], of_part))


def outline(g: Column) -> Column:
    """The length of lines and of polygons' boundaries; 0 for points."""
    of_ring = lambda r: _sum(segments(r), lambda s: F.hypot(s["b"]["x"] - s["a"]["x"], s["b"]["y"] - s["a"]["y"]))
    return _sum(rings(g), of_ring)


def length(g: Column) -> Column:
    """Of lines; null for other kinds (a polygon's boundary is no length)."""
    return F.when(g["dim"] == 1, outline(g))


def bbox(g: Column) -> Column:
    xs, ys = F.transform(vertices(g), lambda v: v["x"]), F.transform(vertices(g), lambda v: v["y"])
    return named(xmin=F.array_min(xs), ymin=F.array_min(ys), xmax=F.array_max(xs), ymax=F.array_max(ys))


def centroid(g: Column) -> Column:
    """struct(x, y): of the area, the length or the points, whichever the kind has."""
    n = F.size(vertices(g))
    mean = lambda k: _sum(vertices(g), lambda v: v[k]) / n
    # Signed ring areas: an outer ring counts +, its holes -.
    def weighted(k: str) -> Column:
        o = vertices(g)[0]
        of_ring = lambda r: _sum(segments(r), lambda s: ((s["a"]["x"] - o["x"]) * (s["b"]["y"] - o["y"]) - (s["b"]["x"] - o["x"]) * (s["a"]["y"] - o["y"])) * (s["a"][k] + s["b"][k] - 2 * o[k]) / 6)
        turn = lambda r, first: F.signum(ring_area(r)) * F.when(first, 1.0).otherwise(-1.0)
        of_part = lambda p: F.aggregate(F.transform(p, lambda r, i: of_ring(r) * turn(r, i == 0)), F.lit(0.0), lambda a, v: a + v)
        return o[k] + F.try_divide(_sum(g["parts"], of_part), area(g))

    def along(k: str) -> Column:
        size = lambda s: F.hypot(s["b"]["x"] - s["a"]["x"], s["b"]["y"] - s["a"]["y"])
        return F.try_divide(_sum(rings(g), lambda r: _sum(segments(r), lambda s: size(s) * (s["a"][k] + s["b"][k]) / 2)), length(g))

    pick = lambda k: F.when(g["dim"] == 2, F.coalesce(weighted(k), mean(k))).when(g["dim"] == 1, F.coalesce(along(k), mean(k))).otherwise(mean(k))
    return named(x=pick("x"), y=pick("y"))


def _cross(a: Column, b: Column, x: Column, y: Column) -> Column:
    return (b["x"] - a["x"]) * (y - a["y"]) - (b["y"] - a["y"]) * (x - a["x"])


def on_border(g: Column, x: Column, y: Column) -> Column:
    """Whether (x, y) lies on one of the geometry's segments."""
    def on(s: Column) -> Column:
        a, b = s["a"], s["b"]
        between = (F.least(a["x"], b["x"]) <= x) & (x <= F.greatest(a["x"], b["x"])) & (F.least(a["y"], b["y"]) <= y) & (y <= F.greatest(a["y"], b["y"]))
        return between & (_cross(a, b, x, y) == 0)

    return F.exists(rings(g), lambda r: F.exists(segments(r), on))


def interior(g: Column, x: Column, y: Column) -> Column:
    """Even-odd rule over all rings; points on the border may go either way."""
    def hit(s: Column) -> Column:
        a, b = s["a"], s["b"]
        spans = (a["y"] > y) != (b["y"] > y)
        side = _cross(a, b, x, y)
        return spans & F.when(b["y"] > a["y"], side > 0).otherwise(side < 0)

    crossings = F.aggregate(rings(g), F.lit(0), lambda acc, r: acc + F.size(F.filter(segments(r), hit)))
    return crossings % 2 == 1


def covers_point(g: Column, x: Column, y: Column) -> Column:
    """The polygon or its border has the point."""
    return on_border(g, x, y) | interior(g, x, y)


def contains_point(g: Column, x: Column, y: Column) -> Column:
    """The polygon's inside has the point."""
    return ~on_border(g, x, y) & interior(g, x, y)


def _meet(s: Column, t: Column) -> Column:
    """Whether two segments share a point."""
    d1, d2 = _cross(s["a"], s["b"], t["a"]["x"], t["a"]["y"]), _cross(s["a"], s["b"], t["b"]["x"], t["b"]["y"])
    d3, d4 = _cross(t["a"], t["b"], s["a"]["x"], s["a"]["y"]), _cross(t["a"], t["b"], s["b"]["x"], s["b"]["y"])
    apart = lambda k: (F.greatest(s["a"][k], s["b"][k]) < F.least(t["a"][k], t["b"][k])) | (F.greatest(t["a"][k], t["b"][k]) < F.least(s["a"][k], s["b"][k]))
    return ~apart("x") & ~apart("y") & (F.signum(d1) * F.signum(d2) <= 0) & (F.signum(d3) * F.signum(d4) <= 0)


def intersects(a: Column, b: Column) -> Column:
    """Whether two geometries share a point."""
    edges = F.exists(rings(a), lambda r: F.exists(segments(r), lambda s: F.exists(rings(b), lambda q: F.exists(segments(q), lambda t: _meet(s, t)))))
    inside = lambda g, h: (h["dim"] == 2) & F.exists(vertices(g), lambda v: covers_point(h, v["x"], v["y"]))
    on = lambda g, h: (g["dim"] == 0) & F.exists(vertices(g), lambda v: on_border(h, v["x"], v["y"]))
    same = (a["dim"] == 0) & (b["dim"] == 0) & F.arrays_overlap(vertices(a), vertices(b))
    return edges | inside(a, b) | inside(b, a) | on(a, b) | on(b, a) | same


def within(a: Column, b: Column) -> Column:
    """Whether the polygon b covers a and their insides meet."""
    all_in = F.forall(vertices(a), lambda v: covers_point(b, v["x"], v["y"]))
    middles = F.forall(rings(a), lambda r: F.forall(segments(r), lambda s: covers_point(b, (s["a"]["x"] + s["b"]["x"]) / 2, (s["a"]["y"] + s["b"]["y"]) / 2)))
    some = (a["dim"] > 0) | F.exists(vertices(a), lambda v: contains_point(b, v["x"], v["y"]))
    return (b["dim"] == 2) & all_in & middles & some


PREDICATES = {"intersects": intersects, "within": within, "contains": lambda a, b: within(b, a)}


def circle(x: Column, y: Column, radius: float, quadrant: int = 16) -> Column:
    """The buffer of a point: 4 * quadrant corners on the circle."""
    n = 4 * quadrant
    corner = lambda i: xy(x + radius * F.cos(2 * math.pi * i / n), y - radius * F.sin(2 * math.pi * i / n))
    return polygon_of(F.concat(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), corner), F.array(corner(F.lit(0)))))


def wkt(g: Column) -> Column:
    """Well-known text."""
    show = lambda v: F.concat_ws(" ", v["x"].cast("string"), v["y"].cast("string"))
    ring = lambda r: F.concat(F.lit("("), F.array_join(F.transform(r, show), ", "), F.lit(")"))
    part = lambda p: F.concat(F.lit("("), F.array_join(F.transform(p, ring), ", "), F.lit(")"))
    name = F.upper(g["kind"])
    flat = F.array_join(F.transform(rings(g), ring), ", ")
    body = (
        F.when(g["kind"] == "Point", ring(vertices(g)))
        .when(g["kind"] == "MultiPoint", F.concat(F.lit("("), flat, F.lit(")")))
        .when(g["kind"] == "LineString", flat)
        .when(g["kind"] == "MultiLineString", F.concat(F.lit("("), flat, F.lit(")")))
        .when(g["kind"] == "Polygon", part(g["parts"][0]))
        .otherwise(F.concat(F.lit("("), F.array_join(F.transform(g["parts"], part), ", "), F.lit(")")))
    )
    return F.concat_ws(" ", name, body)


def from_wkt(text: Column) -> Column:
    """Geometry of well-known text (two dimensions; null if it is none).

    The text is rewritten as a JSON list of one depth for all kinds, which from_json reads.
    """
    kind = F.upper(F.regexp_extract(text, r"^\s*([A-Za-z]+)", 1))
    body = F.trim(F.regexp_replace(text, r"^\s*[A-Za-z]+\s*Z?\s*", ""))
    pair = r"([-+0-9.eE]+)\s+([-+0-9.eE]+)(?:\s+[-+0-9.eE]+)*"
    listed = F.translate(F.regexp_replace(body, pair, r"{\"x\":$1,\"y\":$2}"), "()", "[]")
    deep = (
        F.when(kind.isin("POINT", "LINESTRING"), F.concat(F.lit("[["), listed, F.lit("]]")))
        .when((kind == "MULTIPOINT") & listed.rlike(r"^\[\s*\{"), F.concat(F.lit("["), F.regexp_replace(listed, r"(\{[^}]*\})", "[[$1]]"), F.lit("]")))
        .when(kind.isin("MULTIPOINT", "MULTILINESTRING"), F.regexp_replace(F.regexp_replace(listed, r"\[\s*\{", "[[{"), r"\}\s*\]", "}]]"))
        .when(kind == "POLYGON", F.concat(F.lit("["), listed, F.lit("]")))
        .otherwise(listed)
    )
    deep = F.when((kind == "MULTIPOINT") & listed.rlike(r"^\[\s*\{"), F.concat(F.lit("["), F.regexp_replace(F.regexp_replace(listed, r"^\[|\]$", ""), r"(\{[^}]*\})", "[[$1]]"), F.lit("]"))).otherwise(deep)
    parts = F.from_json(deep, f"array<array<array<{XY}>>>")
    names = {k.upper(): k for k in DIMS}
    shown = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[kind]
    dims = F.create_map(*[F.lit(x) for k, v in DIMS.items() for x in (k.upper(), v)])[kind]
    known = kind.isin(*names)
    return F.when(known & parts.isNotNull(), named(kind=shown, dim=dims, parts=parts).cast(GEOMETRY))


def geojson(g: Column) -> Column:
    """The GeoJSON geometry object as text."""
    pos = lambda v: F.concat(F.lit("["), v["x"].cast("string"), F.lit(","), v["y"].cast("string"), F.lit("]"))
    many = lambda a, f: F.concat(F.lit("["), F.array_join(F.transform(a, f), ","), F.lit("]"))
    ring = lambda r: many(r, pos)
    coords = (
        F.when(g["kind"] == "Point", pos(vertices(g)[0]))
        .when(g["kind"].isin("MultiPoint", "LineString"), many(vertices(g), pos))
        .when(g["kind"].isin("MultiLineString"), many(rings(g), ring))
        .when(g["kind"] == "Polygon", many(g["parts"][0], ring))
        .otherwise(many(g["parts"], lambda p: many(p, ring)))
    )
    return F.concat(F.lit('{"type":"'), g["kind"], F.lit('","coordinates":'), coords, F.lit("}"))
