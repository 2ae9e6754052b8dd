"""Nearest distances against brute force over all pairs of segments."""

import math
import random

import pytest
from pyspark.sql import functions as F

from geoloom.functions import geometry as G
from geoloom.operators import nearest
from geoloom.plans import stages


def segments(shape):
    dim, rings = shape
    return [(p, p) for r in rings for p in r] if dim == 0 else [(a, b) for r in rings for a, b in zip(r, r[1:], strict=False)]


def point_segment(p, s):
    (ax, ay), (bx, by) = s
    dx, dy = bx - ax, by - ay
    n = dx * dx + dy * dy
    t = max(0.0, min(1.0, ((p[0] - ax) * dx + (p[1] - ay) * dy) / n)) if n else 0.0
    return math.hypot(p[0] - ax - t * dx, p[1] - ay - t * dy)


def meet(s, t):
    cross = lambda a, b, p: (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])
    apart = any(max(s[0][k], s[1][k]) < min(t[0][k], t[1][k]) or max(t[0][k], t[1][k]) < min(s[0][k], s[1][k]) for k in (0, 1))
    sign = lambda v: (v > 0) - (v < 0)
    return not apart and sign(cross(*s, t[0])) * sign(cross(*s, t[1])) <= 0 and sign(cross(*t, s[0])) * sign(cross(*t, s[1])) <= 0


def inside(p, shape):
    dim, rings = shape
    odd = False
    for r in rings if dim == 2 else []:
        for (ax, ay), (bx, by) in zip(r, r[1:], strict=False):
            if (ay > p[1]) != (by > p[1]) and p[0] < ax + (p[1] - ay) / (by - ay) * (bx - ax):
                odd = not odd
    return odd


def distance(a, b):
    if inside(a[1][0][0], b) or inside(b[1][0][0], a):
        return 0.0
    return min(0.0 if meet(s, t) else min(point_segment(s[0], t), point_segment(s[1], t), point_segment(t[0], s), point_segment(t[1], s)) for s in segments(a) for t in segments(b))


def same(a, b):
    return a[0] == b[0] and {frozenset(s) for s in segments(a)} == {frozenset(s) for s in segments(b)}


def wkt(shape):
    dim, rings = shape
    show = lambda r: "(" + ", ".join(f"{x} {y}" for x, y in r) + ")"
    if dim == 0:
        return f"POINT {show(rings[0])}" if len(rings[0]) == 1 else "MULTIPOINT (" + ", ".join(f"({x} {y})" for x, y in rings[0]) + ")"
    if dim == 1:
        return "MULTILINESTRING (" + ", ".join(map(show, rings)) + ")" if len(rings) > 1 else f"LINESTRING {show(rings[0])}"
    return "POLYGON (" + ", ".join(map(show, rings)) + ")"


def layer(spark, shapes):
    return spark.createDataFrame([(i, wkt(s) if s else None) for i, s in enumerate(shapes)], "id long, t string").select("id", G.from_wkt(F.col("t")).alias("geometry"))


def made(rng, n, spread, kinds=(0, 0, 1, 1, 2, 3)):
    out = []
    for _ in range(n):
        x, y, size = rng.uniform(0, spread), rng.uniform(0, spread), rng.choice([1, 5, 30])
        around = lambda: (x + rng.uniform(-size, size), y + rng.uniform(-size, size))  # noqa: B023, E731
        kind = rng.choice(kinds)
        if kind == 0:
            out.append((0, [[(x, y)]]) if rng.random() < 0.8 else (0, [[around(), around()]]))
        elif kind == 1:
            out.append((1, [[around() for _ in range(rng.randint(2, 5))] for _ in range(rng.choice([1, 1, 2]))]))
        else:
            ring = [(x + size * math.cos(a), y + size * math.sin(a)) for a in (0.1, 1.3, 2.9, 4.4)]
            hole = [(x + size / 3 * math.cos(a), y + size / 3 * math.sin(a)) for a in (0.1, 2.0, 4.0)]
            out.append((2, [[*ring, ring[0]]] + ([[*hole, hole[0]]] if kind == 3 else [])))
    return out


def brute(probes, targets):
    return [min((distance(p, t) for t in targets if not same(p, t)), default=None) for p in probes]


@pytest.mark.parametrize(("seed", "leaf"), [(1, 4), (3, 2)])
def test_all_kinds_equal_brute_force(spark, seed, leaf):
    rng = random.Random(seed)
    probes, targets = made(rng, 50, 400), made(rng, 60, 300)
    # The same shapes on both sides, drawn the other way round, copies, a long line and a far probe.
    targets += [(1, [r[::-1] for r in probes[k][1][::-1]]) if probes[k][0] == 1 else probes[k] for k in range(0, 20, 3)] + [targets[0]] * 3 + [(1, [[(-500.0, 350.0), (900.0, 420.0)]])]
    probes += [(0, [[(50_000.0, -20_000.0)]]), (2, [[(0, 0), (300, 0), (300, 300), (0, 300), (0, 0)]])]
    out = nearest.nearest_distance(layer(spark, probes), layer(spark, targets), "id", 10.0, leaf=leaf)
    got = [r.distance for r in out.orderBy("id").collect()]
    assert got == pytest.approx(brute(probes, targets), rel=1e-9, abs=1e-9)


def test_lines_and_areas_by_hand(spark):
    targets = [(1, [[(-100.0, 5.0), (100.0, 5.0)]]), (2, [[(200, 200), (300, 200), (300, 300), (200, 300), (200, 200)], [(240, 240), (260, 240), (260, 260), (240, 260), (240, 240)]])]
    probes = [(0, [[(0.0, 0.0)]]), (0, [[(210.0, 210.0)]]), (0, [[(250.0, 250.0)]]), (0, [[(250.0, 190.0)]]), None]
    out = nearest.nearest_distance(layer(spark, probes).withColumn("distance", F.lit("x")), layer(spark, targets), "id", 50.0)
    assert [r.distance for r in out.orderBy("id").collect()] == [5.0, 0.0, 10.0, 10.0, None]
    assert out.columns == ["id", "geometry", "distance"]
    assert nearest.nearest_distance(layer(spark, probes), layer(spark, [None]), "id", 50.0).filter("distance IS NOT NULL").count() == 0
    assert nearest.nearest_distance(layer(spark, [None]), layer(spark, targets), "id", 50.0).first().distance is None
    alone = (0, [[(1.0, 1.0)]])
    assert nearest.nearest_distance(layer(spark, [alone]), layer(spark, [alone, alone]), "id", 1.0).first().distance is None


def test_far_probes_meet_few_of_a_crowd(spark):
    """20,000 targets within a metre, and probes both far from them and among them."""
    crowd = spark.range(20_000).select("id", G.point(F.rand(3) - 0.5, F.rand(4) - 0.5).alias("geometry")).union(spark.range(1).select("id", G.point(F.lit(9e4), F.lit(9e4)).alias("geometry")))
    probes = spark.range(300).select("id", F.when(F.col("id") < 150, G.point(1000.0 + F.col("id"), 1000.0 - F.col("id"))).otherwise(G.point(F.rand(5) - 0.5, F.rand(6) - 0.5)).alias("geometry"))
    with stages.scratch(spark) as left:
        out = nearest.nearest_distance(probes, crowd, "id", 100.0)
        assert out.filter("distance IS NULL").count() == 0
        far = out.filter("id < 150").agg(F.min("distance"), F.max("distance")).first()
        assert 1412 < far[0] and far[1] < 1440 and out.filter("id >= 150").agg(F.max("distance")).first()[0] < 0.1
        met = sum(spark.read.parquet(p).count() for p in left if "/met-" in p)
    assert met < 300 * 200  # nodes, of six million pairs


def test_nodes_that_the_level_above_rules_out_are_not_written(spark):
    at = lambda n, a, b: spark.range(n).select("id", G.point(F.rand(a) * 1000, F.rand(b) * 1000).alias("geometry"))
    with stages.scratch(spark) as left:
        assert nearest.nearest_distance(at(100, 1, 2), at(3000, 3, 4), "id", 100.0, leaf=4).filter("distance IS NULL").count() == 0
        met = [spark.read.parquet(p) for p in left if "/met-" in p]
        assert len(met) > 1 and all(m.filter("lower > upper * 1.000001").isEmpty() for m in met)


def test_long_lines_in_a_crowd_leave_few_nodes_to_a_probe(spark):
    """Lines much longer than the tree's cells: before, their boxes lay over many cells, and no bound was better than such a box."""
    x, y, turn = F.rand(7) * 1000, F.rand(8) * 1000, F.rand(9) * 6.28
    lines = spark.range(2000).select(G.line(G.xy(x, y), G.xy(x + 200 * F.cos(turn), y + 200 * F.sin(turn))).alias("geometry"))
    probes = spark.range(500).select("id", G.point(F.rand(10) * 1000, F.rand(11) * 1000).alias("geometry"))
    with stages.scratch(spark) as left:
        got = [r.distance for r in nearest.nearest_distance(probes, lines, "id", 200.0, leaf=32).orderBy("id").collect()]
        met = [spark.read.parquet(p) for p in left if "/met-" in p]
        assert sum(m.filter("leaf").count() for m in met) < 500 * 16
    ends = lambda r: [(v.x, v.y) for part in r.geometry.parts for ring in part for v in ring]
    targets, points = [(1, [ends(r)]) for r in lines.collect()], [(0, [ends(r)]) for r in probes.orderBy("id").collect()]
    assert got[:100] == pytest.approx(brute(points[:100], targets), rel=1e-9, abs=1e-9)


def test_many_rows_are_dealt_out_by_number(spark, monkeypatch):
    rng = random.Random(5)
    probes, targets = made(rng, 40, 300), made(rng, 50, 300)
    monkeypatch.setattr(nearest, "MANY", 10)
    monkeypatch.setattr(nearest, "TASK", 20)
    assert nearest._dealt(spark.range(100), 100, "id").rdd.getNumPartitions() == 5
    out = nearest.nearest_distance(layer(spark, probes), layer(spark, targets), "id", 10.0, leaf=4)
    assert [r.distance for r in out.orderBy("id").collect()] == pytest.approx(brute(probes, targets), rel=1e-9, abs=1e-9)
