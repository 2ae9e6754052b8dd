"""Unions and differences of polygons by cells of uneven sizes, against the kernel on everything at once."""

import math
import random

import pytest
from pyspark.sql import functions as F

from geoloom.functions import geometry as G
from geoloom.operators import polygons as P
from geoloom.operators import spatial as S


def layer(spark, rows, keys=None):
    data = [((keys or {}).get(i, i), [[[{"x": float(x), "y": float(y)} for x, y in ring]]]) for i, ring in enumerate(rows)]
    df = spark.createDataFrame(data, "id long, parts array<array<array<struct<x: double, y: double>>>>")
    return df.select("id", G.geometry("Polygon", F.col("parts")).alias("geometry"))


def ngon(x, y, r, n, turn):
    return [(x + r * math.cos(turn + 2 * math.pi * (i % n) / n), y + r * math.sin(turn + 2 * math.pi * (i % n) / n)) for i in range(n + 1)]


def square(x, y, s):
    return [(x, y), (x + s, y), (x + s, y + s), (x, y + s), (x, y)]


def shapes(rng, n):
    return [ngon(rng.uniform(-300, 300), rng.uniform(-300, 300), rng.choice([3, 20, 150]), rng.randint(3, 7), rng.random()) for _ in range(n)]


def area(rings, others, rule):
    return P.total_area(P.trapezoids([[[[r]] for r in rings], [[[r]] for r in others]], P.RULES[rule]))


def test_slanted_shapes_in_uneven_cells(spark, monkeypatch):
    monkeypatch.setattr(P, "CROWD", 6)
    monkeypatch.setattr(P, "BLOCK", 2)
    rng = random.Random(4)
    a, b = shapes(rng, 40), shapes(rng, 30)
    b += b[:8]  # copies
    keys = {i: i % 2 for i in range(len(a))}
    got = dict(P.united(layer(spark, a, keys), "id", 100.0).select("k", "area").collect())
    for k in (0, 1):
        assert got[k] == pytest.approx(area([r for i, r in enumerate(a) if keys[i] == k], [], "union"), rel=1e-9)
    for rule in ("difference", "intersection"):
        got = dict(P._against(layer(spark, a), layer(spark, b), "id", rule, 100.0).select("k", "area").collect())
        for i, r in enumerate(a):
            assert got.get(i, 0.0) == pytest.approx(area([r], b, rule), rel=1e-9, abs=1e-6)


def test_a_crowded_cell_and_a_stack(spark, monkeypatch):
    """2,000 small shapes in one cell, and 300 large ones over another: no square keeps a crowd."""
    small = [square(10 + 2 * (i % 50), 10 + 2 * (i // 50), 1.5) for i in range(2000)]
    large = [square(900 - i, -100 - i, 2000 + 2 * i) for i in range(300)]
    df = layer(spark, small + large)
    pieces, _ = P._parted(P._cut(df, None, 1000.0), ["cx", "cy"], 1000.0)
    per = pieces.groupBy("size", "cx", "cy").count()
    assert per.filter("cx >= 1 AND size = 1000 AND cx <= 1 AND cy BETWEEN 0 AND 0").collect()[0]["count"] == 1
    assert per.filter("cx * size < 500 AND cy * size >= 0 AND cy * size < 500").agg(F.max("count")).first()[0] <= P.CROWD
    whole = P.united(df.withColumn("id", F.lit(1)), "id", 1000.0).first()["area"]
    left, top = 900 - 299, -100 - 299
    assert whole == pytest.approx(2000 * 1.5**2 + (2000 + 598) ** 2, rel=1e-9) and left > 110 and top < 0


def test_a_large_shape_is_cut_level_by_level(spark, monkeypatch):
    """A polygon over 2,304 cells: nowhere is it copied whole to more squares than a block has."""
    met = []

    def counting(rows, size, cut=P._cut_by):
        met.append((size, rows.select(F.size(F.flatten(F.flatten("geometry.parts"))).alias("n")).agg(F.count("*"), F.max("n")).first()))
        return cut(rows, size)

    monkeypatch.setattr(P, "_cut_by", counting)
    country = ngon(2400, 2400, 2400, 200, 0.1)
    got = P.united(layer(spark, [country, square(100, 100, 50)]).withColumn("id", F.lit(1)), "id", 100.0).first()
    assert got["area"] == pytest.approx(area([country, square(100, 100, 50)], [], "union"), rel=1e-9)
    assert [s for s, _ in met] == [1600.0, 100.0]
    assert met[0][1][0] == 2 and met[1][1][0] <= 17  # the shapes whole, then one piece a block
    with pytest.raises(ValueError):
        P.united(layer(spark, [[(0, 0), (math.inf, 0), (1, 1), (0, 0)]]), "id")


def test_empty_layers(spark):
    none = layer(spark, [square(0, 0, 1)]).limit(0)
    assert P.united(none, "id").count() == 0
    assert P._against(layer(spark, [square(0, 0, 1)]), none, "id", "difference", 10.0).first()["area"] == 1.0
    assert P._against(none, none, "id", "intersection", 10.0).count() == 0


def test_pairs_in_cells_of_several_sizes(spark):
    """Each pair once, whatever the sizes; a large shape lies in few cells."""
    rng = random.Random(9)
    boxes = lambda n: [square(rng.uniform(-500, 500), rng.uniform(-500, 500), rng.choice([0.5, 8, 90, 700])) for _ in range(n)]
    a, b = boxes(60), boxes(70)
    touch = lambda p, q: all(min(v[i] for v in p) <= max(v[i] for v in q) and min(v[i] for v in q) <= max(v[i] for v in p) for i in (0, 1))
    want = sorted((i, j) for i, p in enumerate(a) for j, q in enumerate(b) if touch(p, q))
    for cell in (100, [10.0, 100.0, 1000.0], (1000.0, 5.0)):
        got = S.pairs(layer(spark, a), layer(spark, b), cell, F.lit(True))
        assert sorted((r.l.id, r.r.id) for r in got.collect()) == want
    large = layer(spark, [square(0, 0, 10_000)])
    assert S._placed(large, [10.0, 20_000.0], "l").count() <= 4
    assert S._placed(large, [10.0], "l").count() == 1001 * 1001


def test_points_deep_in_zones_are_no_pairs(spark, monkeypatch):
    """Polygons of any shape, with a hole, and points on borders: the same numbers as by pairs, which only a line and an area need."""
    rng = random.Random(12)
    rings = [[ngon(rng.uniform(-900, 900), rng.uniform(-900, 900), rng.choice([5, 60, 900]), rng.randint(3, 7), rng.random())] for _ in range(25)]
    rings += [[square(-500, -500, 1000), square(-200, -200, 300)[::-1]], [square(0, 0, 64)]]
    data = [(i, [[[{"x": float(x), "y": float(y)} for x, y in r] for r in of]]) for i, of in enumerate(rings)]
    zones = spark.createDataFrame(data, "id long, parts array<array<array<struct<x: double, y: double>>>>").select("id", G.geometry("Polygon", F.col("parts")).alias("geometry"))
    spots = [(rng.uniform(-1000, 1000), rng.uniform(-1000, 1000), float(i)) for i in range(600)] + [(0.0, 0.0, 1.0), (64.0, 32.0, None), (-200.0, -100.0, 5.0), (32.0, 32.0, 7.0)]
    points = spark.createDataFrame(spots, "x double, y double, v double").select(G.point(F.col("x"), F.col("y")).alias("geometry"), "v")
    line = spark.range(1).select(G.line(G.xy(F.lit(-999), F.lit(3)), G.xy(F.lit(999), F.lit(3))).alias("geometry"), F.lit(2.0).alias("v"))
    for statistic in ("count", "sum", "mean"):
        field = None if statistic == "count" else "v"
        both = points.unionByName(line)
        got, want = (S.aggregate(zones, both, "id", statistic, field, cell=c).select("id", F.round(statistic, 6)).orderBy("id").collect() for c in ((10.0, 300.0), 300.0))
        assert got == want
    monkeypatch.setattr(S, "pairs", None)
    assert S.aggregate(zones, points, "id", cell=(10.0, 300.0)).agg(F.sum("count")).first()[0] > 600
