"""Operators on small layers with known answers."""

import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoloom.functions import crs
from geoloom.functions import geometry as G
from geoloom.functions.keys import normalize_key, to_double, to_long
from geoloom.operators import attributes as A
from geoloom.operators import network as N
from geoloom.operators import polygons as P
from geoloom.operators import raster as R
from geoloom.operators import clusters
from geoloom.operators import nearest
from geoloom.operators import spatial as S


def points(spark, rows, extra=""):
    df = spark.createDataFrame(rows, "id long, x double, y double" + extra)
    return df.withColumn("geometry", G.point(F.col("x"), F.col("y")))


def boxes(spark, rows):
    df = spark.createDataFrame([(i, *map(float, b)) for i, *b in rows], "id long, a double, b double, c double, d double")
    return df.select("id", G.box(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("geometry"))


def values(df, *columns):
    return [tuple(r) for r in df.select(*columns).orderBy(columns[0]).collect()]


def test_keys(spark):
    df = spark.createDataFrame([("Köln",), ("  007 ",), ("000",), (None,), ("Île-de-France",)], "k string")
    assert [r[0] for r in df.select(normalize_key(F.col("k"))).collect()] == ["koeln", "7", "0", "none", "iledefrance"]
    df = spark.createDataFrame([("1d",), (" 12 ",), ("1e5",), ("abc",), ("NaN",), ("3.0",), ("3.5",)], "k string")
    assert [r[0] for r in df.select(to_double(F.col("k"))).collect()] == [None, 12, 1e5, None, None, 3, 3.5]
    assert [r[0] for r in df.select(to_long(F.col("k"))).collect()] == [None, 12, None, None, None, 3, None]


def test_attributes(spark):
    df = spark.createDataFrame([(1, 10.0), (2, None), (3, 30.0)], "id long, v double")
    assert values(A.filter_rows(df, "v > 5", ["v"]), "id") == [(1,), (3,)]
    assert values(A.filter_rows(df, "v > 20", ["v"], "include"), "id") == [(2,), (3,)]
    with pytest.raises(Exception, match="missing"):
        A.filter_rows(df, "v > 20", ["v"], "error").collect()
    assert values(A.calculate_field(df, F.try_divide("v", F.lit(0.0)), "w"), "id", "w") == [(1, None), (2, None), (3, None)]
    assert values(A.calculate_field(df, (F.col("v") > 20).cast("int"), "w", compared=["v"]), "id", "w") == [(1, 0.0), (2, None), (3, 1.0)]
    grades = spark.createDataFrame([(1, 100.0), (2, 400.0), (3, 800.0), (4, 2000.0), (5, 300.0)], "id long, v double")
    assert values(A.classify(grades, "v", [300, 500, 1000], ["a", "b", "c", "d"]), "id", "class") == [(1, "a"), (2, "b"), (3, "c"), (4, "d"), (5, "b")]
    two = spark.createDataFrame([(1, 0.0, 10.0, 5.0), (2, 10.0, 0.0, 5.0)], "id long, a double, b double, c double")
    assert values(A.ranking(two, ["a", "b"], [0.5, 0.5]), "id", "score") == [(1, 0.5), (2, 0.5)]
    assert values(A.ranking(two, ["c"], [1.0]), "id", "score") == [(1, 0.0), (2, 0.0)]
    assert values(A.top_n(df, "v", 5, ties=["id"], rank_field="r"), "id", "r") == [(1, 2), (3, 1)]
    twice = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, None)], "id long, k string")
    assert values(A.deduplicate(twice, ["k"], ["id"]), "id") == [(1,), (3,), (4,)]
    assert values(A.deduplicate(twice, ["k"], ["id"], "last"), "id") == [(2,), (3,), (4,)]
    left = spark.createDataFrame([(1, "Köln"), (2, None), (3, "x")], "id long, name string")
    right = spark.createDataFrame([("koeln", 5, 9), (None, 6, 9)], "town string, id long, n long")
    assert values(A.attribute_join(left, right, "name", "town"), "id", "id_right", "n") == [(1, 5, 9), (2, 6, 9), (3, None, None)]
    with pytest.raises(Exception, match="twice"):
        A.attribute_join(left, right.union(right), "name", "town").collect()
    assert A.gate(df, max_rows=2).count() == 0
    assert A.gate(df).count() == 3
    assert values(A.collect({"a": df, "b": twice}), "id", "source").count((1, "a")) == 1
    ok, flaws = A.validate(df, required=["v"], policy="drop")
    assert ok.count() == 2
    with pytest.raises(ValueError, match="no column"):
        A.select_columns(df, keep=["nope"])


def test_measures(spark):
    assert values(S.area(boxes(spark, [(1, 0, 0, 200, 100)]), "ha"), "id", "area_ha") == [(1, 2.0)]
    lines = spark.range(1).withColumn("geometry", G.line(G.xy(F.lit(0), F.lit(0)), G.xy(F.lit(300), F.lit(400))))
    assert values(S.length(lines), "id", "length_m") == [(0, 500.0)]
    c = boxes(spark, [(1, 0, 0, 20, 10)]).select(G.centroid(F.col("geometry")).alias("c")).first().c
    assert (c.x, c.y) == (10, 5)
    texts = [("POINT (1 2)",), ("LINESTRING (0 0, 1 1)",), ("POLYGON ((0 0, 2 0, 2 2, 0 0), (1 0.5, 1.5 0.5, 1.5 0.7, 1 0.5))",), ("MULTIPOINT (1 2, 3 4)",), ("MULTILINESTRING ((0 0, 1 1), (2 2, 3 3))",), ("MULTIPOLYGON (((0 0, 2 0, 2 2, 0 0)), ((5 5, 6 5, 6 6, 5 5)))",), ("nonsense",)]
    got = spark.createDataFrame(texts, "t string").select("t", G.from_wkt(F.col("t")).alias("g"))
    rows = got.select("t", "g", G.from_wkt(G.wkt(F.col("g"))).alias("again")).collect()
    assert [r.g is None for r in rows] == [False] * 6 + [True]
    assert all(r.g == r.again for r in rows)
    assert [len(r.g.parts) for r in rows[:6]] == [1, 1, 1, 2, 2, 2]


def test_spatial(spark):
    zones = boxes(spark, [(1, 0, 0, 10, 10), (2, 10, 0, 20, 10)])
    staff = points(spark, [(1, 1.0, 1.0, 2.0, "general"), (2, 2.0, 2.0, 4.0, "general"), (3, 3.0, 3.0, 6.0, "dentist")], ", staff double, field string")
    assert values(S.aggregate(zones, staff, "id", cell=7.0), "id", "count") == [(1, 3), (2, 0)]
    assert values(S.aggregate(zones, staff, "id", "sum", "staff", cell=7.0), "id", "sum") == [(1, 12.0), (2, 0.0)]
    assert values(S.aggregate(zones, staff, "id", "mean", "staff", cell=7.0), "id", "mean") == [(1, 4.0), (2, None)]
    assert values(S.aggregate(zones, staff, "id", group_by="field", cell=7.0), "id", "count_dentist", "count_general") == [(1, 1, 2), (2, 0, 0)]
    near = lambda xs, ys: [r[1] for r in values(nearest.nearest_distance(points(spark, [(i, float(x), 0.0) for i, x in enumerate(xs)]), points(spark, [(i, float(y), 0.0) for i, y in enumerate(ys)]), "id", 0.5), "id", "distance")]
    assert near([0, 1, 5], [0, 1, 5]) == [1, 1, 4]
    assert near([7], [7]) == [None]
    assert near([0], [0, 0, 3]) == [3]
    assert near([0], [1000]) == [1000]
    spots = [(0, 0), (10, 0), (0, 10), (10, 10), (500, 500), (100, 100), (110, 100), (100, 110), (900, 0)]
    got = values(clusters.cluster(points(spark, [(i, float(x), float(y)) for i, (x, y) in enumerate(spots)]), "id", 20.0, 3, size_field="size"), "id", "cluster", "size")
    assert [r[1] for r in got] == [0, 0, 0, 0, -1, 1, 1, 1, -1]
    assert [r[2] for r in got] == [4, 4, 4, 4, 0, 3, 3, 3, 0]
    bins = S.hexbin(points(spark, [(i, i * 37 % 101 * 10.0, i * 53 % 97 * 10.0) for i in range(200)]), 0.1)
    assert bins.agg(F.sum("count")).first()[0] == 200
    assert bins.select(F.min(G.area(F.col("geometry")))).first()[0] == pytest.approx(math.sqrt(3) / 2 * 100**2)


def test_polygons(spark):
    a, b = boxes(spark, [(1, 0, 0, 2, 2)]), boxes(spark, [(2, 1, 1, 3, 3)])
    assert [r.area for r in P.overlay(a, b, "id", "id", cell=2.0).collect()] == [1.0]
    assert [r.area for r in P.overlay(a, b, "id", "id", "difference", 2.0).collect()] == [3.0]
    assert sum(r.area for r in P.overlay(a, b, "id", "id", "union", 2.0).collect()) == 7.0
    assert [r.area for r in P.dissolve(a.union(b), key="id", cell=2.0).collect()] == [7.0]
    apart = boxes(spark, [(1, 0, 0, 1, 1), (2, 5, 5, 6, 6)])
    assert sorted(r.area for r in P.dissolve(apart, key="id", cell=2.0).collect()) == [1.0, 1.0]
    zones = boxes(spark, [(1, 0, 0, 100, 100), (2, 100, 0, 200, 100)])
    share = lambda rows, **k: values(P.area_share(zones, boxes(spark, rows), "id", cell=50.0, **k), "id", "share")
    assert share([(1, 0, 0, 50, 100)]) == [(1, 0.5), (2, 0.0)]
    assert share([(1, 50, 0, 150, 100)]) == [(1, 0.5), (2, 0.5)]
    over = [(1, 0, 0, 60, 100), (2, 40, 0, 80, 100)]
    assert share(over)[0] == (1, 0.8)
    assert share(over, dissolve=False)[0] == (1, 1.0)
    mask = boxes(spark, [(1, 0, 0, 1, 1)])
    assert values(P.clip(points(spark, [(1, 0.5, 0.5), (2, 5.0, 5.0)]), mask, "id", 2.0), "id") == [(1,)]
    cut = P.clip(a, boxes(spark, [(1, 1, 1, 5, 5)]), "id", 2.0)
    assert cut.select(G.area(F.col("geometry"))).first()[0] == 1.0
    line = spark.range(1).withColumn("geometry", G.line(G.xy(F.lit(0), F.lit(0)), G.xy(F.lit(1000), F.lit(0))))
    assert P.buffer(line, "id", 0.1).first().area == pytest.approx(200000 + math.pi * 100**2, rel=0.01)
    inner = P.to_points(a).select(G.contains_point(F.col("geometry"), F.lit(0), F.lit(0)), G.px(F.col("geometry")), G.py(F.col("geometry"))).first()
    assert 0 < inner[1] < 2 and 0 < inner[2] < 2
    assert P.repair_geometry(a, "id").select(G.area(F.col("geometry"))).first()[0] == 4.0


def test_rasters(spark):
    cells = spark.createDataFrame([(0, i, float(r), n) for i, (r, n) in enumerate([(1, 3.0), (2, 2.0), (3, 9.0), (4, 12.0), (5, None)])], "row long, col long, red double, nir double")
    assert values(R.raster_calc(cells, "try_divide(nir - red, nir + red)", ["red", "nir"], "v"), "col", "v") == [(0, 0.5), (1, 0.0), (2, 0.5), (3, 0.5), (4, None)]
    assert values(R.raster_classify(cells, "red", [2, 4], [1, 2, 3]), "col", "class") == [(0, 1.0), (1, 2.0), (2, 2.0), (3, 3.0), (4, 3.0)]
    grid = R.Grid(10.0, 120.0, 10.0, 2, 3)
    got = [r[2] for r in sorted(map(tuple, R.rasterize(boxes(spark, [(1, 12, 103, 33, 117)]), grid, ["id"], fill=0).select("row", "col", "value").collect()))]
    assert got == [1, 1, 0, 1, 1, 0]
    g2 = R.Grid(0.0, 10.0, 1.0, 10, 10)
    full = g2.cells(spark).withColumn("v", F.lit(100.0))
    zone = boxes(spark, [(1, 0, 0, 10, 10), (2, 50, 50, 60, 60)])
    assert values(R.zonal_stats(zone, full, g2, "id", "v"), "id", "sum_value") == [(1, 10000.0), (2, None)]
    half = full.withColumn("v", F.when(F.col("col") < 5, F.col("v")))
    assert values(R.zonal_stats(zone, half, g2, "id", "v"), "id", "sum_value")[0] == (1, 5000.0)
    assert values(R.zonal_stats(zone, half, g2, "id", "v", "mean"), "id", "mean_value")[0] == (1, 100.0)
    assert R.block_aggregate(full, "v", 5, 5).agg(F.sum("v")).first()[0] == 10000
    plane = g2.cells(spark).withColumn("v", F.col("row") * 10.0 + F.col("col"))
    shifted = R.warp(plane, "v", g2, R.Grid(0.5, 9.5, 1.0, 9, 9), F.col("x"), F.col("y"), "bilinear")
    assert shifted.filter("row = 3 AND col = 4").first().v == pytest.approx(39.5)


def grid_graph(spark):
    nodes = spark.createDataFrame([(3 * i + j, j * 100.0, i * 100.0) for i in range(3) for j in range(3)], "id long, x double, y double")
    pairs = [(3 * i + j, 3 * i + j + 1) for i in range(3) for j in range(2)] + [(3 * i + j, 3 * i + j + 3) for i in range(2) for j in range(3)]
    return nodes, spark.createDataFrame([(a, b, 100.0) for a, b in pairs], "u long, v long, length double")


def test_networks(spark):
    nodes = spark.createDataFrame([(i, 100.0 * i, 0.0) for i in range(4)], "id long, x double, y double")
    edges = spark.createDataFrame([(0, 1, 100.0), (1, 2, 100.0), (2, 3, 100.0)], "u long, v long, length double")
    scored, marked = N.centrality(nodes, edges)
    assert [r[1] for r in values(scored, "id", "betweenness")] == pytest.approx([0, 2 / 3, 2 / 3, 0])
    assert [r[1] for r in values(scored, "id", "is_articulation_point")] == [False, True, True, False]
    assert all(r.is_bridge for r in marked.collect())
    ends = points(spark, [(9, 300.0, 0.0)])
    assert values(N.shortest_path(nodes, edges, points(spark, [(0, 0.0, 0.0), (1, 0.0, 50.0)]), ends, "id", 5.0), "id", "network_distance") == [(0, 300.0), (1, None)]
    g_nodes, g_edges = grid_graph(spark)
    r = N.route(g_nodes, g_edges, points(spark, [(1, 0.0, 0.0)]), points(spark, [(1, 200.0, 200.0)]), "id", 1.0).first()
    assert (r.length_m, r.straight_line_m) == (400.0, pytest.approx(200 * math.sqrt(2)))
    assert len(r.path) == 5
    iso = P.isochrone(N.reached(nodes, edges, points(spark, [(0, 0.0, 0.0)]), "id", 5.0, 200.0), edges, [100, 200], 10.0)
    assert [round(a / 100) for _, a in values(iso, "limit_m", "area")] == [23, 43]
    lines = spark.createDataFrame([("LINESTRING (0 3, 100 2)",), ("LINESTRING (100 0, 200 3)",), ("LINESTRING (200 0, 300 0)",), ("LINESTRING (200 0, 900 0)",)], "t string").select(G.from_wkt(F.col("t")).alias("geometry"))
    _, built = N.build_network(lines, nodes.withColumn("geometry", G.point(F.col("x"), F.col("y"))), 5.0)
    assert [(u, v) for u, v in values(built, "u", "v")] == [(0, 1), (1, 2), (2, 3)]
    cross = spark.createDataFrame([("LINESTRING (0 0, 10 0, 20 0)",), ("LINESTRING (10 0, 10 10)",)], "t string").select(G.from_wkt(F.col("t")).alias("geometry"))
    n, e = N.line_network(cross)
    assert (n.count(), e.count()) == (4, 3)
    assert spark.createDataFrame([("110000;220000",)], "v string").select(N.voltage(F.col("v"))).first()[0] == 220000
    with pytest.raises(Exception, match="unknown node"):
        N.edge_list_network(nodes, spark.createDataFrame([(0, 77)], "a long, b long"), "id", "a", "b")[1].collect()


def test_routes_are_lines(spark):
    t = ["LINESTRING (0 0, 50 10, 100 0)", "LINESTRING (200 0, 150 40, 100 0)", "LINESTRING (100 0, 100 0, 100 100)", "LINESTRING (900 900, 990 900)", "POLYGON ((0 0, -50 0, -50 -50, 0 0))"]
    lines = spark.createDataFrame([(i, f"w{i}", x) for i, x in enumerate(t)], "i long, way string, t string").select("i", "way", G.from_wkt(F.col("t")).alias("geometry"))
    nodes, edges = N.line_network(lines, speed_kmh=6.0, attributes=["way"])
    assert (nodes.count(), edges.count()) == (6, 4)
    assert values(edges, "way", "parallel_edges") == [("w0", 1), ("w1", 1), ("w2", 1), ("w3", 1)]
    a, b, c = 2 * math.hypot(50, 10), 2 * math.hypot(50, 40), 100.0
    r = N.route(nodes, edges, points(spark, [(1, 0.0, 1.0), (2, 900.0, 900.0), (3, 100.0, 0.0)]), points(spark, [(1, 200.0, 0.0), (2, 990.0, 900.0), (3, 100.0, 0.0)]), "id", 5.0, weight="travel_time_min")
    one, two, three = sorted(r.collect())
    assert (one.length_m, one.travel_time_min) == (pytest.approx(a + b), pytest.approx((a + b) / 100))
    assert [(p.x, p.y) for p in one.geometry.parts[0][0]] == [(0, 0), (50, 10), (100, 0), (150, 40), (200, 0)]
    assert one.origin_snap_m == 1.0
    assert (two.length_m, two.origin_snap_m, two.geometry) == (None, None, None)  # not in the largest component
    assert (three.length_m, three.path, three.geometry) == (0.0, ["100.000000/0.000000"], None)
    any_node = N.route(nodes, edges, points(spark, [(2, 900.0, 900.0)]), points(spark, [(7, 990.0, 900.0), (8, 0.0, 0.0)]), "id", 5.0, "cross", snap_to="any_node")
    assert values(any_node, "destination", "length_m") == [(7, 90.0), (8, None)]
    long = spark.range(12).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"), F.lit(10.0).alias("length"))
    row = spark.range(13).select("id", (F.col("id") * 10.0).alias("x"), F.lit(0.0).alias("y"))
    far = N.route(row, long, points(spark, [(1, 110.0, 0.0)]), points(spark, [(1, 0.0, 0.0)]), "id", 1.0).first()
    assert (far.length_m, far.path, len(far.geometry.parts[0][0])) == (110.0, list(range(11, -1, -1)), 12)
    with pytest.raises(ValueError, match="no travel_time_min"):
        N.route(row, long, points(spark, [(1, 0.0, 0.0)]), points(spark, [(1, 0.0, 0.0)]), "id", 1.0, weight="travel_time_min")


def test_line_network_options(spark):
    t = ["LINESTRING (0 0, 100 0)", "LINESTRING (100.5 0.2, 200 0)", "LINESTRING (200 0, 200.3 0)", "POLYGON ((200 0, 300 0, 300 100, 200 0))"]
    lines = spark.createDataFrame([(x,) for x in t], "t string").select(G.from_wkt(F.col("t")).alias("geometry"))
    nodes, edges = N.line_network(lines, tolerance_m=1.0)
    assert values(nodes, "x") == [(0.0,), (100.0,), (200.0,)]
    assert values(edges, "length") == [(100.0,), (100.0,)]
    assert N.line_network(lines)[1].count() == 3
    nodes, edges = N.line_network(lines, polygons="boundary")
    assert nodes.filter("x = 200 AND y = 0").count() == 1
    with pytest.raises(ValueError, match="makes length itself"):
        N.line_network(lines, attributes=["length"])


def test_projections_there_and_back(spark):
    df = spark.createDataFrame([(12.0, 51.0), (10.0, 52.0), (8.9, 47.3)], "lon double, lat double")
    for epsg in (4326, 3857, 3035, 6933, 32632, 25833):
        x, y = crs.project(F.col("lon"), F.col("lat"), epsg)
        for r in df.select("lon", "lat", *[c.alias(n) for c, n in zip(crs.unproject(x, y, epsg), "ab", strict=True)]).collect():
            assert (r.a, r.b) == (pytest.approx(r.lon, abs=1e-7), pytest.approx(r.lat, abs=1e-7))
    south = df.select(*[c.alias(n) for c, n in zip(crs.unproject(*crs.project(F.col("lon"), -F.col("lat"), 32732), 32732), "ab", strict=True)]).first()
    assert tuple(south) == (pytest.approx(12.0, abs=1e-7), pytest.approx(-51.0, abs=1e-7))
    g = df.select(crs.reproject(crs.reproject(G.point(F.col("lon"), F.col("lat")), 32633), 3035, 32633).alias("g"), *[c.alias(n) for c, n in zip(crs.project(F.col("lon"), F.col("lat"), 3035), "xy", strict=True)])
    for r in g.collect():
        p = r.g.parts[0][0][0]
        assert (p.x, p.y) == (pytest.approx(r.x, abs=0.01), pytest.approx(r.y, abs=0.01))
    assert [crs.utm_epsg(13.7, 51.0), crs.utm_epsg(-70.0, -33.0), crs.utm_epsg(180.0, 10.0)] == [32633, 32719, 32660]
    with pytest.raises(ValueError, match="no UTM zone"):
        crs.utm_epsg(0.0, 85.0)


def test_projections(spark):
    df = spark.createDataFrame([(12.0, 51.0)], "lon double, lat double")
    at = lambda epsg: tuple(df.select(*[c.alias(n) for c, n in zip(crs.project(F.col("lon"), F.col("lat"), epsg), "xy", strict=True)]).first())
    assert at(32633) == pytest.approx((289511.143, 5654109.239), abs=0.5)
    assert at(3857) == pytest.approx((1335833.890, 6621293.723), abs=0.01)
    assert df.select(*[c.alias(n) for c, n in zip(crs.project(F.lit(10.0), F.lit(52.0), 3035), "xy", strict=True)]).first()[0] == pytest.approx(4321000)
    with pytest.raises(ValueError, match="no formula"):
        crs.project(F.lit(0), F.lit(0), 31468)


def test_area_warp(spark):
    source, target = R.Grid(0.0, 4.0, 1.0, 4, 4), R.Grid(0.5, 4.0, 2.0, 2, 1)
    cells = source.cells(spark).withColumn("v", (F.col("col") + 1).cast("double"))
    assert sorted(map(tuple, R.warp_area(cells, "v", source, target).collect())) == [(0, 0, 2.0), (1, 0, 2.0)]
    assert R.warp_area(cells, "v", source, R.Grid(-1.0, 5.0, 3.0, 2, 2), "sum").agg(F.sum("v")).first()[0] == pytest.approx(40.0)


def test_power_grid(spark):
    stations = boxes(spark, [(1, 0, 0, 10, 10), (2, 100, 0, 110, 10)])
    lines = spark.createDataFrame([("LINESTRING (5 5, 50 50)",), ("LINESTRING (50.5 50, 101 5)",), ("LINESTRING (5 5, 6 6)",), ("LINESTRING (300 300, 400 300)",)], "t string").select(G.from_wkt(F.col("t")).alias("geometry"))
    nodes, edges = N.grid_of_lines(lines, stations, "id", 1.0)
    assert sorted(r.kind for r in nodes.collect()) == ["end"] * 3 + ["substation"] * 2
    assert edges.count() == 3
    assert {"s1", "s2"} <= {n for e in edges.collect() for n in (e.u, e.v)}


def _random_polygon(rng, cx, cy, r, n=9):
    at = sorted(rng.uniform(0, 2 * math.pi) for _ in range(n))
    ring = [(cx + rng.uniform(0.4, 1) * r * math.cos(t), cy + rng.uniform(0.4, 1) * r * math.sin(t)) for t in at]
    return [*ring, ring[0]]


def _has(polygon, x, y):
    """Even-odd rule over all rings, for arrays of places."""
    inside = np.zeros(len(x), bool)
    for ring in polygon:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:], strict=False):
            spans = (y1 > y) != (y2 > y)
            with np.errstate(divide="ignore", invalid="ignore"):
                inside ^= spans & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1)
    return inside


def test_slanted_polygons_with_holes(spark):
    """Shares, unions and differences of random polygons against the share of many places."""
    rng = random.Random(12)
    hole = lambda ring, cx, cy: [(cx + (x - cx) * 0.3, cy + (y - cy) * 0.3) for x, y in ring]
    made = {}
    for side in "ab":
        for i in range(6):
            cx, cy = rng.uniform(0, 3000), rng.uniform(0, 3000)
            ring = _random_polygon(rng, cx, cy, 900)
            made[side, i] = [ring, hole(ring, cx, cy)]
    layer = lambda side: spark.createDataFrame(
        [(i, ("Polygon", 2, [polygon])) for (s, i), polygon in made.items() if s == side], f"id int, geometry {G.GEOMETRY}")
    x, y = (c.ravel() for c in np.meshgrid(np.arange(-997.3, 4000, 5.0), np.arange(-998.1, 4000, 5.0)))
    each = 25.0
    has = {k: _has(p, x, y) for k, p in made.items()}
    any_b = np.any([h for (s, _), h in has.items() if s == "b"], axis=0)
    any_a = np.any([h for (s, _), h in has.items() if s == "a"], axis=0)
    near = lambda got, want: abs(got - want) < 3_000
    for r in P.overlay(layer("a"), layer("b"), "id", "id", "difference").collect():
        assert near(r.area, (has["a", r.id_1] & ~any_b).sum() * each)
    for r in P.area_share(layer("a"), layer("b"), "id", absolute_field="m2").collect():
        assert near(r.m2, (has["a", r.id] & any_b).sum() * each)
    whole = P.dissolve(layer("a").withColumn("one", F.lit(1)), by="one", first=["id"], order=["id"]).first()
    assert near(whole.area, any_a.sum() * each)
    assert whole.id == 0
    again = P.area_share(layer("a").limit(1), P.dissolve(layer("a").withColumn("one", F.lit(1)), by="one"), "id", decimals=6).first()
    assert again.share == 1.0  # the result of a union is a layer again


def test_lines_in_cells(spark):
    grid = R.Grid(0.0, 40.0, 10.0, 4, 4)
    line = spark.createDataFrame([(1, ("LineString", 1, [[[(1.0, 39.0), (38.0, 12.0)]]]))], f"id int, geometry {G.GEOMETRY}")
    thin = {(r.row, r.col) for r in R.rasterize(line, grid, ["id"]).filter("value = 1").collect()}
    thick = {(r.row, r.col) for r in R.rasterize(line, grid, ["id"], all_touched=True).filter("value = 1").collect()}
    t = np.linspace(0, 1, 100_001)
    want = set(zip(((40 - (39 - 27 * t)) // 10).astype(int).tolist(), ((1 + 37 * t) // 10).astype(int).tolist(), strict=True))
    assert thick == want
    assert thin <= want
    assert len(thin) == 4
    assert R.grid_of(line, 10.0) == R.Grid(0.0, 40.0, 10.0, 3, 4)
    edge = spark.createDataFrame([(1, ("Point", 0, [[[(20.0, 10.0)]]])), (2, ("Point", 0, [[[(0.0, 30.0)]]]))], f"id int, geometry {G.GEOMETRY}")
    assert R.grid_of(edge, 10.0) == R.Grid(0.0, 30.0, 10.0, 3, 3)


def test_parallel_lines_count_and_keep_columns(spark):
    ends = [("LineString", 1, [[[(0.0, 0.0), (10.0, 0.0)]]]), ("LineString", 1, [[[(0.0, 0.0), (10.0, 0.0)]]]), ("LineString", 1, [[[(0.0, 0.0), (5.0, 5.0), (10.0, 0.0)]]])]
    lines = spark.createDataFrame([("a", ends[0]), ("b", ends[1]), ("c", ends[2])], f"name string, geometry {G.GEOMETRY}")
    nodes = spark.createDataFrame([(1, ("Point", 0, [[[(0.0, 0.0)]]])), (2, ("Point", 0, [[[(10.0, 0.0)]]]))], f"id int, geometry {G.GEOMETRY}")
    (edge,) = N.build_network(lines, nodes, 1.0)[1].collect()
    assert (edge.u, edge.v, edge.length, edge.parallel_edges) == (1, 2, 10.0, 3)
    assert edge.name in ("a", "b")


def test_clip_cuts_lines(spark):
    line = spark.createDataFrame([(1, ("LineString", 1, [[[(-500.0, 5.0), (500.0, 5.0)]]])), (2, ("LineString", 1, [[[(20.0, 0.0), (20.0, 9.0)]]]))], f"id int, geometry {G.GEOMETRY}")
    mask = spark.createDataFrame([(("Polygon", 2, [[[(-50.0, 0.0), (10.0, 0.0), (10.0, 10.0), (-50.0, 10.0), (-50.0, 0.0)]]]),), (("Polygon", 2, [[[(0.0, 0.0), (30.0, 0.0), (0.0, 30.0), (0.0, 0.0)]]]),)], f"geometry {G.GEOMETRY}")
    out = {r.id: r for r in P.clip(line, mask, "id").withColumn("length", G.length(F.col("geometry"))).collect()}
    assert out[1].length == pytest.approx(75)
    assert len(out[1].geometry.parts) == 1
    assert out[2].length == pytest.approx(9)


def test_shared_folder(spark):
    from geoloom.plans import stages

    class Far:
        conf = spark.conf
        sparkContext = type("C", (), {"master": "spark://far:7077"})()

    if not spark.conf.get("spark.checkpoint.dir", None):
        with pytest.raises(ValueError, match="checkpoint"):
            stages.shared_dir(Far())
    with stages.scratch(spark) as paths:
        df, path = stages.written(spark.range(3), "test")
        assert df.count() == 3
        assert path in paths
    assert not os.path.exists(path)
    assert path not in paths


def test_several_points_are_clipped_one_by_one(spark):
    t = ["MULTIPOINT ((1 1), (100 100))", "MULTIPOINT ((1 1), (2 2), (50 50), (10 5))", "MULTIPOINT ((70 70), (80 80))", "POINT (3 3)"]
    df = spark.createDataFrame(list(enumerate(t)), "id long, t string").select("id", G.from_wkt(F.col("t")).alias("geometry"))
    out = {r.id: r.w for r in P.clip(df, boxes(spark, [(1, 0, 0, 10, 10), (2, 0, 0, 10, 10)]), "id", 5.0).select("id", G.wkt(F.col("geometry")).alias("w")).collect()}
    assert out == {0: "POINT (1.0 1.0)", 1: "MULTIPOINT ((1.0 1.0), (2.0 2.0), (10.0 5.0))", 3: "POINT (3.0 3.0)"}


def test_largest_geometry_by_dimension(spark):
    t = ["LINESTRING (0 0, 5000 0)", "POLYGON ((0 0, 10 0, 10 10, 0 10, 0 0))", "POLYGON ((0 0, 1 0, 1 100, 0 100, 0 0))", "POINT (0 0)", None]
    df = spark.createDataFrame([(i, "k", x) for i, x in enumerate(t)], "id long, k string, t string").select("id", "k", G.from_wkt(F.col("t")).alias("geometry"))
    pick = lambda where: A.deduplicate(df.filter(where), ["k"], ["id"], "largest_geometry").first().id
    assert (pick("true"), pick("id <> 2"), pick("id IN (0, 3, 4)"), pick("id > 2")) == (2, 1, 0, 3)


def test_valid_share_counts_cells(spark):
    grid = R.Grid(0.0, 100.0, 10.0, 10, 10)
    cells = grid.cells(spark).withColumn("v", F.lit(1.0))
    zones = boxes(spark, [(1, 11, 11, 24, 24), (2, 81, 81, 121, 121), (3, 12, 12, 13, 13)])
    out = R.zonal_stats(zones, cells, grid, "id", "v", min_valid_share=0.8, valid_share_field="share")
    assert values(out, "id", "sum_value", "share") == [(1, 1.0, 1.0), (2, None, 0.25), (3, None, None)]
    ring = "POLYGON ((0 0, 100 0, 50 100, 0 0), (40 20, 60 20, 50 40, 40 20))"
    zone = spark.createDataFrame([(1, ring)], "id long, t string").select("id", G.from_wkt(F.col("t")).alias("geometry"))
    fine = R.Grid(0.3, 100.4, 1.0, 101, 101)
    n = fine.cells(spark).crossJoin(zone).filter(G.interior(F.col("geometry"), fine.x(F.col("col")), fine.y(F.col("row")))).count()
    assert R.zone_cells(zone, fine, "id").first().cells == n
