"""Vertices on long edges, against dense references."""

import math

import pytest
from pyspark.sql import functions as F

from geoloom.functions import crs
from geoloom.functions import geometry as G


def to_segment(p, a, b):
    dx, dy = b[0] - a[0], b[1] - a[1]
    t = max(0.0, min(1.0, ((p[0] - a[0]) * dx + (p[1] - a[1]) * dy) / (dx * dx + dy * dy)))
    return math.hypot(p[0] - a[0] - t * dx, p[1] - a[1] - t * dy)


@pytest.mark.parametrize(("epsg", "lon", "lat"), [(3857, 30.0, 20.0), (3035, 15.0, 8.0), (32632, 6.0, 3.0), (6933, 20.0, 25.0)])
def test_edges_stay_near_dense_ones(spark, epsg, lon, lat):
    ends = [(5.0, 45.0), (5.0 + lon, 45.0 + lat)]
    line = G.line(*[G.xy(F.lit(x), F.lit(y)) for x, y in ends])
    dense = F.transform(F.sequence(F.lit(0), F.lit(4000)), lambda i: G.xy(ends[0][0] + lon * i / 4000, ends[0][1] + lat * i / 4000))
    for within in (1000.0, 10.0):
        row = spark.range(1).select(crs.reproject(line, epsg, within=within).alias("g"), crs.reproject(G.line_of(dense), epsg).alias("d"), crs.reproject(line, epsg).alias("plain")).first()
        got, truth = ([(v["x"], v["y"]) for v in g["parts"][0][0]] for g in (row.g, row.d))
        assert (got[0], got[-1]) == tuple((v["x"], v["y"]) for v in row.plain["parts"][0][0])
        off = [min(to_segment(p, a, b) for a, b in zip(got, got[1:], strict=False)) for p in truth[::20]]
        assert max(off) <= within * 1.01
        # Not cut more than it needs: with half as many pieces it would be off.
        half = got[::2]
        assert len(got) == 2 or len(half) < 2 or max(min(to_segment(p, a, b) for a, b in zip(half, half[1:], strict=False)) for p in truth[::20]) > within * 0.5


def test_defined_cases(spark):
    square = F.array(*[G.xy(F.lit(x), F.lit(y)) for x, y in [(0, 40), (10, 40), (10, 50), (0, 50), (0, 40)]])
    df = spark.range(1).select(
        crs.densify(G.polygon_of(square), 3035, 100.0).alias("polygon"),
        crs.densify(G.point(F.lit(1.0), F.lit(2.0)), 3035, 100.0).alias("point"),
        crs.densify(F.lit(None).cast(G.GEOMETRY), 3035, 100.0).alias("none"),
        crs.densify(G.line(G.xy(F.lit(1), F.lit(1)), G.xy(F.lit(1), F.lit(1))), 3857, 1.0).alias("still"),
        crs.densify(G.line(G.xy(F.lit(0), F.lit(0)), G.xy(F.lit(90), F.lit(0))), 3857, 1.0).alias("straight"),
    )
    row = df.first()
    ring = [(v["x"], v["y"]) for v in row.polygon["parts"][0][0]]
    assert ring[0] == ring[-1] == (0, 40) and {(10, 40), (10, 50), (0, 50)} < set(ring) and len(ring) > 20
    assert all(x in (0, 10) or y in (40, 50) for x, y in ring)
    assert row.point["parts"] == [[[(1.0, 2.0)]]] and row.none is None
    assert [len(row[c]["parts"][0][0]) for c in ("still", "straight")] == [2, 2]
    far = G.line(G.xy(F.lit(0), F.lit(0)), G.xy(F.lit(0), F.lit(89.9)))
    with pytest.raises(Exception, match="too far off"):
        spark.range(1).select(crs.reproject(far, 3035, within=1e-9)).collect()
    with pytest.raises(Exception, match="cannot be projected"):
        spark.range(1).select(crs.reproject(G.line(G.xy(F.lit(0), F.lit(0)), G.xy(F.lit(math.nan), F.lit(5))), 3857, within=10.0)).collect()
