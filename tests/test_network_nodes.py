"""Nodes of line ends within a tolerance, against taking them one by one."""

import math
import random

import pytest
from pyspark.sql import functions as F

from geoloom.functions import geometry as G
from geoloom.operators import network as N


def one_by_one(points, tolerance):
    groups, of = [], {}
    for i, p in enumerate(points):
        if i not in of:
            own = [j for j, q in enumerate(points) if j not in of and math.hypot(p[0] - q[0], p[1] - q[1]) <= tolerance]
            of |= dict.fromkeys(own, len(groups))
            groups.append(own)
    return sorted((sum(points[i][0] for i in g) / len(g), sum(points[i][1] for i in g) / len(g)) for g in groups)


@pytest.mark.parametrize(("seed", "spread", "tolerance"), [(1, 100, 3.0), (2, 20, 5.0), (3, 1000, 40.0)])
def test_groups_equal_one_by_one(spark, seed, spread, tolerance):
    rng = random.Random(seed)
    at = lambda: (round(rng.uniform(0, spread), 1), round(rng.uniform(0, spread), 1))
    lines = [[[at(), at(), at()][: rng.randint(2, 3)] for _ in range(rng.choice([1, 1, 2]))] for _ in range(60)]
    lines += lines[:5]
    text = lambda r: "(" + ", ".join(f"{x} {y}" for x, y in r) + ")"
    rows = [(i, "MULTILINESTRING (" + ", ".join(map(text, parts)) + ")") for i, parts in enumerate(lines)] + [(900, "POINT (1 1)"), (901, None)]
    df = spark.createDataFrame(rows, "id long, t string").select("id", G.from_wkt(F.col("t")).alias("geometry"))
    out = N.network_nodes(df, tolerance_m=tolerance, order=["id"]).collect()
    ends = [p for parts in lines for r in parts for p in (r[0], r[-1])]
    got, want = sorted((r.x, r.y) for r in out), one_by_one(ends, tolerance)
    assert len(got) == len(want) and all(a == pytest.approx(b, abs=1e-9) for a, b in zip(got, want, strict=True))


def test_nodes_awkward(spark):
    df = spark.createDataFrame([(1, "LINESTRING (0 0, 3 0)"), (2, "LINESTRING (1 0, 2 0)")], "id long, t string").select("id", G.from_wkt(F.col("t")).alias("geometry"))
    # 0 takes 1; 3 takes 2, though 1 and 2 are near each other.
    assert sorted(r.x for r in N.network_nodes(df, tolerance_m=1.0, order=["id"]).collect()) == [0.5, 2.5]
    assert N.network_nodes(df.filter("false"), tolerance_m=1.0, order=["id"]).count() == 0
    with pytest.raises(ValueError, match="needs an order"):
        N.network_nodes(df, tolerance_m=1.0)
    # A crowd within the tolerance is one group, without pairs of its places.
    crowd = spark.range(20_000).select("id", G.line(G.xy(F.rand(1), F.rand(2)), G.xy(F.rand(3), F.rand(4))).alias("geometry"))
    assert N.network_nodes(crowd, tolerance_m=2.0, order=["id"]).count() == 1


def test_points_are_dealt_out_before_they_are_snapped(spark):
    """A task must not sort what a whole split of points becomes; a broadcast of the nodes would leave them where they are."""
    from pyspark.sql import functions as F

    from geoloom.functions import geometry as G
    from geoloom.operators import network as N

    nodes = spark.range(50).select("id", (F.col("id") * 10.0).alias("x"), F.lit(0.0).alias("y"))
    out = N._snap(nodes.select("id", G.point(F.col("x") + 0.5, F.col("y")).alias("geometry")), nodes, "id", 1.0)
    assert "BroadcastHashJoin" not in out._jdf.queryExecution().executedPlan().toString()
    assert {(r.k, r.node, r.snap) for r in out.collect()} == {(i, i, 0.5) for i in range(50)}
