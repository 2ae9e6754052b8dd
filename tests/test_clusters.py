"""Density clusters against brute force, also where cells are crowded or hard to tell apart."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoloom.functions import geometry as G
from geoloom.operators import clusters
from geoloom.operators.clusters import cluster
from geoloom.plans import stages


def layer(spark, places):
    df = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(places)], "id long, x double, y double")
    return df.select("id", G.point(F.col("x"), F.col("y")).alias("geometry"))


def plain(places, eps, least):
    """Clusters by all pairs: labels and sizes by row."""
    xy = np.array(places)
    away = np.hypot(xy[:, None, 0] - xy[None, :, 0], xy[:, None, 1] - xy[None, :, 1])
    core = (away <= eps).sum(1) >= least
    label = np.full(len(xy), -1)
    for i in np.flatnonzero(core):
        if label[i] < 0:
            todo, label[i] = [i], i
            while todo:
                j = todo.pop()
                fresh = np.flatnonzero((away[j] <= eps) & core & (label < 0))
                label[fresh] = i
                todo.extend(fresh)
    first = {tuple(p): i for i, p in reversed(list(enumerate(places)))}
    for i in np.flatnonzero(~core):
        near = [(away[i, j], first[tuple(places[j])], label[j]) for j in np.flatnonzero(core & (away[i] <= eps))]
        if near:
            label[i] = min(near)[2]
    lows = sorted({v: min(np.flatnonzero(label == v)) for v in set(label) - {-1}}.items(), key=lambda p: p[1])
    number = {v: n for n, (v, _) in enumerate(lows)} | {-1: -1}
    return [(number[v], int((label == v).sum()) if v >= 0 else 0) for v in label]


def got(spark, places, eps, least):
    return [tuple(r)[1:] for r in cluster(layer(spark, places), "id", eps, least, size_field="size").select("id", "cluster", "size").orderBy("id").collect()]


@pytest.mark.parametrize("seed", range(3))
def test_equal_to_all_pairs(spark, seed, monkeypatch):
    monkeypatch.setattr(clusters, "PAIRS", 4)
    rng = random.Random(seed)
    places = [(rng.uniform(-100, 100), rng.uniform(-100, 100)) for _ in range(150)]
    for _ in range(4):
        x, y, w = rng.uniform(-100, 100), rng.uniform(-100, 100), rng.choice([0.5, 5.0, 20.0])
        places += [(rng.gauss(x, w), rng.gauss(y, w)) for _ in range(60)]
    # Whole-number places repeat and lie exactly eps apart.
    places += [(float(rng.randint(-20, 20) * 5), float(rng.randint(-20, 20) * 5)) for _ in range(120)]
    rng.shuffle(places)
    assert got(spark, places, [10.0, 15.0, 5.0][seed], [4, 6, 1][seed]) == plain(places, [10.0, 15.0, 5.0][seed], [4, 6, 1][seed])


def test_crowds_that_boxes_do_not_tell_apart(spark, monkeypatch):
    """Two arcs across from each other, everywhere just beyond eps or just within: boxes are cut until it shows."""
    monkeypatch.setattr(clusters, "PAIRS", 16)
    turn = [math.radians(a / 4) for a in range(-40, 41)]
    for gap, many in ((1.0001, 2), (0.9999, 1)):
        inner = [(0.001 * math.cos(t), 0.3 * math.sin(t)) for t in turn]
        outer = [(10 * gap - 0.001 * math.cos(t) + 0.002, 0.3 * math.sin(t)) for t in turn]
        places = inner + outer
        answer = got(spark, places, 10.0, 5)
        assert answer == plain(places, 10.0, 5)
        assert len({c for c, _ in answer}) == many


def test_a_crowded_cell_makes_no_pairs(spark, monkeypatch):
    """200,000 places within eps, a ring of loose ones around: written rows stay in proportion to the places."""
    rows = []

    def counting(df, name):
        out, path = stages.written(df, name)
        rows.append((name, out.count()))
        return out

    monkeypatch.setattr(clusters, "materialize", counting)
    crowd = spark.range(200_000).select("id", (F.rand(1) * 6).alias("x"), (F.rand(2) * 6).alias("y"))
    ring = spark.range(20).select((F.col("id") + 200_000).alias("id"), (3 + 11 * F.cos(F.col("id"))).alias("x"), (3 + 11 * F.sin(F.col("id"))).alias("y"))
    df = crowd.union(ring).select("id", G.point(F.col("x"), F.col("y")).alias("geometry"))
    sizes = {r[0]: r[1] for r in cluster(df, "id", 10.0, 50).groupBy("cluster").count().collect()}
    assert sizes == {0: 200_020}
    assert max(n for _, n in rows) <= 200_020
    assert sum(n for name, n in rows if name in ("boxes", "open", "quarters")) < 1000


def test_defined_cases(spark):
    df = layer(spark, [(0.0, 0.0), (-0.0, 0.0), (None, 1.0), (math.nan, 1.0), (math.inf, 0.0), (0.5, 0.0)]).withColumn("root", F.lit("x"))
    assert [tuple(r) for r in cluster(df, "id", 1.0, 3).select("id", "cluster", "root").orderBy("id").collect()] == [(0, 0, "x"), (1, 0, "x"), (2, -1, "x"), (3, -1, "x"), (4, -1, "x"), (5, 0, "x")]
    assert cluster(df.limit(0), "id", 1.0, 3).count() == 0
    lines = spark.range(1).select("id", G.line(G.xy(F.lit(0), F.lit(0)), G.xy(F.lit(1), F.lit(1))).alias("geometry"))
    with pytest.raises(Exception, match="points only"):
        cluster(lines, "id", 1.0, 1).collect()
    with pytest.raises(ValueError):
        cluster(df, "id", 0.0, 3)
