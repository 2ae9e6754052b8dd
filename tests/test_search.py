"""Searches in cut graphs against Dijkstra's algorithm on the whole, and what a search writes."""

import heapq
import random

import pytest
from pyspark.sql import functions as F

from geoloom.operators import network as N
from geoloom.operators import search as S
from geoloom.plans import stages


def whole(edges, sources):
    """node: (d, hops, before), by one search over all edges."""
    graph = {}
    for u, v, w in edges:
        graph.setdefault(u, []).append((v, w))
        graph.setdefault(v, []).append((u, w))
    best = {s: (0.0, 0, None) for s in sources}
    heap = [(0.0, 0, s) for s in sources]
    while heap:
        d, hops, u = heapq.heappop(heap)
        if best[u][:2] != (d, hops):
            continue
        for v, w in graph.get(u, ()):
            new, old = (d + w, hops + 1, u), best.get(v)
            if old is None or new[:2] < old[:2]:
                best[v] = new
                heapq.heappush(heap, (*new[:2], v))
            elif new[:2] == old[:2] and u < old[2]:
                best[v] = new
    return best


@pytest.fixture(scope="module")
def grid(spark):
    """Edges of a grid with gaps, ties and weights of 0, and a hub that every other node is joined with."""
    rng, w = random.Random(2), 16
    edges = [(x * w + y, x * w + y + 1, float(rng.choice([0, 1, 1, 2, 5]))) for x in range(w) for y in range(w - 1) if rng.random() < 0.85]
    edges += [(x * w + y, (x + 1) * w + y, float(rng.choice([0, 1, 1, 2, 5]))) for x in range(w - 1) for y in range(w) if rng.random() < 0.85]
    edges += [(0, k, 40.0) for k in range(1, w * w, 2)]
    nodes = spark.createDataFrame([(k, float(k // w), float(k % w)) for k in range(w * w)], "id long, x double, y double")
    unknown = [(3, 7, None), (5, 6, float("inf")), (5, 8, float("nan")), (9, 9, 1.0)]
    return edges, spark.createDataFrame(edges + unknown, "u long, v long, length double"), nodes


@pytest.mark.parametrize(("arcs", "placed"), [(10**6, False), (250, False), (120, True)])
def test_distances_and_ways(spark, grid, arcs, placed):
    edges, df, nodes = grid
    nodes = nodes if placed else None
    sources = [(0, 0), (1, 57), (1, 200), (2, 255), (3, 999), (4, None)]
    rows = N.distances(df, spark.createDataFrame(sources, "source long, node long"), before=True, nodes=nodes, part_arcs=arcs).collect()
    want = {0: whole(edges, [0]), 1: whole(edges, [57, 200]), 2: whole(edges, [255]), 3: {999: (0.0, 0, None)}}
    assert {(r.source, r.node, r.d, r.before) for r in rows} == {(s, n, d, b) for s, of in want.items() for n, (d, _, b) in of.items()}
    assert len(rows) == sum(map(len, want.values()))
    near = N.distances(df, spark.createDataFrame([(2, 255)], "source long, node long"), limit=6.0, nodes=nodes, part_arcs=arcs).collect()
    assert {(r.node, r.d) for r in near} == {(n, v[0]) for n, v in want[2].items() if v[0] <= 6.0}
    found = S.search(S.cut(df, "length", nodes, arcs), spark.createDataFrame([(255, 255), (0, 0)], "source long, node long"))
    ends = [(255, t) for t in range(0, 256, 23)] + [(0, t) for t in range(0, 256, 37)] + [(0, 777)]
    ways: dict = {}
    for r in found.ways(spark.createDataFrame(ends, "source long, target long")).collect():
        ways.setdefault((r.source, r.target), []).append((r.i, r.node))
    for s, t in ends:
        of, way = want[2 if s else 0], []
        while t is not None and t in of:
            way.append(t)
            t = of[t][2]
        assert [n for _, n in sorted(ways.get((s, way[0] if way else 777), []))] == way


def test_rounds_follow_parts_not_hops(spark):
    chain = spark.range(2000).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"), F.lit(1.0).alias("length"))
    nodes = spark.range(2001).select("id", F.col("id").cast("double").alias("x"), F.lit(0.0).alias("y"))
    with stages.scratch(spark) as left:
        out = N.distances(chain, spark.createDataFrame([(0, 0)], "source long, node long"), nodes=nodes, part_arcs=1000)
        assert out.agg(F.count("*"), F.max("d"), F.sum("d")).first() == (2001, 2000.0, 2000 * 2001 / 2)
        rounds = [p for p in left if "/entries-" in p]
        assert len(rounds) < 10
        # A round writes the entries that got better, not what is known: a chain has two or so at each border.
        assert sum(spark.read.parquet(p).count() for p in rounds) < 40


def test_weights_that_are_no_lengths(spark):
    edges = spark.createDataFrame([(1, 2, None), (2, 3, 1.0)], "u long, v long, length double")
    one = spark.createDataFrame([(0, 1)], "source long, node long")
    assert [tuple(r) for r in N.distances(edges, one).collect()] == [(0, 1, 0.0)]
    assert N.distances(edges.filter("false"), one).count() == 1 and N.distances(edges, one.filter("false")).count() == 0
    with pytest.raises(Exception, match="negative weight"):
        N.distances(spark.createDataFrame([(1, 2, -1.0)], "u long, v long, length double"), one).collect()
    both = spark.createDataFrame([(1, 2, 5.0), (2, 1, None), (4, 3, None)], "u long, v long, length double")
    assert sorted((r.u, r.v, r.length, r.parallel_edges) for r in N.merge_parallel(both).collect()) == [(1, 2, 5.0, 2), (3, 4, None, 1)]


def test_names_as_ids(spark):
    edges = spark.createDataFrame([("a", "b", 1.0), ("b", "ç", 1.0), ("a", "ß", 1.0), ("ß", "ç", 1.0)], "u string, v string, length double")
    out = N.distances(edges, spark.createDataFrame([("q", "a")], "source string, node string"), before=True, part_arcs=4).collect()
    assert sorted(tuple(r) for r in out) == [("q", "a", 0.0, None), ("q", "b", 1.0, "a"), ("q", "ß", 1.0, "a"), ("q", "ç", 2.0, "b")]


def test_scratch_is_of_its_thread(spark):
    import threading

    held, go, done = {}, threading.Event(), threading.Event()

    def other():
        with stages.scratch(spark):
            held["df"] = stages.materialize(spark.range(5), "other")
            go.set()
            done.wait(60)
            held["n"] = held["df"].count()

    t = threading.Thread(target=other)
    t.start()
    go.wait(60)
    with stages.scratch(spark):
        stages.materialize(spark.range(3), "own")
    done.set()
    t.join()
    assert held["n"] == 5


def test_ways_search_no_farther_than_needed(spark):
    n = 2000
    chain = spark.range(n).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"), F.lit(1.0).alias("length")).union(spark.createDataFrame([(9000, 9001, 1.0)], "u long, v long, length double"))
    nodes = chain.select(F.col("u").alias("id")).union(chain.select("v")).distinct().select("id", F.col("id").cast("double").alias("x"), F.lit(0.0).alias("y"))
    pairs = [(k, k + 3) for k in range(0, n - 100, 100)] + [(50, 80), (7, 7), (10, 9001)]
    roots = lambda left: left.filter("target < 9000")
    ends = spark.createDataFrame([(a, b, 4.0) for a, b in pairs], "source long, target long, reach double")
    with stages.scratch(spark) as left:
        steps = S.ways_between(S.cut(chain, "length", nodes, 250), ends, roots).collect()
        entries = sum(spark.read.parquet(p).count() for p in left if "/entries-" in p)
    found: dict = {}
    for r in steps:
        found.setdefault((r.source, r.target), []).append((r.i, r.node))
    assert {k: [x for _, x in sorted(v)] for k, v in found.items()} == {(a, b): list(range(b, a - 1, -1)) for a, b in pairs[:-1]}
    assert entries < 4 * len(pairs)  # whole searches would enter each of 16 parts from each source


def test_sources_cost_only_the_parts_they_enter(spark):
    chain = spark.range(2000).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"), F.lit(1.0).alias("length"))
    nodes = spark.range(2001).select("id", F.col("id").cast("double").alias("x"), F.lit(0.0).alias("y"))
    sources = spark.range(0, 2000, 10).select(F.col("id").alias("source"), F.col("id").alias("node"))
    with stages.scratch(spark) as left:
        out = N.distances(chain, sources, limit=4.0, nodes=nodes, part_arcs=500)
        assert out.count() == 200 * 9 - 4
        blocks = [spark.read.parquet(p).agg(F.sum("blocks")).first()[0] or 0 for p in left if "/blocks-" in p]
    assert 8 <= max(blocks) <= 10  # 25 sources in each of 8 parts, and a few from beside


def test_parts_of_a_long_strip_are_short(spark):
    """A strip of 8 x 500 nodes: parts lie along it one behind the other, so few arcs cross, not those of whole columns."""
    nodes = spark.range(4000).select("id", (F.col("id") % 8 * 100.0).alias("x"), (F.floor(F.col("id") / 8) * 100.0).alias("y"))
    ahead = nodes.select(F.col("id").alias("u"), (F.col("id") + 8).alias("v")).filter("v < 4000")
    beside = nodes.filter("id % 8 < 7").select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    parts = S.cut(ahead.union(beside).withColumn("length", F.lit(1.0)), nodes=nodes, part_arcs=1000)
    n = parts.inside.count()
    assert n > 8 and parts.across.count() < 40 * n
