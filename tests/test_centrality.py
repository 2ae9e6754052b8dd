"""Betweenness, bridges and articulation points against brute force, in one part and in many."""

import heapq
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from geoloom.operators import biconnected as B
from geoloom.operators import network as N


def ways_through(edges, n):
    """Betweenness by counting: for each pair the share of shortest ways through each node, in whole numbers."""
    graph = {}
    for u, v, w in edges:
        graph.setdefault(u, []).append((v, w))
        graph.setdefault(v, []).append((u, w))
    dist, count = {}, {}
    for s in graph:
        d, heap = {s: 0}, [(0, s)]
        while heap:
            x, u = heapq.heappop(heap)
            if x == d[u]:
                for v, w in graph[u]:
                    if v not in d or x + w < d[v]:
                        d[v] = x + w
                        heapq.heappush(heap, (x + w, v))
        k = {s: 1}
        for u in sorted(d, key=d.get):
            if u != s:
                k[u] = sum(k[v] for v, w in graph[u] if d[v] + w == d[u])
        dist[s], count[s] = d, k
    out = dict.fromkeys(range(n), Fraction(0))
    for s in graph:
        for t in dist[s]:
            for v in dist[s]:
                if v not in (s, t) and s != t and dist[s][v] + dist[v][t] == dist[s][t]:
                    out[v] += Fraction(count[s][v] * count[v][t], count[s][t])
    return {v: float(x / ((n - 1) * (n - 2))) for v, x in out.items()}


def pieces(edges, nodes, edge=None, node=None):
    graph = {x: [] for x in nodes if x != node}
    for u, v in edges:
        if (u, v) != edge and node not in (u, v):
            graph[u].append(v)
            graph[v].append(u)
    seen, n = set(), 0
    for x in graph:
        n += x not in seen
        todo = [x]
        while todo:
            y = todo.pop()
            if y not in seen:
                seen.add(y)
                todo += graph[y]
    return n


def made(seed, n, m):
    rng = random.Random(seed)
    pairs = sorted({tuple(sorted(rng.sample(range(n), 2))) for _ in range(m)})
    return [(u, v, rng.choice([1, 1, 2, 3])) for u, v in pairs]


@pytest.mark.parametrize("part_arcs", [10**6, 30])
def test_centrality_equals_brute_force(spark, part_arcs):
    n = 30
    edges = made(4, n, 40) + [(0, k, 2) for k in range(20, 26)]
    edges = list({(u, v): (u, v, w) for u, v, w in edges}.values())
    nodes = spark.createDataFrame([(i, float(i % 6), float(i // 6)) for i in range(n)], "id long, x double, y double")
    scored, marked = N.centrality(nodes, spark.createDataFrame([(u, v, float(w)) for u, v, w in edges], "u long, v long, length double"), part_arcs)
    plain = [(u, v) for u, v, _ in edges]
    used = {x for e in plain for x in e}
    base, want = pieces(plain, used), ways_through(edges, n)
    got = {r.id: r for r in scored.collect()}
    assert {i: r.betweenness for i, r in got.items()} == pytest.approx(want, abs=1e-12)
    assert {i for i, r in got.items() if r.is_articulation_point} == {x for x in used if pieces(plain, used, node=x) > base}
    assert {(r.u, r.v) for r in marked.collect() if r.is_bridge} == {e for e in plain if pieces(plain, used, edge=e) > base}


def test_bridges_in_rounds(spark):
    """A long chain with a ring at its end, a star and a lone edge, in many parts."""
    chain = [(i, i + 1) for i in range(300)] + [(300, 305), (305, 306), (306, 300)]
    star = [(400, k) for k in range(401, 440)]
    edges = [*chain, *star, (500, 501)]
    bridges, points = B.bridges_and_points(spark.createDataFrame([*edges, (7, 7), (1, 0)], "u long, v long"), part_arcs=80)
    assert {tuple(r) for r in bridges.collect()} == {*chain[:300], *star, (500, 501)}
    assert {r.id for r in points.collect()} == {*range(1, 301), 400}


def test_centrality_awkward(spark):
    nodes = spark.createDataFrame([("a", 0.0, 0.0), ("b", 1.0, 0.0), ("c", None, None), ("d", 9.0, 9.0)], "id string, x double, y double").withColumns({"node": F.lit(1), "betweenness": F.lit("x")})
    edges = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0), ("c", "d", None)], "u string, v string, length double")
    scored, marked = N.centrality(nodes, edges)
    assert sorted((r.id, r.betweenness, r.is_articulation_point) for r in scored.collect()) == [("a", 0.0, False), ("b", 1 / 3, True), ("c", 0.0, True), ("d", 0.0, False)]
    assert marked.filter("is_bridge").count() == 3
    scored, marked = N.centrality(nodes, edges.filter("false"))
    assert (scored.filter("betweenness = 0").count(), marked.count()) == (4, 0)
