"""Exact betweenness in a graph that is cut into parts.

For each source the arcs of shortest ways form an order of the nodes: an arc from u to v belongs to it if d(u) + w = d(v), up
to TIES, and u comes first by (d, hops). Along it numbers of ways are added up; against it goes how much each node lies on
ways. Inside a part one task does both for SOURCES_AT_ONCE sources; where ways cross to other parts, a node waits until all
that crosses to it has come, so rounds follow the parts that ways cross. A graph of one part has no rounds. Sums over sources
are made in tasks before they are shuffled; no task and not the driver holds more than a part.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.operators.search import HUB, PART_ARCS, Search, _Graph, cut, search, solved
from geoloom.plans.stages import materialize

#: Sources of a task; lengths that differ by less than this share are equal.
SOURCES_AT_ONCE, TIES = 64, 1e-9

_FACTS = "struct<source: {s}, node: {n}, ahead: long, ways: double, come: long, behind: long, share: double, gone: long>"


def tight(d: float, w: float, far: float) -> bool:
    return abs(d + w - far) <= TIES * max(1.0, abs(far))


class _Part:
    """One source's ways in a part."""

    def __init__(self, graph: _Graph, labels: list[tuple], facts: list[dict], source) -> None:  # noqa: ANN001
        best = graph.spread(labels, float("inf"))
        self.order = sorted(best, key=lambda i: best[i][:2])
        self.before: dict[int, list[int]] = {i: [] for i in best}
        for i in self.order:
            d, hops, _ = best[i]
            for j, w in graph.arcs(i):
                if j in best and (d, hops) < best[j][:2] and tight(d, w, best[j][0]):
                    self.before[j].append(i)
        self.facts = {i: f for f in facts if (i := graph.find(f["node"])) is not None}
        self.start = graph.find(source)

    def ways(self) -> dict[int, float]:
        """Numbers of shortest ways to the nodes that all their predecessors are known of."""
        out: dict[int, float] = {}
        for i in self.order:
            f = self.facts.get(i)
            if (f and f["come"] < f["ahead"]) or any(u not in out for u in self.before[i]):
                continue
            out[i] = (1.0 if i == self.start else 0.0) + (f["ways"] if f else 0.0) + sum(out[u] for u in self.before[i])
        return out

    def shares(self, ways: dict[int, float]) -> dict[int, float]:
        """How much ways from the source pass through the nodes that all successors are known of."""
        held, waits, out = dict.fromkeys(self.order, 0.0), set(), {}
        for i in reversed(self.order):
            f = self.facts.get(i)
            if i in waits or (f and f["gone"] < f["behind"]):
                waits.update(self.before[i])
                continue
            out[i] = ways[i] * (held[i] + (f["share"] if f else 0.0))
            for u in self.before[i]:
                held[u] += (1 + out[i]) / ways[i]
        return out


def betweenness(nodes: DataFrame, edges: DataFrame, weight: str = "length", part_arcs: int = PART_ARCS) -> DataFrame:
    """nodes (id, x, y) with betweenness, by weight and normalised by the pairs of other nodes."""
    parts = cut(edges, weight, nodes, part_arcs)
    found = search(parts, parts.of.select(F.col("node").alias("source"), "node"))
    blocks = max(1, -(-parts.of.count() // SOURCES_AT_ONCE))
    node = dict(parts.of.dtypes)["node"]
    facts_type = f"array<{_FACTS.format(s=node, n=node)}>"
    labels = materialize(_grouped(blocks, found.entries, "labels", "node", "d", "hops", "before"), "labels")

    def worked(facts: DataFrame | None, schema: str, mode: str) -> DataFrame:
        rows = labels
        if facts is None:
            rows = rows.withColumn("facts", F.array().cast(facts_type))
        else:
            rows = rows.join(_grouped(blocks, facts, "facts", "node", "ahead", "ways", "come", "behind", "share", "gone"), ["part", "block"], "left")

        def solve(graph: _Graph, by_source: dict, row: dict) -> Iterator[tuple]:
            given: dict = {}
            for f in row["facts"] or ():
                given.setdefault(f["source"], []).append(f)
            total: dict = {}
            for s, own in by_source.items():
                part = _Part(graph, own, given.get(s, []), s)
                ways = part.ways()
                if mode == "ways":
                    yield from ((s, graph.name(i), ways[i]) for i in part.facts if i in ways)
                    continue
                shares = part.shares(ways)
                if mode == "shares":
                    yield from ((s, graph.name(i), (1 + shares[i]) / ways[i]) for i in part.facts if i in shares)
                    continue
                for i, x in shares.items():
                    if i != part.start:
                        total[graph.name(i)] = total.get(graph.name(i), 0.0) + x
            yield from total.items()

        return solved(rows.join(parts.inside, "part", "left"), schema, solve)

    facts = None
    if parts.crossed:
        facts = _crossings(found, parts, worked, node)
    total = worked(facts, f"node {node}, x double", "total").groupBy(F.col("node").alias("__node")).agg(F.sum("x").alias("__x"))
    n = nodes.count()
    scale = 1.0 / ((n - 1) * (n - 2)) if n > 2 else 0.0
    out = nodes.join(total, nodes["id"] == total["__node"], "left")
    return out.select(*[nodes[c] for c in nodes.columns if c != "betweenness"], (F.coalesce("__x", F.lit(0.0)) * scale).alias("betweenness"))


def _grouped(blocks: int, rows: DataFrame, name: str, *columns: str) -> DataFrame:
    """(part, block, name); nodes whose arcs all cross make parts without arcs."""
    block = F.pmod(F.xxhash64("source"), F.lit(blocks)).alias("block")
    return rows.groupBy("part", block).agg(F.collect_list(F.struct("source", *columns)).alias(name))


def _crossings(found: Search, parts, worked, node: str) -> DataFrame:  # noqa: ANN001
    """(source, part, node, ahead, ways, come, behind, share, gone): of each node at a border, how many arcs of shortest ways
    cross to and from it, and what comes over them.
    """
    at = materialize(found.exits(found.entries).groupBy("source", "node").agg(F.min(F.struct("d", "hops")).alias("b")).select("source", "node", "b.*"), "borders")
    u, v = (at.select("source", F.col("node").alias(e), F.col("d").alias(f"d{e}"), F.col("hops").alias(f"h{e}")) for e in "uv")
    arcs = u.join(parts.across, "u").join(v, ["source", "v"])
    equal = F.abs(F.col("du") + F.col("w") - F.col("dv")) <= TIES * F.greatest(F.lit(1.0), F.abs("dv"))
    arcs = materialize(arcs.filter(equal & (F.struct("du", "hu") < F.struct("dv", "hv"))).select("source", "u", "v"), "crossings")
    count = lambda end, name: arcs.groupBy("source", F.col(end).alias("node")).agg(F.count("*").alias(name))
    needs = count("v", "ahead").join(count("u", "behind"), ["source", "node"], "full").join(parts.of, "node", "left")
    needs = materialize(needs.select("source", F.coalesce("part", F.lit(HUB).cast("long")).alias("part"), "node", F.coalesce("ahead", F.lit(0).cast("long")).alias("ahead"), F.coalesce("behind", F.lit(0).cast("long")).alias("behind")), "needs")
    none = lambda a, b: needs.select("source", "node", F.lit(0.0).alias(a), F.lit(0).cast("long").alias(b))
    known = {"ways": none("ways", "come"), "share": none("share", "gone")}
    all_ = lambda: needs.join(known["ways"], ["source", "node"]).join(known["share"], ["source", "node"])
    for what, number, mode, end, other in (("ways", "come", "ways", "u", "v"), ("share", "gone", "shares", "v", "u")):
        sent = None
        while True:
            out = worked(all_(), f"source {node}, node {node}, x double", mode)
            out = out if sent is None else out.join(sent, ["source", "node"], "left_anti")
            out = materialize(out, "solved")
            if out.isEmpty():
                break
            sent = out.select("source", "node") if sent is None else materialize(sent.union(out.select("source", "node")), "sent")
            come = arcs.join(out.withColumnRenamed("node", end), ["source", end]).groupBy("source", F.col(other).alias("node")).agg(F.sum("x").alias("x"), F.count("*").alias("k"))
            old = known[what].join(come, ["source", "node"], "left")
            known[what] = materialize(old.select("source", "node", (F.col(what) + F.coalesce("x", F.lit(0.0))).alias(what), (F.col(number) + F.coalesce("k", F.lit(0))).alias(number)), "come")
    return materialize(all_(), "facts")
