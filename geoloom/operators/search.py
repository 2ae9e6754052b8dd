"""Shortest ways in a graph that is cut into parts.

Nodes are cut into parts of about PART_ARCS arcs that lie together (by place along a Z-curve, or by id where nodes have no
place). A part is one row of arrays. A search goes in rounds: inside a part, one task runs Dijkstra's algorithm for up to
SOURCES sources from the nodes that were entered with a better label; only labels of nodes with arcs to other parts come
out, cross these arcs, and are the next round's entries where they are better than what is known. So rounds follow the
number of parts that ways cross, not their hops, and a round writes entries only. When no entry changes, one pass over
the parts that were entered gives the labels of all their nodes; ways are walked back part by part.

A label is (d, hops, before) and the least one wins: of equally short ways the one with fewest hops, then the smaller id
ahead. So ways never go round in circles on arcs of weight 0, and the cut plays no part in the result.

A node with more than half of PART_ARCS arcs is in no part; all its arcs cross, and a join takes them, however many.
Arcs with a null or non-finite weight can't be travelled; a negative weight is an error.
"""

from __future__ import annotations

import bisect
import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.plans.stages import materialize

PART_ARCS = 100_000
#: Sources that are searched for in a part at once, about, and blocks of them that are tasks of their own.
SOURCES, TASKS = 32, 1000
#: Rows that a search gives out at once.
ROWS = 50_000
#: Rounds whose entries are read side by side before they are merged.
GENERATIONS = 12
#: Part of the nodes whose arcs all cross.
HUB = -1


def arcs_of(edges: DataFrame, weight: str = "length") -> DataFrame:
    """(u, v, w): both ways of the edges that can be travelled."""
    w = F.col(weight).cast("double")
    e = edges.filter(w.isNotNull() & ~F.isnan(w) & (F.abs(w) < float("inf")) & (F.col("u") != F.col("v")))
    e = e.select("u", "v", F.when(w < 0, F.raise_error(F.lit("an edge has a negative weight"))).otherwise(w).alias("w"))
    return e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v"), "w"))


def z_order(x: Column, y: Column, box: tuple[float, float, float, float], bits: int = 20) -> Column:
    """The place of (x, y) on a Z-curve through box (x0, y0, x1, y1), in squares: what lies together in a long box has
    short borders too."""
    side = max(box[2] - box[0], box[3] - box[1], 1e-300)

    def steps(v: Column, low: float) -> Column:
        cell = F.floor((v - low) / side * ((1 << bits) - 1)).cast("long")
        out = F.coalesce(F.greatest(F.lit(0), F.least(cell, F.lit((1 << bits) - 1))), F.lit(0)).cast("long")
        for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
            out = out.bitwiseOR(F.shiftleft(out, shift)).bitwiseAND(F.lit(mask))
        return out

    return steps(x, box[0]).bitwiseOR(F.shiftleft(steps(y, box[1]), 1))


@dataclass
class Parts:
    """inside: (part, ids, offsets, targets, weights, exits); across: (u, v, w, pv); of: (node, part). All are written."""

    inside: DataFrame
    across: DataFrame
    of: DataFrame
    crossed: bool


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arcs and exits of a part as arrays over its sorted ids, one part at a time."""
    for b in batches:
        kind = b.schema.field("exits").type.value_type
        column = lambda v: v.to_numpy(zero_copy_only=False)
        for k in range(b.num_rows):
            arcs, exits = (b.column(c)[k].values for c in ("arcs", "exits"))
            u, v, w = (column(arcs.field(c)) for c in ("u", "v", "w")) if arcs is not None else (column(pa.array([], t)) for t in (kind, kind, pa.float64()))
            out = column(exits if exits is not None else pa.array([], kind))
            ids = np.unique(np.concatenate([u, v, out]))
            i, j = np.searchsorted(ids, u), np.searchsorted(ids, v)
            order = np.lexsort((w, j, i))
            offsets = np.concatenate([[0], np.cumsum(np.bincount(i, minlength=len(ids)))])
            lists = [(ids, kind), (offsets, pa.int32()), (j[order], pa.int32()), (w[order], pa.float64()), (np.searchsorted(ids, np.sort(out)), pa.int32())]
            held = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, t)) for x, t in lists]
            yield pa.RecordBatch.from_arrays([b.column("part").slice(k, 1), *held], ["part", "ids", "offsets", "targets", "weights", "exits"])


def cut(edges: DataFrame, weight: str = "length", nodes: DataFrame | None = None, part_arcs: int = PART_ARCS) -> Parts:
    """The parts of the graph; nodes (id, x, y) say what lies together."""
    arcs = materialize(arcs_of(edges, weight), "arcs")
    count = -(-arcs.count() // part_arcs)
    if count <= 1:
        of = materialize(arcs.select(F.col("u").alias("node")).distinct().withColumn("part", F.lit(0).cast("long")), "parts")
        split = arcs.withColumns({"pu": F.lit(0).cast("long"), "pv": F.lit(0).cast("long")})
    else:
        ends, order = arcs.select("u"), ["u"]
        if nodes is not None:
            box = nodes.agg(F.min("x"), F.min("y"), F.max("x"), F.max("y")).first()
            at = nodes.select(F.col("id").alias("u"), z_order(F.col("x"), F.col("y"), tuple(v or 0.0 for v in box)).alias("z"))
            ends, order = ends.join(at.dropDuplicates(["u"]), "u", "left"), ["z", "u"]
        # A row for each arc, so that ranges have about as many arcs each; a node's rows are all in one.
        ranges = ends.repartitionByRange(count, *order).select("u", F.spark_partition_id().cast("long").alias("part"))
        of = ranges.groupBy("u").agg(F.min("part").alias("part"), F.count("*").alias("n"))
        of = materialize(of.select(F.col("u").alias("node"), F.when(F.col("n") > part_arcs / 2, F.lit(HUB)).otherwise(F.col("part")).alias("part")), "parts")
        end = lambda c, p: of.select(F.col("node").alias(c), F.col("part").alias(p))
        split = materialize(arcs.join(end("u", "pu"), "u").join(end("v", "pv"), "v"), "split")
    inner = (F.col("pu") == F.col("pv")) & (F.col("pu") != HUB)
    across = split.filter(~inner).select("u", "v", "w", "pv", "pu")
    held = split.filter(inner).groupBy(F.col("pu").alias("part")).agg(F.collect_list(F.struct("u", "v", "w")).alias("arcs"))
    exits = across.filter(F.col("pu") != HUB).groupBy(F.col("pu").alias("part")).agg(F.collect_set("u").alias("exits"))
    kind = dict(arcs.dtypes)["u"]
    inside = held.join(exits, "part", "full").mapInArrow(_pack, f"part long, ids array<{kind}>, offsets array<int>, targets array<int>, weights array<double>, exits array<int>")
    return Parts(materialize(inside, "inside"), across.drop("pu"), of, count > 1)


class _Graph:
    """A part's arrays, of which only what a search meets becomes lists, and Dijkstra's algorithm on them."""

    def __init__(self, ids: pa.Array, offsets: pa.Array, targets: pa.Array, weights: pa.Array) -> None:
        self.whole = pa.types.is_integer(ids.type)
        self.ids = ids.to_numpy() if self.whole else ids.to_pylist()
        self.offsets, self.targets, self.weights = offsets.to_numpy(), targets.to_numpy(), weights.to_numpy()
        self.size, self.more = len(self.ids), []  # more: nodes without an arc inside the part
        self.places: dict = {}
        self.held: dict[int, list] = {}

    def find(self, node) -> int | None:  # noqa: ANN001
        """The node's number, if it is one of the part's."""
        i = self.places.get(node)
        if i is None and node is not None:
            k = bisect.bisect_left(self.ids, node)
            if k < self.size and self.ids[k] == node:
                i = self.places[node] = k
        return i

    def name(self, i: int):  # noqa: ANN201
        if i >= self.size:
            return self.more[i - self.size]
        return self.ids[i].item() if self.whole else self.ids[i]

    def arcs(self, i: int) -> list[tuple[int, float]]:
        out = self.held.get(i)
        if out is None:
            a, b = (self.offsets[i], self.offsets[i + 1]) if i < self.size else (0, 0)
            out = self.held[i] = list(zip(self.targets[a:b].tolist(), self.weights[a:b].tolist(), strict=True))
        return out

    def spread(self, labels: list[tuple], most: float) -> dict[int, tuple]:
        """node: (d, hops, before), from labels (node id, d, hops, before), as far as most."""
        best: dict[int, tuple] = {}
        for node, d, hops, before in labels:
            i = self.find(node)
            if i is None:
                i = self.places[node] = self.size + len(self.more)
                self.more.append(node)
            if i not in best or (d, hops, before) < best[i]:
                best[i] = (d, hops, before)
        heap = [(d, hops, i) for i, (d, hops, _) in best.items()]
        heapq.heapify(heap)
        while heap:
            d, hops, i = heapq.heappop(heap)
            if best[i][:2] != (d, hops):
                continue
            here = self.name(i)
            for j, w in self.arcs(i):
                far = d + w
                if far > most:
                    continue
                old = best.get(j)
                if old is None or (far, hops + 1) < old[:2]:
                    best[j] = (far, hops + 1, here)
                    heapq.heappush(heap, (far, hops + 1, j))
                elif (far, hops + 1) == old[:2] and here < old[2]:
                    best[j] = (far, hops + 1, here)
        return best


def _each(batches: Iterator[pa.RecordBatch], schema: pa.Schema, solve: Callable[[_Graph, dict, dict], Iterator[tuple]]) -> Iterator[pa.RecordBatch]:
    """Rows of solve(graph, labels by source, row) for each row of parts with labels, ROWS at once."""
    arrays = {"ids": None, "offsets": pa.int32(), "targets": pa.int32(), "weights": pa.float64()}
    for b in batches:
        for k in range(b.num_rows):
            row = {c: b.column(c)[k].as_py() for c in b.schema.names if c not in arrays}
            of = {c: b.column(c)[k].values for c in arrays}
            graph = _Graph(*(pa.array([], t or b.schema.field(c).type.value_type) if of[c] is None else of[c] for c, t in arrays.items()))
            by_source: dict = {}
            for x in row["labels"]:
                by_source.setdefault(x["source"], []).append((x["node"], x["d"], x["hops"], x["before"]))
            row["most"] = {x["source"]: x.get("most") for x in row.pop("labels")}
            out = solve(graph, by_source, row)
            while some := list(islice(out, ROWS)):
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*some, strict=True), schema, strict=True)], schema=schema)


def solved(rows: DataFrame, schema: str, solve: Callable[[_Graph, dict, dict], Iterator[tuple]]) -> DataFrame:
    """What solve(graph, labels by source, row) gives for rows with a part's arrays and its labels."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))
    return rows.mapInArrow(lambda batches: _each(batches, arrow, solve), schema)


@dataclass
class Search:
    """The entries (source, part, node, d, hops, before, most) of parts; the sources' own nodes are entries as well. No way of a
    source is longer than its most.

    Each part's sources make blocks of about SOURCES, so that a source costs the parts that it enters, wherever others are.
    """

    parts: Parts
    entries: DataFrame

    @staticmethod
    def _blocks(labels: DataFrame) -> tuple[DataFrame, int]:
        """(part, blocks) of the parts that have labels, and how many blocks there are."""
        n = F.ceil(F.count_distinct("source") / SOURCES).cast("int")
        out = materialize(labels.filter(F.col("part") != HUB).groupBy("part").agg(n.alias("blocks")), "blocks")
        return out, out.agg(F.sum("blocks")).first()[0] or 0

    @staticmethod
    def _grouped(rows: DataFrame, blocks: DataFrame, name: str, *columns: str) -> DataFrame:
        """(part, block, name): rows as lists."""
        block = F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int").alias("block")
        return rows.join(F.broadcast(blocks), "part").groupBy("part", block).agg(F.collect_list(F.struct("source", *columns)).alias(name))

    def _run(self, labels: DataFrame, schema: str, solve: Callable[[_Graph, dict, dict], Iterator[tuple]], asked: DataFrame | None = None) -> DataFrame:
        """solve() on each block of labels, with the rows asked of its sources: only blocks that have some."""
        blocks, n = self._blocks(labels)
        rows = self._grouped(labels, blocks, "labels", "node", "d", "hops", "before", "most")
        if asked is not None:
            rows = rows.join(self._grouped(asked, blocks, "asked", "target", "node", "i"), ["part", "block"])
        # Few bytes mean much work, so partitions are as many as blocks, which no one merges.
        spread = lambda df: df.repartition(max(1, min(n, TASKS)), "part", "block")
        held = self.parts.inside.join(F.broadcast(blocks), "part").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
        return solved(spread(rows).join(spread(held), ["part", "block"], "left"), schema, solve)

    def _kinds(self) -> tuple[str, str]:
        kinds = dict(self.entries.dtypes)
        return kinds["source"], kinds["node"]

    def exits(self, labels: DataFrame) -> DataFrame:
        """(source, node, d, hops, most): nodes with arcs to other parts, as these labels reach them."""
        source, node = self._kinds()

        def solve(graph: _Graph, by_source: dict, row: dict) -> Iterator[tuple]:
            for s, own in by_source.items():
                most = row["most"][s]
                best = graph.spread(own, most)
                yield from ((s, graph.name(i), *best[i][:2], most) for i in row["exits"] or () if i in best)

        inside = self._run(labels, f"source {source}, node {node}, d double, hops long, most double", solve)
        return inside.union(labels.filter(F.col("part") == HUB).select("source", "node", "d", "hops", "most"))

    def labels(self) -> DataFrame:
        """(source, node, d, hops, before) of all nodes that are reached."""
        source, node = self._kinds()

        def solve(graph: _Graph, by_source: dict, row: dict) -> Iterator[tuple]:
            for s, own in by_source.items():
                yield from ((s, graph.name(i), *label) for i, label in graph.spread(own, row["most"][s]).items())

        inside = self._run(self.entries, f"source {source}, node {node}, d double, hops long, before {node}", solve)
        return inside.union(self.entries.filter(F.col("part") == HUB).select("source", "node", "d", "hops", "before"))

    def ways(self, ends: DataFrame) -> DataFrame:
        """(source, target, node, i): the nodes of the way from source to target for each of ends (source, target) that can
        be reached; i counts steps before the target.
        """
        source, node = self._kinds()
        found = f"source {source}, target {node}, node {node}, i long, next {node}"

        def solve(graph: _Graph, by_source: dict, row: dict) -> Iterator[tuple]:
            asked: dict = {}
            for x in row["asked"]:
                asked.setdefault(x["source"], []).append((x["target"], x["node"], x["i"]))
            for s, ways in asked.items():
                best = graph.spread(by_source[s], row["most"][s]) if s in by_source else {}
                for target, at, i in ways:
                    k = graph.find(at)
                    while k in best:
                        before = best[k][2]
                        inner = graph.find(before)  # ids of other parts are not among this part's
                        yield s, target, graph.name(k), i, None if inner is not None else before
                        k, i = inner, i + 1

        open_ = materialize(ends.select("source", "target", F.col("target").alias("node"), F.lit(0).cast("long").alias("i")), "asked")
        out = []
        while not open_.isEmpty():
            at = open_.join(self.parts.of, "node", "left").withColumn("part", F.coalesce("part", F.lit(HUB).cast("long")))
            met = self._run(self.entries.join(at.select("source", "part").distinct(), ["source", "part"]), found, solve, at.filter(F.col("part") != HUB))
            hubs = self.entries.filter(F.col("part") == HUB).select("source", "node", F.col("before").alias("next"))
            steps = met.union(at.filter(F.col("part") == HUB).join(hubs, ["source", "node"]).select("source", "target", "node", "i", "next"))
            out.append(materialize(steps, "steps"))
            open_ = out[-1].filter("next IS NOT NULL").select("source", "target", F.col("next").alias("node"), (F.col("i") + 1).alias("i"))
        return reduce(DataFrame.union, [x.select("source", "target", "node", "i") for x in out]) if out else open_


def search(parts: Parts, sources: DataFrame, limit: float | None = None) -> Search:
    """Searches from each source (source, node) within the limit; a source may have several nodes, and a column most of
    sources is its own limit.
    """
    kind = dict(parts.of.dtypes)["node"]
    most = F.col("most") if "most" in sources.columns else F.lit(float("inf") if limit is None else float(limit))
    first = sources.select("source", F.col("node").cast(kind).alias("node"), most.alias("most")).filter("node IS NOT NULL").distinct()
    first = first.join(parts.of, "node", "left").select("source", F.coalesce("part", F.lit(HUB).cast("long")).alias("part"), "node", F.lit(0.0).alias("d"), F.lit(0).cast("long").alias("hops"), F.lit(None).cast(kind).alias("before"), "most")
    fresh = materialize(first, "entries")
    known = [fresh]
    least = lambda rows: rows.groupBy("source", "node").agg(F.min(F.struct("d", "hops", "before")).alias("b"), F.any_value("part").alias("part"), F.any_value("most").alias("most")).select("source", "part", "node", "b.*", "most")
    all_ = lambda: least(reduce(DataFrame.union, known)) if len(known) > 1 else known[0]
    while parts.crossed:
        out = Search(parts, fresh).exits(fresh).join(parts.across.withColumnRenamed("u", "node"), "node")
        out = out.select("source", F.col("pv").alias("part"), F.col("v").alias("node"), (F.col("d") + F.col("w")).alias("d"), (F.col("hops") + 1).alias("hops"), F.col("node").alias("before"), "most")
        old = all_().select("source", "node", F.struct("d", "hops", "before").alias("was"))
        better = least(out.filter(F.col("d") <= F.col("most"))).join(old, ["source", "node"], "left").filter(F.col("was").isNull() | (F.struct("d", "hops", "before") < F.col("was")))
        fresh = materialize(better.drop("was").select("source", "part", "node", "d", "hops", "before", "most"), "entries")
        if fresh.isEmpty():
            break
        known.append(fresh)
        if len(known) > GENERATIONS:
            known = [materialize(all_(), "entries")]
    return Search(parts, all_() if len(known) == 1 else materialize(all_(), "entries"))


def ways_between(parts: Parts, ends: DataFrame, reachable: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Search.ways() of ends (source, target, reach), each source searched no farther than it needs.

    A search goes as far as the greatest reach of its source's targets, a guess; for those that it doesn't meet, twice as
    far, and so on. A label within that distance is final, so guesses change the work only. reachable() leaves the ends that have
    a way; it is asked once, when the second search leaves some open.
    """
    open_, out, tried = materialize(ends, "ends"), [], 0
    while not open_.isEmpty():
        sources = open_.groupBy("source").agg(F.max("reach").alias("most")).select("source", F.col("source").alias("node"), "most")
        out.append(materialize(search(parts, sources).ways(open_), "ways"))
        met, tried = out[-1].filter("i = 0").select("source", "target"), tried + 1
        left = open_.join(met, ["source", "target"], "left_anti").withColumn("reach", F.col("reach") * 2)
        open_ = materialize(reachable(left) if tried == 2 else left, "ends")
    return reduce(DataFrame.union, out) if out else search(parts, ends.select("source", F.col("source").alias("node"))).ways(ends)
