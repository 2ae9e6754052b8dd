"""Bridges and articulation points by rounds of joins, without the graph in any one place.

A spanning forest comes from searches (the fewest hops from each component's smallest node). Numbers of its nodes are made by
doubling: each round joins every node with the node twice as far up, so a tree of depth h takes about log2(h) rounds. First
the sizes of subtrees, then preorder numbers, then the least and greatest number that a subtree's other edges lead to. An
edge of the forest is a bridge if no other edge leaves the subtree below it. For articulation points edges of the forest
are grouped: those that a cycle goes through are linked, and the components of these links are the blocks of the graph; a
node whose edges are in several blocks is an articulation point.

A graph that is one part of a search is small enough for a task, which goes through it depth first instead.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from geoloom.operators.search import PART_ARCS, cut, search
from geoloom.plans.stages import components, materialize

#: Groups of a node's children whose sizes are summed apart, so that a node may have any number of them.
SALTS = 256


def forest(edges: DataFrame, nodes: DataFrame | None = None, part_arcs: int = PART_ARCS) -> DataFrame:
    """(root, node, up): each node of edges (u, v) with the node ahead of it towards its component's smallest node."""
    roots = materialize(components(edges.select(F.col("u").alias("a"), F.col("v").alias("b"))), "roots")
    starts = roots.filter("node = root").select(F.col("root").alias("source"), "node")
    found = search(cut(edges.withColumn("one", F.lit(1.0)), "one", nodes, part_arcs), starts).labels()
    return materialize(found.select(F.col("source").alias("root"), "node", F.col("before").alias("up")), "forest")


def _above(tree: DataFrame) -> DataFrame:
    return tree.filter("up IS NOT NULL").select("node", "up")


def _twice(above: DataFrame) -> DataFrame:
    """(node, up) twice as far."""
    return materialize(above.select("node", F.col("up").alias("mid")).join(above.select(F.col("node").alias("mid"), "up"), "mid").select("node", "up"), "above")


def of_subtrees(tree: DataFrame, values: DataFrame, gather: dict[str, Callable[[str], Column]], merge: dict[str, Callable[[Column, Column], Column]]) -> DataFrame:
    """values (node, ...) gathered over each node's subtree.

    After k rounds a node's value is that of its descendants less than 2**k below it; each passes what it has to the node
    2**k above.
    """
    above = _above(tree)
    while not above.isEmpty():
        sent = values.join(above, "node").groupBy(F.col("up").alias("node")).agg(*[f(c).alias(f"{c}__") for c, f in gather.items()])
        values = materialize(values.join(sent, "node", "left").select("node", *[merge[c](F.col(c), F.col(f"{c}__")).alias(c) for c in gather]), "subtrees")
        above = _twice(above)
    return values


def along_ways(tree: DataFrame, values: DataFrame) -> DataFrame:
    """(node, n): the sums of values (node, n) over each node and all above it."""
    above = _above(tree)
    while not above.isEmpty():
        up = above.join(values.select(F.col("node").alias("up"), F.col("n").alias("more")), "up").select("node", "more")
        values = materialize(values.join(up, "node", "left").select("node", (F.col("n") + F.coalesce("more", F.lit(0))).alias("n")), "ways")
        above = _twice(above)
    return values


def _plus(a: Column, b: Column) -> Column:
    return a + F.coalesce(b, F.lit(0))


def numbered(tree: DataFrame) -> DataFrame:
    """(root, node, up, pre, size): preorder numbers in each tree, from 0, and sizes of subtrees."""
    sizes = of_subtrees(tree, tree.select("node", F.lit(1).cast("long").alias("size")), {"size": F.sum}, {"size": _plus})
    own = materialize(tree.join(sizes, "node"), "sizes")
    # Where a child's numbers start after its parent's: behind all children before it, by groups and within each.
    child = own.filter("up IS NOT NULL").withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)))
    groups = child.groupBy("up", "salt").agg(F.sum("size").alias("all"))
    groups = groups.select("up", "salt", (F.sum("all").over(Window.partitionBy("up").orderBy("salt")) - F.col("all")).alias("ahead"))
    within = F.sum("size").over(Window.partitionBy("up", "salt").orderBy("node")) - F.col("size")
    steps = child.withColumn("within", within).join(groups, ["up", "salt"]).select("node", (F.col("ahead") + F.col("within") + 1).alias("n"))
    steps = steps.union(own.filter("up IS NULL").select("node", F.lit(0).cast("long").alias("n")))
    pre = along_ways(tree, materialize(steps, "steps"))
    return materialize(own.join(pre.withColumnRenamed("n", "pre"), "node").select("root", "node", "up", "pre", "size"), "numbered")


def bridges_and_points(edges: DataFrame, nodes: DataFrame | None = None, part_arcs: int = PART_ARCS) -> tuple[DataFrame, DataFrame]:
    """(bridges (u, v) with u < v, articulation points (id)) of undirected edges (u, v); loops and repeats don't count."""
    plain = edges.filter("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    plain = materialize(plain, "plain")
    tree = numbered(forest(plain, nodes, part_arcs))
    of_tree = tree.filter("up IS NOT NULL").select(F.least("node", "up").alias("u"), F.greatest("node", "up").alias("v"))
    others = materialize(plain.join(of_tree, ["u", "v"], "left_anti"), "others")
    at = lambda end, *cols: tree.select(F.col("node").alias(end), *[F.col(c).alias(f"{end}_{c}") for c in cols])
    both = others.select("u", "v").union(others.select(F.col("v").alias("u"), F.col("u").alias("v")))
    reach = both.join(at("v", "pre"), "v").groupBy(F.col("u").alias("node")).agg(F.min("v_pre").alias("low"), F.max("v_pre").alias("high"))
    first = tree.select("node", "pre").join(reach, "node", "left").select("node", F.least("pre", "low").alias("low"), F.greatest("pre", "high").alias("high"))
    ends = of_subtrees(tree, first, {"low": F.min, "high": F.max}, {"low": F.least, "high": F.greatest})
    all_ = materialize(tree.join(ends, "node"), "reach")
    below = all_.filter("up IS NOT NULL")
    bridge = below.filter("low >= pre AND high < pre + size").select(F.least("node", "up").alias("u"), F.greatest("node", "up").alias("v"))
    # An edge of the forest is named by its lower node. Its cycle goes on through the edge above, or through another edge.
    up = all_.select(F.col("node").alias("up"), F.col("pre").alias("up_pre"), F.col("size").alias("up_size"), F.col("up").alias("upper"))
    on = below.join(up, "up").filter("upper IS NOT NULL AND (low < up_pre OR high >= up_pre + up_size)").select(F.col("node").alias("a"), F.col("up").alias("b"))
    met = others.join(at("u", "pre", "size"), "u").join(at("v", "pre", "size"), "v")
    apart = met.filter("v_pre >= u_pre + u_size OR u_pre >= v_pre + v_size").select(F.col("u").alias("a"), F.col("v").alias("b"))
    blocks = components(on.union(apart))
    named = below.select("node", "up").join(blocks, "node", "left").withColumn("block", F.coalesce("root", "node"))
    touched = named.select(F.col("node").alias("id"), "block").union(named.select(F.col("up").alias("id"), "block"))
    points = touched.groupBy("id").agg(F.min("block").alias("first"), F.max("block").alias("last")).filter("first <> last").select("id")
    return materialize(bridge, "bridges"), materialize(points, "points")


def depth_first(offsets: list[int], targets: list[int]) -> tuple[list[tuple[int, int]], list[int]]:
    """(bridges, articulation points) of a graph without loops; parallel arcs count once."""
    seen, low, bridges, points = {}, {}, [], set()
    for root in range(len(offsets) - 1):
        if root in seen:
            continue
        seen[root] = low[root] = len(seen)
        stack, children = [(root, -1, iter(targets[offsets[root] : offsets[root + 1]]))], 0
        while stack:
            u, parent, rest = stack[-1]
            for v in rest:
                if v == parent:
                    continue
                if v in seen:
                    low[u] = min(low[u], seen[v])
                    continue
                seen[v] = low[v] = len(seen)
                children += u == root
                stack.append((v, u, iter(targets[offsets[v] : offsets[v + 1]])))
                break
            else:
                stack.pop()
                if parent >= 0:
                    low[parent] = min(low[parent], low[u])
                    if low[u] > seen[parent]:
                        bridges.append((min(u, parent), max(u, parent)))
                    if parent != root and low[u] >= seen[parent]:
                        points.add(parent)
        if children > 1:
            points.add(root)
    return bridges, sorted(points)


def cut_points(edges: DataFrame, nodes: DataFrame | None = None, part_arcs: int = PART_ARCS) -> tuple[DataFrame, DataFrame]:
    """(bridges (u, v) with u < v, articulation points (id)): in one task if the graph is one part, in rounds if it is more."""
    parts = cut(edges.withColumn("one", F.lit(1.0)), "one", nodes, part_arcs)
    if parts.crossed:
        return bridges_and_points(edges, nodes, part_arcs)
    kind = dict(parts.of.dtypes)["node"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                ids = b.column("ids")[k].as_py()
                bridges, points = depth_first(b.column("offsets")[k].as_py(), b.column("targets")[k].as_py())
                out = [(ids[u], ids[v]) for u, v in bridges] + [(ids[p], None) for p in points]
                of = b.schema.field("ids").type.value_type
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], of) for i in (0, 1)], ["u", "v"])

    found = materialize(parts.inside.mapInArrow(run, f"u {kind}, v {kind}"), "cuts")
    return found.filter("v IS NOT NULL"), found.filter("v IS NULL").select(F.col("u").alias("id"))
