"""Networks: nodes (id, x, y, ...) and undirected edges (u, v, length, ...) with u <= v, at most one edge a pair.

Searches and centrality cut the graph into parts and go in rounds from part to part (see search.py, betweenness.py and
biconnected.py); no task holds more than a part.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from geoloom.functions import geometry as G
from geoloom.functions.keys import to_double
from geoloom.operators.betweenness import betweenness
from geoloom.operators.biconnected import cut_points
from geoloom.operators.search import PART_ARCS, arcs_of, cut, search, ways_between
from geoloom.operators.spatial import pairs
from geoloom.plans.stages import components, materialize


def merge_parallel(edges: DataFrame, order: Sequence[str] = ()) -> DataFrame:
    """One edge for each pair of nodes: the shortest (ties by order), with parallel_edges, how many there were."""
    low, high = F.least("u", "v"), F.greatest("u", "v")
    row = F.struct(low.alias("u"), high.alias("v"), *[c for c in edges.columns if c not in ("u", "v")])
    least = F.struct(F.col("length").isNull(), "length", *order)  # an edge of unknown length only where there is no other
    one = edges.groupBy(low.alias("__u"), high.alias("__v")).agg(F.min_by(row, least).alias("e"), F.count("*").alias("parallel_edges"))
    return one.select("e.*", "parallel_edges")


def gtfs_edges(stop_times: DataFrame, trips: DataFrame, routes: DataFrame, stops: DataFrame, route_types: Sequence[int]) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a timetable: directed pairs of stops that follow each other on a trip of these route types."""
    of_type = trips.join(routes.filter(F.col("route_type").isin(*route_types)).select("route_id"), "route_id", "left_semi").select("trip_id")
    line = Window.partitionBy("trip_id").orderBy(F.col("stop_sequence").cast("long"))
    times = stop_times.join(of_type, "trip_id", "left_semi").withColumn("to_id", F.lead("stop_id").over(line))
    found = times.filter("to_id IS NOT NULL AND to_id <> stop_id").select(F.col("stop_id").alias("from_id"), "to_id").distinct()
    at = stops.select("stop_id", F.col("stop_lon").cast("double").alias("x"), F.col("stop_lat").cast("double").alias("y")).dropna()
    a = at.select(F.col("stop_id").alias("from_id"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    b = at.select(F.col("stop_id").alias("to_id"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    edges = found.join(a, "from_id").join(b, "to_id")
    used = edges.select(F.col("from_id").alias("stop_id")).union(edges.select("to_id")).distinct()
    return at.join(used, "stop_id", "left_semi"), edges


def edge_list_network(nodes: DataFrame, edges: DataFrame, node_key: str, from_column: str, to_column: str, length_column: str | None = None, unit: float = 1.0, unknown_nodes: str = "error") -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) from a node table (node_key, x, y) and an edge table; the length falls back to the straight line.

    Loops go; parallel edges merge to the shortest. unknown_nodes: error, or drop.
    """
    keyed = nodes.withColumnRenamed(node_key, "id")
    bad = keyed.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1 OR id IS NULL OR trim(cast(id AS string)) = ''")
    if not bad.isEmpty():
        raise ValueError("a node key is missing, blank or stands twice")
    a = keyed.select(F.col("id").alias("u"), F.col("x").alias("x1"), F.col("y").alias("y1"), F.lit(True).alias("ua"))
    b = keyed.select(F.col("id").alias("v"), F.col("x").alias("x2"), F.col("y").alias("y2"), F.lit(True).alias("vb"))
    rows = edges.withColumnsRenamed({from_column: "u", to_column: "v"}).join(a, "u", "left").join(b, "v", "left")
    known = F.col("ua").isNotNull() & F.col("vb").isNotNull()
    rows = rows.filter(known if unknown_nodes == "drop" else F.when(known, True).otherwise(F.raise_error(F.lit("an edge has an unknown node"))))
    straight = F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    size = F.coalesce(to_double(F.col(length_column)) * unit, straight) if length_column else straight
    rows = rows.filter("u <> v").select("u", "v", size.alias("length"), *[c for c in edges.columns if c not in (from_column, to_column, length_column, "length")])
    return keyed, merge_parallel(rows)


def build_network(lines: DataFrame, nodes: DataFrame, tolerance_m: float, node_key: str = "id") -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): the two ends of each part of a line at the nearest node within the tolerance (ties: the smaller key).

    Edges keep the lines' other columns; of parallel edges the shortest stays, and parallel_edges counts them all, the
    same line twice too. Parts with an end at no node go.
    """
    c = G.centroid(F.col("geometry"))
    at = nodes.select(F.col(node_key).alias("id"), c["x"].alias("x"), c["y"].alias("y"))
    more = [n for n in lines.columns if n not in ("geometry", "u", "v", "length", "parallel_edges")]
    parts = lines.select(F.monotonically_increasing_id().alias("row"), F.struct(F.lit(0).alias("_"), *more).alias("a"), F.posexplode("geometry.parts").alias("part", "p")).withColumn("ring", F.col("p")[0])
    parts = parts.select("row", "part", "a", G.length(G.line_of(F.col("ring"))).alias("length"), F.posexplode(F.array(F.col("ring")[0], F.element_at("ring", -1))).alias("end", "e"))
    step = lambda v: F.floor(v / tolerance_m).cast("long")
    near = lambda v: F.explode(F.sequence(step(v) - 1, step(v) + 1))
    asked = parts.withColumn("cx", near(F.col("e.x"))).withColumn("cy", near(F.col("e.y")))
    met = asked.join(at.withColumn("cx", step(F.col("x"))).withColumn("cy", step(F.col("y"))), ["cx", "cy"])
    met = met.withColumn("d", F.hypot(F.col("x") - F.col("e.x"), F.col("y") - F.col("e.y"))).filter(F.col("d") <= tolerance_m)
    end = lambda n: F.min_by(F.when(F.col("end") == n, F.col("id")), F.when(F.col("end") == n, F.struct("d", "id")))
    both = met.groupBy("row", "part").agg(end(0).alias("u"), end(1).alias("v"), F.any_value("length").alias("length"), F.any_value("a").alias("a"))
    both = both.filter("u IS NOT NULL AND v IS NOT NULL").select("u", "v", "length", *[F.col(f"a.{n}").alias(n) for n in more], "row", "part")
    return at, merge_parallel(both, ["row", "part"]).drop("row", "part")


#: Columns of edges that line_network() makes itself.
MADE = ("length", "geometry", "travel_time_min", "u", "v", "parallel_edges")


def line_network(lines: DataFrame, speed_kmh: float | None = None, tolerance_m: float = 0.0, attributes: Sequence[str] = (), polygons: str = "skip") -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): lines are split at their ends and at vertices that occur twice or more. ids number places by (x, y).

    Edges have their geometry, travel_time_min if there is a speed, and the attributes of their lines. Vertices that single
    linkage joins within the tolerance become the smallest (x, y) of them; lines that shrink to a point go. Polygons are
    skipped, or give their boundary. Of parallel edges the shortest stays.
    """
    if clash := [n for n in attributes if n in MADE]:
        raise ValueError(f"line_network makes {', '.join(clash)} itself")
    wanted = F.col("geometry.dim") == 1
    wanted = wanted | (F.col("geometry.dim") == 2) if polygons == "boundary" else wanted
    held = F.struct(F.lit(0).alias("_"), *attributes).alias("a")
    parts = lines.filter(wanted).select(F.monotonically_increasing_id().alias("row"), held, F.posexplode(G.rings(F.col("geometry"))).alias("part", "ring"))
    verts = parts.select(F.struct("row", "part").alias("k"), "a", F.posexplode("ring").alias("i", "p")).select("k", "a", "i", "p.x", "p.y")
    verts = materialize(verts, "vertices")
    if tolerance_m > 0:
        spots = verts.select("x", "y").distinct().withColumn("id", F.struct("x", "y"))
        moved = merge_ends(spots, tolerance_m).select("x", "y", "group")
        verts = verts.join(moved, ["x", "y"]).select("k", "a", "i", "group.x", "group.y")
    line = Window.partitionBy("k").orderBy("i")
    was = F.lag(F.struct("x", "y")).over(line)
    verts = verts.withColumn("was", was).filter(~F.col("was").eqNullSafe(F.struct("x", "y")))
    verts = verts.withColumn("to", F.lead(F.struct("x", "y")).over(line)).filter("was IS NOT NULL OR to IS NOT NULL")
    verts = materialize(verts, "vertices")
    ends = verts.filter("was IS NULL OR to IS NULL").select("x", "y")
    shared = verts.groupBy("x", "y").agg(F.count("*").alias("m")).filter("m > 1").select("x", "y")
    spots = ends.union(shared).distinct().withColumn("id", F.format_string("%.6f/%.6f", "x", "y"))
    flags = verts.join(spots, ["x", "y"], "left").withColumn("piece", F.count("id").over(line)).withColumn("end", F.lead("id").over(line))
    steps = flags.filter("to IS NOT NULL").withColumn("d", F.hypot(F.col("to.x") - F.col("x"), F.col("to.y") - F.col("y")))
    drawn = F.transform(F.array_sort(F.collect_list(F.struct("i", "x", "y"))), lambda p: G.xy(p["x"], p["y"]))
    edges = steps.groupBy("k", "piece").agg(F.sum("d").alias("length"), F.min_by("id", "i").alias("u"), F.max_by("end", "i").alias("v"), F.any_value("a").alias("a"), F.concat(drawn, F.array(F.max_by("to", "i"))).alias("ring"))
    edges = edges.filter("u <> v").select("u", "v", "length", *[F.col(f"a.{n}").alias(n) for n in attributes], G.line_of(F.col("ring")).alias("geometry"), "k", "piece")
    edges = merge_parallel(edges, ["k", "piece"]).drop("k", "piece")
    if speed_kmh:
        edges = edges.withColumn("travel_time_min", F.col("length") / 1000 / speed_kmh * 60)
    return spots.select("id", "x", "y"), edges


def network_nodes(lines: DataFrame, decimals: int = 6, tolerance_m: float = 0.0, order: Sequence[str] = ()) -> DataFrame:
    """The distinct ends of the lines' parts as points; with a tolerance, the means of groups of ends.

    Ends are taken in the order of the columns ``order`` (those that a tolerance needs), then of parts, start before end. The
    first one that is in no group makes one, with all ends within the tolerance that are in none.
    """
    parts = lines.filter("geometry.dim = 1").select(F.struct(F.lit(0).alias("_"), *order).alias("o"), F.posexplode("geometry.parts").alias("part", "p"))
    ends = parts.select("o", "part", F.posexplode(F.array(F.col("p")[0][0], F.element_at(F.col("p")[0], -1))).alias("end", "e"))
    if tolerance_m > 0:
        if not order:
            raise ValueError("a tolerance needs an order of the lines")
        spots = ends.groupBy(F.col("e.x").alias("x"), F.col("e.y").alias("y")).agg(F.min(F.struct("o", "part", "end")).alias("o"), F.count("*").alias("n"))
        spots = materialize(spots, "spots")
        of = first_come(spots.select("x", "y", "o"), tolerance_m)
        mean = lambda c: (F.sum(F.col(c) * F.col("n")) / F.sum("n")).alias(c)
        at = spots.join(of, ["x", "y"]).groupBy("centre").agg(mean("x"), mean("y"))
    else:
        at = ends.select(F.bround("e.x", decimals).alias("x"), F.bround("e.y", decimals).alias("y")).distinct()
    return at.select("x", "y", G.point(F.col("x"), F.col("y")).alias("geometry"))


def first_come(spots: DataFrame, tolerance: float) -> DataFrame:
    """(x, y, centre) of places (x, y, o): the places in order o, each in the group of the first centre within the tolerance.

    A centre is a place with no centre before it within the tolerance. In cells of tolerance / sqrt(2) all places are
    neighbours, so a cell has one candidate, its first place; it is a centre if the first places of all cells around come
    after it. Places near new centres are done, and the next round goes on with the rest: rounds of cells and joins with
    centres, of which there are few in any place, and no pairs of places.
    """
    side = tolerance / math.sqrt(2) * (1 - 1e-12)
    cell = lambda c: F.floor(F.col(c) / side).cast("long")
    around = lambda c, d: F.explode(F.sequence(F.col(c) - d, F.col(c) + d))
    left = materialize(spots.withColumns({"cx": cell("x"), "cy": cell("y")}), "places")
    found = []
    near = lambda places, centres: places.join(centres.select(F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("o").alias("centre"), around("cx", 2).alias("cx"), "cy").withColumn("cy", around("cy", 2)), ["cx", "cy"]).filter(F.hypot(F.col("x") - F.col("x2"), F.col("y") - F.col("y2")) <= tolerance)
    while not left.isEmpty():
        first = left.groupBy("cx", "cy").agg(F.min(F.struct("o", "x", "y")).alias("f"))
        seen = first.select(F.col("f.o").alias("o"), around("cx", 2).alias("cx"), "cy").withColumn("cy", around("cy", 2)).groupBy("cx", "cy").agg(F.min("o").alias("least"))
        new = materialize(first.join(seen, ["cx", "cy"]).filter(F.col("f.o") == F.col("least")).select("cx", "cy", "f.*"), "centres")
        found.append(new)
        left = materialize(left.join(near(left, new).select("x", "y").distinct(), ["x", "y"], "left_anti"), "places")
    if not found:
        return spots.select("x", "y", F.col("o").alias("centre"))
    centres = reduce(DataFrame.union, found)
    all_ = spots.withColumns({"cx": cell("x"), "cy": cell("y")})
    return near(all_, centres).groupBy("x", "y").agg(F.min("centre").alias("centre"))


def graph_to_vector(nodes: DataFrame, edges: DataFrame, part: str = "edges") -> DataFrame:
    """Nodes as points, or edges as straight lines with node_u and node_v."""
    if part == "nodes":
        return nodes.withColumn("geometry", G.point(F.col("x"), F.col("y")))
    a = nodes.select(F.col("id").alias("node_u"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    b = nodes.select(F.col("id").alias("node_v"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    rows = edges.withColumnsRenamed({"u": "node_u", "v": "node_v"}).join(a, "node_u").join(b, "node_v")
    return rows.withColumn("geometry", G.line(G.xy(F.col("x1"), F.col("y1")), G.xy(F.col("x2"), F.col("y2")))).drop("x1", "y1", "x2", "y2")


def distances(edges: DataFrame, sources: DataFrame, weight: str = "length", before: bool = False, limit: float | None = None, nodes: DataFrame | None = None, part_arcs: int = PART_ARCS) -> DataFrame:
    """(source, node, d[, before]) of all nodes that each source (source, node) reaches, within the limit if there is one.

    before is the node ahead on the shortest way (ties: fewer hops, then the smaller), null at the source. nodes (id, x, y)
    tell what lies together. Edges without a weight can't be travelled; a negative weight is an error.
    """
    out = search(cut(edges, weight, nodes, part_arcs), sources, limit).labels()
    return out.select("source", "node", "d", *(["before"] if before else []))


def _snap(points: DataFrame, nodes: DataFrame, key: str, max_snap_m: float) -> DataFrame:
    """(k, node, snap): the nearest node within max_snap_m."""
    step = lambda v: F.floor(v / max_snap_m).cast("long")
    near = lambda v: F.explode(F.sequence(step(v) - 1, step(v) + 1))
    g = F.col("geometry")
    asked = points.select(F.col(key).alias("k"), G.px(g).alias("px"), G.py(g).alias("py")).withColumn("cx", near(F.col("px"))).withColumn("cy", near(F.col("py")))
    # Both sides are dealt out by cells: behind a broadcast, a task would sort what its whole split of points becomes.
    met = asked.hint("merge").join(nodes.select("id", "x", "y", step(F.col("x")).alias("cx"), step(F.col("y")).alias("cy")), ["cx", "cy"])
    met = met.withColumn("snap", F.hypot(F.col("px") - F.col("x"), F.col("py") - F.col("y"))).filter(F.col("snap") <= max_snap_m)
    return met.groupBy("k").agg(F.min_by("id", F.struct("snap", "id")).alias("node"), F.min("snap").alias("snap"))


def shortest_path(nodes: DataFrame, edges: DataFrame, origins: DataFrame, destinations: DataFrame, key: str, max_snap_m: float) -> DataFrame:
    """origins with network_distance to the nearest destination; null if it cannot be reached."""
    ends = _snap(destinations, nodes, key, max_snap_m).select(F.lit(0).alias("source"), "node").distinct()
    reach = distances(edges, ends, nodes=nodes).groupBy("node").agg(F.min("d").alias("network_distance"))
    at = _snap(origins, nodes, key, max_snap_m).join(reach, "node").select(F.col("k").alias("__k"), "network_distance")
    return origins.join(at, origins[key] == F.col("__k"), "left").drop("__k")


def reached(nodes: DataFrame, edges: DataFrame, origins: DataFrame, key: str, max_snap_m: float, limit_m: float) -> DataFrame:
    """(id, x, y, d): nodes within limit_m of any origin."""
    starts = _snap(origins, nodes, key, max_snap_m).select(F.lit(0).alias("source"), "node").distinct()
    return distances(edges, starts, limit=limit_m, nodes=nodes).select(F.col("node").alias("id"), "d").join(nodes, "id").select("id", "x", "y", "d")


def largest_component(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The nodes of the component with the most nodes (ties: that of the smaller id)."""
    of = materialize(connected_components(nodes, edges), "component")
    top = of.groupBy("component").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "component").limit(1)
    return of.join(F.broadcast(top.select("component")), "component", "left_semi").select(*nodes.columns)


def _laid(steps: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(source, target, length_m[, travel_time_min], path, geometry) of the ways that steps are of; no line for a single node."""
    times = [c for c in ("travel_time_min",) if c in edges.columns]
    order = Window.partitionBy("source", "target").orderBy(F.desc("i"))
    at = steps.join(nodes.select(F.col("id").alias("node"), "x", "y"), "node").withColumn("from", F.lag(F.struct("node", "x", "y")).over(order))
    ring = F.col("geometry.parts")[0][0] if "geometry" in edges.columns else F.lit(None).cast(f"array<{G.XY}>")
    of = edges.select(F.least("u", "v").alias("lo"), F.greatest("u", "v").alias("hi"), "length", *times, ring.alias("ring"))
    met = at.withColumn("lo", F.least("node", "from.node")).withColumn("hi", F.greatest("node", "from.node")).join(of, ["lo", "hi"], "left")
    # An edge is drawn either way; it starts at whichever of its ends is nearer to where the way comes from.
    away = lambda e: F.hypot(e["x"] - F.col("from.x"), e["y"] - F.col("from.y"))
    turned = F.when(away(F.get("ring", F.lit(0))) <= away(F.try_element_at("ring", F.lit(-1))), F.col("ring")).otherwise(F.reverse("ring"))
    drawn = F.coalesce(turned, F.array(G.xy(F.col("from.x"), F.col("from.y")), G.xy(F.col("x"), F.col("y"))))
    piece = F.when(F.col("from").isNotNull(), drawn).otherwise(F.array().cast(f"array<{G.XY}>"))
    sums = [F.coalesce(F.sum(c), F.lit(0.0)).alias(n) for c, n in (("length", "length_m"), *((t, t) for t in times))]
    one = met.groupBy("source", "target").agg(*sums, F.array_sort(F.collect_list(F.struct((-F.col("i")).alias("o"), "node", piece.alias("p")))).alias("s"))
    joined = F.flatten(F.transform("s", lambda s, j: F.when(j <= 1, s["p"]).otherwise(F.slice(s["p"], 2, F.greatest(F.size(s["p"]) - 1, F.lit(0))))))
    return one.select("source", "target", "length_m", *times, F.transform("s", lambda s: s["node"]).alias("path"), F.when(F.size("s") > 1, G.line_of(joined)).alias("geometry"))


def _ways(nodes: DataFrame, edges: DataFrame, ends: DataFrame, weight: str) -> DataFrame:
    """The steps of the ways of ends (source, target). A search first goes twice as far as edges of the usual weight a metre would
    be in a straight line, and an edge at least."""
    parts = cut(edges, weight, nodes)
    at = nodes.groupBy("id").agg(F.first("x").alias("x"), F.first("y").alias("y"))
    named = lambda df, *ends: reduce(lambda d, e: d.join(at.select(F.col("id").alias(e), F.struct("x", "y").alias(f"at_{e}")), e), ends, df).withColumn("straight", F.hypot(*[F.col(f"at_{ends[0]}.{k}") - F.col(f"at_{ends[1]}.{k}") for k in "xy"]))
    facts = named(arcs_of(edges, weight), "u", "v").agg(F.avg("w").alias("edge"), F.try_divide(F.sum("w"), F.sum("straight")).alias("rate"))
    reach = F.greatest(2 * F.col("straight") * F.col("rate"), F.col("edge"))
    guessed = named(ends, "source", "target").join(F.broadcast(facts)).select("source", "target", F.coalesce(reach, F.lit(0.0)).alias("reach"))

    def reachable(left: DataFrame) -> DataFrame:
        roots = materialize(components(arcs_of(edges, weight).select(F.col("u").alias("a"), F.col("v").alias("b"))), "roots")
        own = lambda e: roots.select(F.col("node").alias(e), F.col("root").alias(f"root_{e}"))
        return left.join(own("source"), "source").join(own("target"), "target").filter("root_source = root_target").select(*left.columns)

    return ways_between(parts, guessed, reachable)


def route(nodes: DataFrame, edges: DataFrame, origins: DataFrame, destinations: DataFrame, key: str, max_snap_m: float, pairing: str = "pairwise", weight: str = "length", snap_to: str = "largest_component") -> DataFrame:
    """A row for each pair (same key, or all): length_m, travel_time_min if edges have it, straight_line_m, detour_factor,
    snaps, path (ids of nodes) and geometry, the line along the edges (straight where an edge has no geometry).

    A pair that cannot be snapped or joined has nulls. pairing cross pairs every origin with every destination, as asked;
    nothing else is crossed.
    """
    if weight not in edges.columns:
        raise ValueError(f"edges have no {weight}")
    snapped = largest_component(nodes, edges) if snap_to == "largest_component" else nodes
    a = _snap(origins, snapped, key, max_snap_m).select(F.col("k").alias("origin"), F.col("node").alias("source"), F.col("snap").alias("origin_snap_m"))
    b = _snap(destinations, snapped, key, max_snap_m).select(F.col("k").alias("destination"), F.col("node").alias("target"), F.col("snap").alias("destination_snap_m"))
    at = lambda df, n, x, y: df.select(F.col(key).alias(n), G.px(F.col("geometry")).alias(x), G.py(F.col("geometry")).alias(y))
    o, d = at(origins, "origin", "ox", "oy"), at(destinations, "destination", "dx", "dy")
    asked = o.crossJoin(d) if pairing == "cross" else o.join(d, o.origin == d.destination)
    asked = materialize(asked.join(a, "origin", "left").join(b, "destination", "left"), "asked")
    ends = asked.filter("source IS NOT NULL AND target IS NOT NULL").select("source", "target").distinct()
    laid = _laid(_ways(nodes, edges, ends, weight), nodes, edges)
    straight = F.hypot(F.col("dx") - F.col("ox"), F.col("dy") - F.col("oy"))
    times = [c for c in laid.columns if c == "travel_time_min"]
    out = asked.join(laid, ["source", "target"], "left")
    return out.select("origin", "destination", "length_m", *times, straight.alias("straight_line_m"), F.try_divide("length_m", straight).alias("detour_factor"), "origin_snap_m", "destination_snap_m", "path", "geometry")


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes with component: the smallest id that is reachable."""
    roots = components(edges.select(F.col("u").alias("a"), F.col("v").alias("b")))
    return nodes.join(roots, nodes.id == roots.node, "left").withColumn("component", F.coalesce("root", "id")).drop("node", "root")


def centrality(nodes: DataFrame, edges: DataFrame, part_arcs: int = PART_ARCS) -> tuple[DataFrame, DataFrame]:
    """nodes with betweenness, component and is_articulation_point; edges with is_bridge."""
    bridges, points = cut_points(edges, nodes, part_arcs)
    at = points.select(F.col("id").alias("__p")).withColumn("is_articulation_point", F.lit(True))
    over = bridges.select(F.col("u").alias("__u"), F.col("v").alias("__v")).withColumn("is_bridge", F.lit(True))
    scored = connected_components(betweenness(nodes, edges, part_arcs=part_arcs), edges)
    out = scored.join(at, F.col("id") == F.col("__p"), "left").drop("__p").fillna(False, ["is_articulation_point"])
    pair = (F.least("u", "v") == F.col("__u")) & (F.greatest("u", "v") == F.col("__v"))
    return out, edges.join(over, pair, "left").drop("__u", "__v").fillna(False, ["is_bridge"])


def voltage(text: Column) -> Column:
    """The highest number of a list with semicolons."""
    return F.array_max(F.transform(F.split(text, ";"), lambda v: to_double(v)))


def power_grid_topology(substations: DataFrame, lines: DataFrame, min_voltage: float, tolerance_m: float, node_key: str = "id", field: str = "voltage") -> tuple[DataFrame, DataFrame]:
    """build_network() of what carries at least min_voltage (lines without a voltage stay)."""
    strong = substations.filter(voltage(F.col(field)) >= min_voltage)
    if field in lines.columns:
        lines = lines.filter(F.coalesce(voltage(F.col(field)) >= min_voltage, F.lit(True)))
    return build_network(lines, strong, tolerance_m, node_key)


def merge_ends(points: DataFrame, tolerance_m: float) -> DataFrame:
    """points (id, x, y) with group: the smallest id of those that single linkage within the tolerance joins."""
    step = lambda v: F.floor(F.col(v) / tolerance_m).cast("long")
    near = lambda v: F.explode(F.sequence(step(v) - 1, step(v) + 1))
    spots = materialize(points.groupBy("x", "y").agg(F.min("id").alias("s")), "spots")
    a = spots.select(F.col("s").alias("a"), F.col("x").alias("x1"), F.col("y").alias("y1"), near("x").alias("cx"), "y").withColumn("cy", near("y"))
    b = spots.select(F.col("s").alias("b"), F.col("x").alias("x2"), F.col("y").alias("y2"), step("x").alias("cx"), step("y").alias("cy"))
    met = a.join(b, ["cx", "cy"]).filter((F.col("a") < F.col("b")) & (F.hypot(F.col("x1") - F.col("x2"), F.col("y1") - F.col("y2")) <= tolerance_m))
    roots = components(met.select("a", "b"))
    named = spots.join(roots, spots.s == roots.node, "left").select("x", "y", F.coalesce("root", "s").alias("group"))
    return points.join(named, ["x", "y"])


def grid_of_lines(lines: DataFrame, substations: DataFrame, key: str, tolerance_m: float) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of power lines: an end in a substation's area (or within the tolerance of its centre) is that
    substation, the other ends are joined by single linkage. Loops go, parallel edges merge to the shortest.
    """
    parts = lines.select(F.monotonically_increasing_id().alias("row"), F.posexplode("geometry.parts").alias("part", "p")).select(F.struct("row", "part").alias("k"), F.col("p")[0].alias("ring"))
    ends = parts.select("k", G.length(G.line_of(F.col("ring"))).alias("length"), F.posexplode(F.array(F.col("ring")[0], F.element_at("ring", -1))).alias("end", "e"))
    ends = materialize(ends.select("k", "length", "end", F.col("e.x").alias("x"), F.col("e.y").alias("y"), F.xxhash64("e.x", "e.y").alias("id"), G.point(F.col("e.x"), F.col("e.y")).alias("geometry")), "ends")
    inside = pairs(ends.select("k", "end", "geometry").withColumn("key", F.struct("k", "end")), substations.select(F.col(key).alias("station"), "geometry"), max(10 * tolerance_m, 1000.0), G.intersects(F.col("l.geometry"), F.col("r.geometry")))
    inside = inside.groupBy("l.k", "l.end").agg(F.min("r.station").alias("station"))
    c = G.centroid(F.col("geometry"))
    centres = substations.select(F.col(key).alias("id"), c["x"].alias("x"), c["y"].alias("y"))
    near = _snap(ends.withColumn("ke", F.struct("k", "end")), centres, "ke", tolerance_m).select("k.k", "k.end", F.col("node").alias("close"))
    named = ends.join(inside, ["k", "end"], "left").join(near, ["k", "end"], "left").withColumn("station", F.coalesce("station", "close"))
    free = merge_ends(named.filter("station IS NULL").select("k", "end", "length", "id", "x", "y"), tolerance_m)
    all_ = named.filter("station IS NOT NULL").select("k", "end", "length", F.concat(F.lit("s"), F.col("station").cast("string")).alias("node"))
    all_ = all_.unionByName(free.select("k", "end", "length", F.concat(F.lit("e"), F.col("group").cast("string")).alias("node")))
    both = all_.groupBy("k", "length").agg(F.max(F.when(F.col("end") == 0, F.col("node"))).alias("u"), F.max(F.when(F.col("end") == 1, F.col("node"))).alias("v"))
    at = centres.select(F.concat(F.lit("s"), F.col("id").cast("string")).alias("id"), "x", "y", F.lit("substation").alias("kind"))
    at = at.union(free.groupBy("group").agg(F.avg("x").alias("x"), F.avg("y").alias("y")).select(F.concat(F.lit("e"), F.col("group").cast("string")).alias("id"), "x", "y", F.lit("end").alias("kind")))
    return at, merge_parallel(both.filter("u <> v").select("u", "v", "length"))
