"""The distance to the nearest other feature, for geometries of any kind.

Targets become segments (a point is one without length), and these a tree of cells: a cell with more than LEAF segments has
4 x 4 cells below it, so a crowded place gets small cells and an empty one large ones. A node of the tree says how many
segments it has and in which box they lie. Segments longer than the finest cells are cut to them, or a place would lie in
many nodes' boxes. Probes first look at the segments of the leaf they lie in, which bounds their distance. Then they go down
the tree level by level, each as rows of (probe, node): a node's box can't be nearer than its lower bound, and something in
it is not farther than its upper bound; nodes whose lower bound is beyond a probe's least upper bound are left out, and the
segments of the leaves that remain are searched. So a probe meets few segments, however far it is and however many lie
together, and a level is one join on cells.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoloom.functions import geometry as G
from geoloom.operators.attributes import need
from geoloom.operators.spatial import some
from geoloom.plans.stages import materialize

#: Segments of a leaf at most, unless they can't be told apart by cells.
LEAF = 128
#: Cells below a cell on each axis, and levels of the tree at most (beyond them a cell is narrower than a double can tell).
SPLIT, DEEPEST = 4, 22
#: Levels whose nodes are sent to all tasks: 16 + 256 rows.
SENT = 2
#: Cutting segments to the width of cells adds up to so many stretches for each one.
CUTS = 8
#: A step on more than MANY rows has a task for about TASK of them.
MANY, TASK = 4_000_000, 50_000


# Expressions as SQL text: they are long, and text is one call to the JVM.


def _point_segment(p: str, s: str) -> str:
    """The distance of the point p from the segment s, a struct(a, b)."""
    dx, dy = f"({s}.b.x - {s}.a.x)", f"({s}.b.y - {s}.a.y)"
    t = f"greatest(0D, least(1D, coalesce(try_divide(({p}.x - {s}.a.x) * {dx} + ({p}.y - {s}.a.y) * {dy}, {dx} * {dx} + {dy} * {dy}), 0D)))"
    return f"hypot({p}.x - ({s}.a.x + {t} * {dx}), {p}.y - ({s}.a.y + {t} * {dy}))"


def segment_distance(s: str, t: str) -> Column:
    """The distance of two segments, columns struct(a, b); 0 if they meet."""
    cross = lambda a, b, p: f"signum(({b}.x - {a}.x) * ({p}.y - {a}.y) - ({b}.y - {a}.y) * ({p}.x - {a}.x))"
    over = [f"greatest({s}.a.{k}, {s}.b.{k}) >= least({t}.a.{k}, {t}.b.{k}) AND greatest({t}.a.{k}, {t}.b.{k}) >= least({s}.a.{k}, {s}.b.{k})" for k in "xy"]
    sides = [f"{cross(f'{u}.a', f'{u}.b', f'{v}.a')} * {cross(f'{u}.a', f'{u}.b', f'{v}.b')} <= 0" for u, v in ((s, t), (t, s))]
    ends = [_point_segment(f"{u}.{e}", v) for u, v in ((s, t), (t, s)) for e in "ab"]
    return F.expr(f"CASE WHEN {' AND '.join([*over, *sides])} THEN 0D ELSE least({', '.join(ends)}) END")


#: All segments of a geometry; a point is a segment from itself to itself.
_SEGMENTS = """CASE WHEN geometry.dim = 0 THEN transform(flatten(flatten(geometry.parts)), v -> named_struct('a', v, 'b', v))
ELSE flatten(transform(flatten(geometry.parts), r -> if(size(r) > 1, zip_with(slice(r, 1, size(r) - 1), slice(r, 2, size(r) - 1), (a, b) -> named_struct('a', a, 'b', b)), transform(r, v -> named_struct('a', v, 'b', v))))) END"""
#: Their set, whichever way they are drawn.
_SET = "array_distinct(array_sort(transform(segments, s -> struct(least(s.a, s.b), greatest(s.a, s.b)))))"


def known(df: DataFrame) -> DataFrame:
    """Rows with a geometry, and sign, which tells geometries apart: their dimension and their set of segments."""
    rows = df.withColumn("segments", F.expr(_SEGMENTS)).filter("size(segments) > 0").withColumn("set", F.expr(_SET))
    return rows.withColumn("sign", F.expr("struct(xxhash64(geometry.dim, set) AS h, xxhash64(1, set) AS i)")).drop("segments", "set")


def _parts(df: DataFrame, longest: float | None) -> DataFrame:
    """(sign, s, box): each segment, once for each of its stretches that are no longer than ``longest``; box is the stretch's."""
    return _cut(df.select("sign", F.expr(f"explode({_SEGMENTS}) AS s")), longest)


def _cut(rows: DataFrame, longest: float | None) -> DataFrame:
    """As _parts(), of rows (sign, s)."""
    a, b = F.col("s")["a"], F.col("s")["b"]
    if longest is not None:
        n = F.greatest(F.lit(1), F.least(F.ceil(F.hypot(b["x"] - a["x"], b["y"] - a["y"]) / longest), F.lit(1_000_000))).cast("int")
        rows = rows.withColumn("n", n).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
        at = lambda k, i: F.when(i >= F.col("n"), b[k]).otherwise(a[k] + (b[k] - a[k]) * i / F.col("n"))
        ends = [(at("x", F.col("i") + d), at("y", F.col("i") + d)) for d in (0, 1)]
    else:
        ends = [(a["x"], a["y"]), (b["x"], b["y"])]
    (x0, y0), (x1, y1) = ends
    return rows.select("sign", "s", G.named(x0=F.least(x0, x1), y0=F.least(y0, y1), x1=F.greatest(x0, x1), y1=F.greatest(y0, y1)).alias("box")).distinct()


class _Tree:
    """nodes: (l, cx, cy, n, box, low, high, leaf), root left out; leaves: (l, cx, cy, sign, s)."""

    def __init__(self, shapes: DataFrame, longest: float, leaf: int) -> None:
        parts = materialize(_parts(shapes, longest), "segments")
        length = F.sum(F.hypot(F.col("box.x1") - F.col("box.x0"), F.col("box.y1") - F.col("box.y0")))
        ends = parts.agg(F.count("*"), F.min("box.x0"), F.min("box.y0"), F.max("box.x1"), F.max("box.y1"), length).first()
        self.empty = not ends[0]
        if self.empty:
            return
        self.x0, self.y0 = ends[1], ends[2]
        self.side = max(ends[3] - ends[1], ends[4] - ends[2], 1e-300) * (1 + 1e-9)
        #: What rounding may take from a distance.
        self.hair = 1e-14 * max(map(abs, ends[1:5]))
        # As deep as evenly spread segments, cut to the cells, need at once; crowded cells go on level by level.
        first, width = 1, self.side / SPLIT
        while first < DEEPEST and ends[0] + (ends[5] / width if width < longest else 0) > leaf * SPLIT ** (2 * first):
            first, width = first + 1, width / SPLIT
        width = max(width, ends[5] / (CUTS * ends[0]))
        if ends[5] and width < longest:
            parts = materialize(_cut(parts.select("sign", "s").distinct(), width), "segments")
        levels, left, done = list(range(1, first + 1)), parts, []
        while True:
            placed = left.withColumn("l", F.explode(F.array(*map(F.lit, levels)))).withColumns(self.cell(F.col("l")))
            counts = materialize(self.counted(placed), "cells")
            done.append((left, counts, levels))
            last = levels[-1]
            crowded = counts.filter((F.col("l") == last) & (F.col("n") > leaf)).select("l", "cx", "cy")
            if last >= DEEPEST or not counts.agg(F.max(F.when(F.col("l") == last, F.col("n")))).first()[0] > leaf:
                break
            left = materialize(left.withColumn("l", F.lit(last)).withColumns(self.cell(F.col("l"))).join(crowded, ["l", "cx", "cy"], "left_semi").select("sign", "s", "box"), "crowded")
            levels = [last + 1]
        self.depth = done[-1][2][-1]
        nodes = done[0][1]
        for _, counts, _ in done[1:]:
            nodes = nodes.union(counts)
        above = nodes.filter(F.col("n") > leaf).select((F.col("l") + 1).alias("l"), F.col("cx").alias("ux"), F.col("cy").alias("uy"))
        up = nodes.withColumns({"ux": F.floor(F.col("cx") / SPLIT), "uy": F.floor(F.col("cy") / SPLIT)})
        kept = up.filter("l = 1").unionByName(up.filter("l > 1").join(above, ["l", "ux", "uy"], "left_semi").select(*up.columns))
        nodes = kept.withColumn("leaf", (F.col("n") <= leaf) | (F.col("l") == self.depth))
        self.nodes = nodes if len(done) == 1 else materialize(nodes, "nodes")
        ends_ = self.nodes.filter("leaf").select("l", "cx", "cy")
        found = None
        for left, _, levels in done:
            placed = left.withColumn("l", F.explode(F.array(*map(F.lit, levels)))).withColumns(self.cell(F.col("l")))
            own = placed.join(ends_, ["l", "cx", "cy"], "left_semi").select("l", "cx", "cy", "sign", "s")
            found = own if found is None else found.union(own)
        self.leaves = materialize(found.distinct(), "leaves")
        #: Levels with leaves.
        self.ends = sorted(r[0] for r in self.leaves.select("l").distinct().collect())

    def cell(self, level: Column) -> dict[str, Column]:
        """The cell of a stretch's middle."""
        n = F.pow(F.lit(float(SPLIT)), level)
        at = lambda a, b, o: F.greatest(F.lit(0), F.least(F.floor(((F.col(f"box.{a}") + F.col(f"box.{b}")) / 2 - o) / self.side * n), n - 1)).cast("long")
        return {"cx": at("x0", "x1", self.x0), "cy": at("y0", "y1", self.y0)}

    @staticmethod
    def counted(placed: DataFrame) -> DataFrame:
        box = G.named(x0=F.min("box.x0"), y0=F.min("box.y0"), x1=F.max("box.x1"), y1=F.max("box.y1"))
        return placed.groupBy("l", "cx", "cy").agg(F.count("*").alias("n"), box.alias("box"), F.min("sign").alias("low"), F.max("sign").alias("high"))


#: The least and greatest distance of the boxes box and nbox.
_GAP = "hypot(greatest(0D, box.x0 - nbox.x1, nbox.x0 - box.x1), greatest(0D, box.y0 - nbox.y1, nbox.y0 - box.y1))"
_SPAN = "hypot(greatest(box.x1 - nbox.x0, nbox.x1 - box.x0), greatest(box.y1 - nbox.y0, nbox.y1 - box.y0))"


def _dealt(df: DataFrame, rows: int, *by: str) -> DataFrame:
    """df, dealt out by columns to tasks of about TASK of its rows if there are many: rows repeat much, so their size when
    packed, by which Spark puts tasks together, says little of what sorting them takes."""
    return df.repartition(ceil(rows / TASK), *by) if rows > MANY else df


def _searched(asked: DataFrame, rows: int, tree: _Tree, dots: bool) -> DataFrame:
    """(sign, d): the least distance of asked (sign, s, l, cx, cy), about so many rows, from segments in their leaves with another sign."""
    held = tree.leaves.select("l", "cx", "cy", F.col("sign").alias("other"), F.col("s").alias("t"))
    cell = ["l", "cx", "cy"]
    met = _dealt(asked.select("sign", "s", *cell), rows, *cell).hint("merge").join(_dealt(held, rows, *cell), cell).filter(F.col("other") != F.col("sign"))
    return met.groupBy("sign").agg(F.min(F.expr("hypot(s.a.x - t.a.x, s.a.y - t.a.y)") if dots else segment_distance("s", "t")).alias("d"))


def _descend(probes: DataFrame, tree: _Tree, dots: bool) -> DataFrame:
    """(sign, d): the distance of each probe (sign, s, box) from the nearest segment with another sign; dots: all are points."""
    # Bounds are doubles; a hair keeps what rounding would leave out.
    near = F.col("lower") <= F.col("best") * (1 + 1e-12) + F.lit(tree.hair)
    least = lambda c: F.min(c).over(Window.partitionBy("sign"))
    probes = materialize(probes, "probes")
    rows = probes.count()
    own = probes.withColumn("l", F.explode(F.array(*map(F.lit, tree.ends)))).withColumns(tree.cell(F.col("l")))
    own = materialize(_searched(own, rows * len(tree.ends), tree, dots), "own")
    asked = _dealt(probes, rows, "sign").hint("merge").join(_dealt(own, rows, "sign"), "sign", "left")
    asked = asked.select("sign", "s", "box", *(F.lit(0).cast("long").alias(c) for c in ("cx", "cy")), F.coalesce("d", F.lit(float("inf"))).alias("best"))
    leaves, ended = [], 0
    for level in range(1, tree.depth + 1):
        below = tree.nodes.filter(F.col("l") == level).select(F.floor(F.col("cx") / SPLIT).alias("ux"), F.floor(F.col("cy") / SPLIT).alias("uy"), "cx", "cy", F.col("box").alias("nbox"), "low", "high", "leaf")
        asked = asked.withColumnsRenamed({"cx": "ux", "cy": "uy"})
        if level <= SENT:
            met = asked.join(F.broadcast(below), ["ux", "uy"])
        else:
            met = _dealt(asked, rows, "ux", "uy").hint("merge").join(_dealt(below, rows, "ux", "uy"), ["ux", "uy"])
        # Only nodes with somebody else in them count.
        met = met.filter((F.col("low") != F.col("high")) | (F.col("low") != F.col("sign")))
        met = met.withColumns({"lower": F.expr(_GAP), "upper": F.expr(f"least(best, {_SPAN})")})
        # What the level above rules out is not shuffled, and what this one rules out is not written.
        met = _dealt(met.filter(near).select("sign", "s", "box", "cx", "cy", "leaf", "lower", "upper"), rows * SPLIT, "sign")
        met = met.withColumn("best", least("upper")).filter(near).drop("upper").withColumnRenamed("best", "upper")
        met = materialize(met, "met")
        leaves.append(met.filter("leaf").select("sign", "s", F.lit(level).alias("l"), "cx", "cy", "lower", F.col("upper").alias("best")))
        asked = met.filter("NOT leaf").select("sign", "s", "box", "cx", "cy", F.col("upper").alias("best"))
        more, rows = met.agg(F.count_if("leaf"), F.count_if(~F.col("leaf"))).first()
        ended += more
        if not rows:
            break
    all_ = leaves[0]
    for x in leaves[1:]:
        all_ = all_.union(x)
    if len(leaves) > 1:  # the last bound is the least
        all_ = _dealt(all_, ended, "sign").withColumn("best", least("best")).filter(near)
    return _searched(all_, ended, tree, dots).union(own).groupBy("sign").agg(F.min("d").alias("d"))


def nearest_distance(probes: DataFrame, targets: DataFrame, key: str, start: float, output_field: str = "distance", leaf: int = LEAF) -> DataFrame:
    """probes (unique in key) with the distance to the nearest target of another shape; null without one, or without a geometry.

    Points, lines and polygons, single or in parts; a polygon has its inside, so what lies in it or meets it is at distance
    0. A target with the same shape as the probe doesn't count. Repeated shapes are searched once. start: about the usual
    distance; longer segments count as several stretches in the tree.
    """
    need(probes, key)
    b = G.bbox(F.col("geometry"))
    size = F.avg(F.when(F.col("geometry.dim") == 2, b["xmax"] - b["xmin"] + b["ymax"] - b["ymin"]))
    both = probes.select("geometry", F.lit("asked").alias("side")).union(targets.select("geometry", F.lit("there").alias("side")))
    facts = both.groupBy("side").agg(F.max("geometry.dim"), size, F.count("*")).collect()  # two rows
    sizes, rows = {r[0]: r[2] for r in facts}, {r[0]: r[3] for r in facts}
    shapes = lambda df, side: _dealt(known(df.select("geometry")), rows.get(side, 0), "sign").groupBy("sign").agg(F.first("geometry").alias("geometry"))
    asked, there = shapes(probes, "asked"), shapes(targets, "there")
    tree = _Tree(there, start, leaf)
    if tree.empty:
        return probes.withColumn(output_field, F.lit(None).cast("double"))
    out = _descend(_parts(asked, None), tree, not any(r[1] for r in facts))
    # Where no borders meet, one point says whether a shape lies in another one.
    first = lambda df: df.select(F.col("sign").alias("p"), G.point(*(G.vertices(F.col("geometry"))[0][k] for k in "xy")).alias("geometry"))
    within = []
    for points, areas, own, size in ((asked, there, "l.p", sizes.get("there")), (there, asked, "r.sign", sizes.get("asked"))):
        if size is not None:
            inside = G.covers_point(F.col("r.geometry"), G.px(F.col("l.geometry")), G.py(F.col("l.geometry")))
            met = some(first(points), areas.filter("geometry.dim = 2"), max(start, size), inside & (F.col("l.p") != F.col("r.sign")), own[0])
            within.append(met.select(F.col(own).alias("sign"), F.lit(0.0).alias("d")))
    for w in within:
        out = out.union(w)
    if within:
        out = out.groupBy("sign").agg(F.min("d").alias("d"))
    of = known(probes.select(F.col(key).alias("__k"), "geometry")).select("__k", "sign").join(out, "sign").select("__k", F.col("d").alias("__d"))
    keep = [c for c in probes.columns if c != output_field]
    return probes.join(of, probes[key] == F.col("__k"), "left").select(*keep, F.col("__d").alias(output_field))
