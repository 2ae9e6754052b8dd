"""Density clusters without a table of neighbour pairs.

Places go into square cells of which each is narrower than eps across its diagonal. A cell with min_samples points needs no
look at its neighbours: all its places are cores, and the cores of one cell belong together. Only places of cells with fewer
points are held against the cells around them, and of those only against cells that the circle cuts; a cell that lies inside
counts as a whole. Cells, not places, are linked: two cells by the boxes of their cores, then by quarters of quarters
of those that the boxes leave open, until few enough places are left to be compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.functions import geometry as G
from geoloom.functions.keys import finite
from geoloom.plans.stages import components, materialize, numbered

#: Cells have sides of eps / WIDTH: across the diagonal 0.94 eps, and what is within eps lies at most two cells away.
WIDTH = 1.5
#: Two boxes with at most this many pairs of places are compared place by place, others are cut further.
PAIRS = 1024
#: Cuts into four by four after which boxes are compared whatever they hold: 1e-12 eps, where doubles end.
DEPTH = 20


def _boxes(cells: DataFrame, *by: str, **more: Column) -> DataFrame:
    box = {f"{v}{i}": of(v) for v in "xy" for i, of in ((0, F.min), (1, F.max))}
    return cells.groupBy(*by).agg(*[c.alias(n) for n, c in {**box, **more}.items()])


def _around(rows: DataFrame, cells: DataFrame, eps: float) -> DataFrame:
    """rows (x, y, cx, cy), once for each cell (nx, ny) around with a box that is not beyond eps; inside: all of it is within."""
    step = lambda v: F.explode(F.sequence(F.col(f"c{v}") - 2, F.col(f"c{v}") + 2))
    there = rows.withColumn("nx", step("x")).withColumn("ny", step("y"))
    met = there.join(cells.withColumnsRenamed({"cx": "nx", "cy": "ny"}), ["nx", "ny"])
    gap = F.hypot(*[F.greatest(F.col(f"{v}0") - F.col(v), F.col(v) - F.col(f"{v}1"), F.lit(0.0)) for v in "xy"])
    span = F.hypot(*[F.greatest(F.col(f"{v}1") - F.col(v), F.col(v) - F.col(f"{v}0")) for v in "xy"])
    return met.filter(gap <= eps).withColumn("inside", span <= eps).drop("x0", "x1", "y0", "y1")


def _judged(pairs: DataFrame, eps: float) -> DataFrame:
    """pairs (ia, ib, a, b) of boxes that are not beyond eps; linked: surely some of their places are within it."""
    gap = F.hypot(*[F.greatest(F.col(f"b.{v}0") - F.col(f"a.{v}1"), F.col(f"a.{v}0") - F.col(f"b.{v}1"), F.lit(0.0)) for v in "xy"])
    some = F.hypot(*[F.col(f"a.one.{v}") - F.col(f"b.one.{v}") for v in "xy"])
    span = F.hypot(*[F.greatest(F.col(f"b.{v}1") - F.col(f"a.{v}0"), F.col(f"a.{v}1") - F.col(f"b.{v}0")) for v in "xy"])
    return pairs.filter(gap <= eps).withColumn("linked", (some <= eps) | (span <= eps))


def _links(cores: DataFrame, cells: DataFrame, eps: float) -> DataFrame:
    """(a, b): ids of cells with cores within eps of each other. cores: (s, x, y, cx, cy); cells: their boxes and id."""
    node = F.struct("cx", "cy", "px", "py", "x0", "x1", "y0", "y1", "m", "one")
    at_level = lambda df, level: df.withColumns({f"p{v}": F.floor((F.col(v) / (eps / WIDTH) - F.col(f"c{v}")) * 4.0**level).cast("long") for v in "xy"})
    top = cells.withColumns({"px": F.lit(0).cast("long"), "py": F.lit(0).cast("long")})
    # Half of the 24 cells around, so that two cells meet once.
    ahead = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(3) for j in range(-2, 3) if (i, j) > (0, 0)])
    left = top.select(F.col("id").alias("ia"), node.alias("a"), F.explode(ahead).alias("o"))
    left = left.withColumn("cx", F.col("a.cx") + F.col("o.i")).withColumn("cy", F.col("a.cy") + F.col("o.j"))
    right = top.select("cx", "cy", F.col("id").alias("ib"), node.alias("b"))
    pairs = materialize(_judged(left.join(right, ["cx", "cy"]).select("ia", "ib", "a", "b"), eps), "boxes")
    found = pairs.filter("linked").select("ia", "ib")
    for level in range(DEPTH + 1):
        rest = materialize(pairs.filter("NOT linked").join(found, ["ia", "ib"], "left_anti"), "open")
        if rest.isEmpty():
            break
        few = F.lit(level == DEPTH) | (F.col("a.m") * F.col("b.m") <= PAIRS)
        places = at_level(cores, level).select("cx", "cy", "px", "py", F.struct("x", "y").alias("p"))
        of = lambda side: F.struct(*[F.col(f"{side}.{c}") for c in ("cx", "cy", "px", "py")])
        keyed = lambda name: places.select(F.struct("cx", "cy", "px", "py").alias(name), F.col("p").alias(f"{name}_p"))  # noqa: E731, B023
        close = rest.filter(few).select("ia", "ib", of("a").alias("ka"), of("b").alias("kb")).join(keyed("ka"), "ka").join(keyed("kb"), "kb")
        close = close.filter(F.hypot(F.col("ka_p.x") - F.col("kb_p.x"), F.col("ka_p.y") - F.col("kb_p.y")) <= eps)
        found = materialize(found.union(close.select("ia", "ib")).distinct(), "links")
        wide = materialize(rest.filter(~few).join(found, ["ia", "ib"], "left_anti"), "open")
        if wide.isEmpty():
            break
        cut = wide.select(F.explode(F.array(*[F.struct(F.col(f"{k}.cx").alias("cx"), F.col(f"{k}.cy").alias("cy")) for k in "ab"])).alias("c")).select("c.cx", "c.cy").distinct()
        kids = _boxes(at_level(cores.join(cut, ["cx", "cy"], "left_semi"), level + 1), "cx", "cy", "px", "py", m=F.count("*"), one=F.min_by(F.struct("x", "y"), "s"))
        up = F.struct("cx", "cy", *[F.floor(F.col(c) / 4).cast("long").alias(c) for c in ("px", "py")])
        kids = materialize(kids.select(up.alias("up"), node.alias("kid")), "quarters")
        half = lambda k: kids.select(F.col("up").alias(f"k{k}"), F.col("kid").alias(k))  # noqa: E731, B023
        below = wide.select("ia", "ib", of("a").alias("ka"), of("b").alias("kb")).join(half("a"), "ka").join(half("b"), "kb")
        pairs = materialize(_judged(below.select("ia", "ib", "a", "b"), eps), "boxes")
        found = found.union(pairs.filter("linked").select("ia", "ib"))
    return found.select(F.col("ia").alias("a"), F.col("ib").alias("b")).distinct()


def cluster(points: DataFrame, key: str, eps_m: float, min_samples: int, output_field: str = "cluster", size_field: str | None = None) -> DataFrame:
    """Density clusters (DBSCAN) of points unique in key, numbered by their smallest key; -1 is noise.

    Copies at one place are counted once with their number. A neighbour is at most eps_m away, oneself included; a border
    point goes to its nearest core (ties: the smaller key). Rows without a place, or with one that is not finite, are noise; a
    geometry that is no point is an error. A row is compared with another one only if it lies in a cell with fewer than
    min_samples points, so comparisons grow with rows x min_samples. A crowded cell is one key of those joins: adaptive
    execution splits it.
    """
    if not eps_m > 0:
        raise ValueError("eps_m must be above 0")
    g = F.col("geometry")
    is_point = F.when(g.isNull() | (g["kind"] == "Point"), g).otherwise(F.raise_error(F.lit("clusters are of points only")).cast(G.GEOMETRY))
    rows = points.select(F.col(key).alias("k"), is_point.alias("g"))
    # + 0.0: the negative zero is the zero.
    rows = rows.select("k", *[(finite(of(F.col("g"))) + 0.0).alias(v) for v, of in (("x", G.px), ("y", G.py))]).filter("x IS NOT NULL AND y IS NOT NULL")
    cell = {f"c{v}": F.floor(F.col(v) / (eps_m / WIDTH)).cast("long") for v in "xy"}
    spots = materialize(rows.groupBy("x", "y").agg(F.count("*").alias("n"), F.min("k").alias("s")).withColumns(cell), "spots")
    cells = materialize(_boxes(spots, "cx", "cy", total=F.sum("n")), "cells")
    dense = cells.filter(F.col("total") >= min_samples).select("cx", "cy")
    loose = materialize(spots.join(dense, ["cx", "cy"], "left_anti"), "loose")

    met = _around(loose.select("s", "x", "y", "cx", "cy"), cells, eps_m)
    others = spots.select(F.col("cx").alias("nx"), F.col("cy").alias("ny"), F.col("x").alias("x2"), F.col("y").alias("y2"), "n")
    away = F.hypot(F.col("x") - F.col("x2"), F.col("y") - F.col("y2"))
    near = met.filter("NOT inside").join(others, ["nx", "ny"]).filter(away <= eps_m).select("s", "n")
    count = met.filter("inside").select("s", F.col("total").alias("n")).union(near).groupBy("s").agg(F.sum("n").alias("n"))
    enough = count.filter(F.col("n") >= min_samples).select("s")
    column = ["s", "x", "y", "cx", "cy"]
    cores = materialize(spots.join(dense, ["cx", "cy"], "left_semi").select(column).union(loose.join(enough, "s", "left_semi").select(column)), "cores")

    homes = materialize(_boxes(cores, "cx", "cy", m=F.count("*"), one=F.min_by(F.struct("x", "y"), "s"), id=F.min("s")), "homes")
    roots = components(_links(cores, homes, eps_m))
    homes = materialize(homes.join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id")), "homes")
    edge = loose.select(column).join(cores.select("s"), "s", "left_anti")
    seen = cores.select(F.col("cx").alias("nx"), F.col("cy").alias("ny"), F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("s").alias("s2"))
    held = _around(edge, homes.drop("m", "one", "id"), eps_m).join(seen, ["nx", "ny"]).filter(away <= eps_m)
    border = held.groupBy("s").agg(F.min_by("root", F.struct(away.alias("d"), "s2")).alias("root"))
    of_spot = cores.join(homes.select("cx", "cy", "root"), ["cx", "cy"]).select("s", "root").union(border)

    named = materialize(rows.join(spots.select("x", "y", "s"), ["x", "y"]).join(of_spot, "s").select("k", "root"), "labels")
    sizes = named.groupBy("root").agg(F.min("k").alias("low"), F.count("*").alias("__size"))
    labels = named.join(numbered(sizes, "low", "__id").drop("low"), "root").select(F.col("k").alias("__k"), "__id", "__size")
    out = points.join(labels, points[key] == F.col("__k"), "left").withColumn(output_field, F.coalesce("__id", F.lit(-1).cast("long")))
    if size_field:
        out = out.withColumn(size_field, F.coalesce("__size", F.lit(0).cast("long")))
    return out.drop("__k", "__id", "__size")
