"""Raster operators on cell tables: one row for each cell (row, col) and a column for each band; nodata is null.

A grid says where cell (0, 0) has its upper left corner and how large cells are. Rows grow downwards.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.functions import geometry as G
from geoloom.functions.keys import finite

#: Cells of a tile's side in zone joins.
TILE = 64
MAX_CELLS = 250_000_000


@dataclass(frozen=True)
class Grid:
    """x0, y0: the upper left corner; cell: the side; rows, cols."""

    x0: float
    y0: float
    cell: float
    rows: int
    cols: int

    def x(self, col: Column) -> Column:
        """The centre's x."""
        return F.lit(self.x0) + (col + 0.5) * self.cell

    def y(self, row: Column) -> Column:
        return F.lit(self.y0) - (row + 0.5) * self.cell

    def col_of(self, x: Column) -> Column:
        return F.floor((x - self.x0) / self.cell).cast("long")

    def row_of(self, y: Column) -> Column:
        return F.floor((self.y0 - y) / self.cell).cast("long")

    def cells(self, spark: SparkSession) -> DataFrame:
        ids = spark.range(self.rows * self.cols)
        return ids.select(F.floor(F.col("id") / self.cols).alias("row"), (F.col("id") % self.cols).alias("col"))


def raster_calc(cells: DataFrame, value: str | Column, bands: Sequence[str], output_band: str = "result", compared: Sequence[str | Column] = ()) -> DataFrame:
    """One band from an expression over bands: null where a band, a compared operand or the result is not finite.

    Booleans become 0 and 1.
    """
    as_column = lambda v: F.expr(v) if isinstance(v, str) else v
    out = finite(as_column(value))
    for c in [*map(F.col, bands), *map(as_column, compared)]:
        out = F.when(finite(c).isNotNull(), out)
    return cells.select("row", "col", out.alias(output_band))


def raster_classify(cells: DataFrame, band: str, breaks: Sequence[float], values: Sequence[float], output_band: str = "class") -> DataFrame:
    """The value of the interval (closed on the left) that a cell is in."""
    v = finite(F.col(band))
    out = F.when(v.isNull(), None)
    for b, new in zip(breaks, values, strict=False):
        out = out.when(v < b, F.lit(float(new)))
    return cells.select("row", "col", out.otherwise(F.lit(float(values[-1]))).alias(output_band))


def block_aggregate(cells: DataFrame, band: str, rows: int, cols: int, how: str = "sum") -> DataFrame:
    """Blocks of rows x cols cells as one cell, by sum or mean of the cells that have a value."""
    f = {"sum": F.sum, "mean": F.avg}[how]
    return cells.groupBy(F.floor(F.col("row") / rows).alias("row"), F.floor(F.col("col") / cols).alias("col")).agg(f(band).alias(band))


def warp(cells: DataFrame, band: str, source: Grid, target: Grid, to_source_x: Column, to_source_y: Column, how: str = "nearest") -> DataFrame:
    """The band on another grid; to_source_*: expressions over x and y of a target cell's centre."""
    want = target.cells(cells.sparkSession).withColumn("x", target.x(F.col("col"))).withColumn("y", target.y(F.col("row")))
    want = want.select("row", "col", ((to_source_x - source.x0) / source.cell - 0.5).alias("u"), ((source.y0 - to_source_y) / source.cell - 0.5).alias("v"))
    have = cells.select(F.col("row").alias("sr"), F.col("col").alias("sc"), F.col(band).alias("z"))
    if how == "nearest":
        want = want.withColumn("sr", F.floor(F.col("v") + 0.5).cast("long")).withColumn("sc", F.floor(F.col("u") + 0.5).cast("long"))
        return want.join(have, ["sr", "sc"], "left").select("row", "col", F.col("z").alias(band))
    corner = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)]))
    want = want.withColumn("c", corner).withColumn("sr", F.floor("v").cast("long") + F.col("c.i")).withColumn("sc", F.floor("u").cast("long") + F.col("c.j"))
    share = (1 - F.abs(F.col("v") - F.col("sr"))) * (1 - F.abs(F.col("u") - F.col("sc")))
    met = want.join(have, ["sr", "sc"], "left").withColumn("w", F.when(F.col("z").isNotNull(), share))
    return met.groupBy("row", "col").agg(F.try_divide(F.sum(F.col("w") * F.col("z")), F.sum("w")).alias(band))


def grid_of(df: DataFrame, cell: float) -> Grid | None:
    """The grid of the layer's extent, widened to multiples of the cell; points and lines on its right or lower border get
    one more cell. None for an empty layer.
    """
    b = G.bbox(F.col("geometry"))
    flat = F.col("geometry.dim") < 2
    ends = df.select(b.alias("b"), flat.alias("flat")).agg(
        F.min("b.xmin"), F.min("b.ymin"), F.max("b.xmax"), F.max("b.ymax"), F.max(F.when(F.col("flat"), F.col("b.xmax"))), F.min(F.when(F.col("flat"), F.col("b.ymin")))
    ).first()
    if ends[0] is None:
        return None
    x0, y0 = math.floor(ends[0] / cell), math.ceil(ends[3] / cell)
    cols, rows = max(1, math.ceil(ends[2] / cell) - x0), max(1, y0 - math.floor(ends[1] / cell))
    cols += ends[4] is not None and ends[4] >= (x0 + cols) * cell
    rows += ends[5] is not None and ends[5] <= (y0 - rows) * cell
    return Grid(x0 * cell, y0 * cell, cell, rows, cols)


def _on_line(rows: DataFrame, grid: Grid) -> DataFrame:
    """rows once for each cell of the thin lines along their rings: one cell a step of the longer axis, as Bresenham draws."""
    seg = rows.withColumn("__s", F.explode(F.flatten(F.transform(G.rings(F.col("geometry")), G.segments))))
    cell = lambda end: (grid.row_of(F.col(f"__s.{end}.y")), grid.col_of(F.col(f"__s.{end}.x")))
    (r0, c0), (r1, c1) = cell("a"), cell("b")
    seg = seg.select(*rows.columns, r0.alias("__r"), c0.alias("__c"), (r1 - r0).alias("__dr"), (c1 - c0).alias("__dc"))
    seg = seg.withColumn("__n", F.greatest(F.abs("__dr"), F.abs("__dc"))).withColumn("__i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n"))))
    minor = F.ceil((F.col("__i") * F.least(F.abs("__dr"), F.abs("__dc")) - F.floor(F.col("__n") / 2)) / F.greatest(F.col("__n"), F.lit(1)))
    minor = F.greatest(minor, F.lit(0))
    flat = F.abs("__dc") >= F.abs("__dr")
    move = lambda d, longer: F.signum(F.col(d)).cast("long") * F.when(longer, F.col("__i")).otherwise(minor)
    return seg.withColumn("row", F.col("__r") + move("__dr", ~flat)).withColumn("col", F.col("__c") + move("__dc", flat)).select(*rows.columns, "row", "col")


def _touched(rows: DataFrame, grid: Grid) -> DataFrame:
    """rows once for each cell that a segment of their rings passes through; a cell has its left and its upper border."""
    seg = rows.withColumn("__s", F.explode(F.flatten(F.transform(G.rings(F.col("geometry")), G.segments))))
    at = lambda end: ((F.col(f"__s.{end}.x") - grid.x0) / grid.cell, (grid.y0 - F.col(f"__s.{end}.y")) / grid.cell)
    (ax, ay), (bx, by) = at("a"), at("b")
    seg = seg.select(*rows.columns, F.when(ax <= bx, ax).otherwise(bx).alias("__x0"), F.when(ax <= bx, ay).otherwise(by).alias("__y0"), F.when(ax <= bx, bx).otherwise(ax).alias("__x1"), F.when(ax <= bx, by).otherwise(ay).alias("__y1"))
    whole = lambda c: F.floor(c).cast("long")
    seg = seg.withColumn("col", F.explode(F.sequence(whole(F.col("__x0")), whole(F.col("__x1")))))
    slope = F.try_divide(F.col("__y1") - F.col("__y0"), F.col("__x1") - F.col("__x0"))
    y_at = lambda x: F.coalesce(F.col("__y0") + slope * (x - F.col("__x0")), F.col("__y0"))
    first = y_at(F.greatest(F.col("__x0"), F.col("col").cast("double")))
    last = F.when(slope.isNull(), F.col("__y1")).otherwise(y_at(F.least(F.col("__x1"), F.col("col") + 1.0)))
    return seg.withColumn("row", F.explode(F.sequence(whole(F.least(first, last)), whole(F.greatest(first, last))))).select(*rows.columns, "row", "col")


def rasterize(df: DataFrame, grid: Grid, order: Sequence[str], value_field: str | None = None, fill: float | None = None, *, all_touched: bool = False) -> DataFrame:
    """(row, col, value) of all cells of the grid that the objects burn: those whose centre a polygon covers, that a point
    is in, or that a line steps through. all_touched: all cells that lines and the borders of polygons pass through.

    The later object by order wins; value 1 without value_field; fill is the value of all other cells.
    """
    if grid.rows * grid.cols > MAX_CELLS:
        raise ValueError(f"more than {MAX_CELLS} cells")
    b = G.bbox(F.col("geometry"))
    rows = df.withColumn("__b", b).filter("__b.xmin IS NOT NULL")
    clip = lambda c, n: F.least(F.greatest(c, F.lit(0)), F.lit(n - 1))
    inside = (F.col("__b.xmax") >= grid.x0) & (F.col("__b.xmin") <= grid.x0 + grid.cell * grid.cols) & (F.col("__b.ymin") <= grid.y0) & (F.col("__b.ymax") >= grid.y0 - grid.cell * grid.rows)
    value = F.col(value_field).cast("double") if value_field else F.lit(1.0)
    rows = rows.filter(inside).select("geometry", "__b", value.alias("__v"), F.struct(*order).alias("__o"))
    points = rows.filter("geometry.dim = 0").withColumn("__p", F.explode(G.vertices(F.col("geometry"))))
    burnt = points.select("__v", "__o", grid.row_of(F.col("__p.y")).alias("row"), grid.col_of(F.col("__p.x")).alias("col"))
    area = rows.filter("geometry.dim = 2")
    area = area.withColumn("row", F.explode(F.sequence(clip(grid.row_of(F.col("__b.ymax")), grid.rows), clip(grid.row_of(F.col("__b.ymin")), grid.rows))))
    area = area.withColumn("col", F.explode(F.sequence(clip(grid.col_of(F.col("__b.xmin")), grid.cols), clip(grid.col_of(F.col("__b.xmax")), grid.cols))))
    burnt = burnt.union(area.filter(G.covers_point(F.col("geometry"), grid.x(F.col("col")), grid.y(F.col("row")))).select("__v", "__o", "row", "col"))
    lines = _touched(rows.filter("geometry.dim > 0"), grid) if all_touched else _on_line(rows.filter("geometry.dim = 1"), grid)
    burnt = burnt.union(lines.select("__v", "__o", "row", "col")).filter((F.col("row").between(0, grid.rows - 1)) & F.col("col").between(0, grid.cols - 1))
    burnt = burnt.groupBy("row", "col").agg(F.max_by("__v", "__o").alias("value"))
    return grid.cells(df.sparkSession).join(burnt, ["row", "col"], "left").withColumn("value", F.coalesce("value", F.lit(fill).cast("double")))


STATS = ("sum", "mean", "max", "min", "count", "std", "share")


def zonal_stats(zones: DataFrame, cells: DataFrame, grid: Grid, key: str, band: str, stat: str = "sum", decimals: int | None = None, class_value: float = 1.0, output_field: str | None = None, valid_share_field: str | None = None, min_valid_share: float | None = None) -> DataFrame:
    """zones (polygons, unique in key) with a statistic of the cells whose centre is inside; null without a valid cell.

    valid_share_field takes the share of a zone's cells that have a value: of all cells whose centre is inside, those
    outside the raster too, which have none; null without such a cell. Below min_valid_share the statistic is null.
    """
    v = finite(F.col(band))
    tile = lambda c: F.floor(F.col(c) / TILE).cast("long")
    have = cells.select("row", "col", v.alias("__v")).filter("__v IS NOT NULL").withColumn("tr", tile("row")).withColumn("tc", tile("col"))
    b = G.bbox(F.col("geometry"))
    spans = zones.select(F.col(key).alias("__k"), "geometry", b.alias("b")).filter("b.xmin IS NOT NULL")
    span = lambda lo, hi: F.explode(F.sequence(F.floor(lo / TILE).cast("long"), F.floor(hi / TILE).cast("long")))
    spans = spans.withColumn("tr", span(grid.row_of(F.col("b.ymax")), grid.row_of(F.col("b.ymin")))).withColumn("tc", span(grid.col_of(F.col("b.xmin")), grid.col_of(F.col("b.xmax"))))
    x, y = grid.x(F.col("col")), grid.y(F.col("row"))
    in_box = (x >= F.col("b.xmin")) & (x <= F.col("b.xmax")) & (y >= F.col("b.ymin")) & (y <= F.col("b.ymax"))
    met = have.join(spans, ["tr", "tc"]).filter(in_box & G.interior(F.col("geometry"), x, y))
    value = {
        "sum": F.sum("__v"), "mean": F.avg("__v"), "max": F.max("__v"), "min": F.min("__v"), "count": F.count("__v").cast("double"),
        "std": F.stddev_pop("__v"), "share": F.avg((F.col("__v") == class_value).cast("double")),
    }[stat]
    decimals = (3 if stat == "share" else 0) if decimals is None else decimals
    name = output_field or f"{stat}_value"
    by_zone = met.groupBy("__k").agg(F.bround(value, decimals).alias(name), F.count("__v").alias("__n"))
    out = zones.join(by_zone, zones[key] == F.col("__k"), "left").drop("__k")
    if valid_share_field or min_valid_share is not None:
        every = zone_cells(zones, grid, key).withColumnsRenamed({"zone": "__z", "cells": "__every"})
        out = out.join(every, out[key] == F.col("__z"), "left").drop("__z")
        share = F.try_divide(F.coalesce("__n", F.lit(0)), F.col("__every"))
        if min_valid_share is not None:
            out = out.withColumn(name, F.when(share >= min_valid_share, F.col(name)))
        if valid_share_field:
            out = out.withColumn(valid_share_field, share)
    return out.drop("__n", "__every")


def zone_cells(zones: DataFrame, grid: Grid, key: str) -> DataFrame:
    """(zone, cells): how many cell centres are in each zone (polygons, unique in key), in the raster or beyond it.

    By rows of cells: between the first and second crossing of a row's middle with the border, the third and fourth, ...
    lie whole stretches of cells, which are counted and not listed.
    """
    b, y = G.bbox(F.col("geometry")), grid.y(F.col("row"))
    rows = zones.select(F.col(key).alias("zone"), "geometry", b.alias("b")).filter("b.xmin IS NOT NULL")
    rows = rows.withColumn("row", F.explode(F.sequence(grid.row_of(F.col("b.ymax")), grid.row_of(F.col("b.ymin")))))
    # The first centre at or after a crossing, by which cells are counted.
    at = lambda s: s["a"]["x"] + (y - s["a"]["y"]) / (s["b"]["y"] - s["a"]["y"]) * (s["b"]["x"] - s["a"]["x"])
    crossed = F.filter(F.flatten(F.transform(G.rings(F.col("geometry")), G.segments)), lambda s: (s["a"]["y"] > y) != (s["b"]["y"] > y))
    firsts = F.array_sort(F.transform(crossed, lambda s: F.ceil((at(s) - grid.x0) / grid.cell - 0.5)))
    signed = F.aggregate(F.transform(firsts, lambda c, i: F.when(i % 2 == 1, c).otherwise(-c)), F.lit(0).cast("long"), lambda a, v: a + v)
    return rows.groupBy("zone").agg(F.sum(signed).alias("cells"))


def warp_area(cells: DataFrame, band: str, source: Grid, target: Grid, how: str = "average") -> DataFrame:
    """The band on a target grid in the same reference system, by shares of area: average, or sum (which keeps totals).

    A source cell goes to each target cell that it overlaps, with its overlap as weight.
    """
    left, top = F.lit(source.x0) + F.col("col") * source.cell, F.lit(source.y0) - F.col("row") * source.cell
    span = lambda a, b, n: F.sequence(F.greatest(F.floor(a).cast("long"), F.lit(0)), F.least(F.ceil(b).cast("long") - 1, F.lit(n - 1)))
    a, b = (left - target.x0) / target.cell, (left + source.cell - target.x0) / target.cell
    c, d = (target.y0 - top) / target.cell, (target.y0 - top + source.cell) / target.cell
    have = cells.filter(finite(F.col(band)).isNotNull()).select(F.col(band).cast("double").alias("z"), a.alias("a"), b.alias("b"), c.alias("c"), d.alias("d"))
    have = have.filter((F.col("b") > 0) & (F.col("a") < target.cols) & (F.col("d") > 0) & (F.col("c") < target.rows))
    have = have.withColumn("col", F.explode(span(F.col("a"), F.col("b"), target.cols))).withColumn("row", F.explode(span(F.col("c"), F.col("d"), target.rows)))
    wide = F.least(F.col("b"), F.col("col") + 1) - F.greatest(F.col("a"), F.col("col"))
    high = F.least(F.col("d"), F.col("row") + 1) - F.greatest(F.col("c"), F.col("row"))
    whole = (F.col("b") - F.col("a")) * (F.col("d") - F.col("c"))
    met = have.withColumn("w", wide * high)
    value = F.sum(F.col("z") * F.col("w") / whole) if how == "sum" else F.try_divide(F.sum(F.col("z") * F.col("w")), F.sum("w"))
    return met.groupBy("row", "col").agg(value.alias(band))
