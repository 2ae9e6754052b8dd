"""Spatial operators: measures, spatial joins on a grid, zone aggregation, hexagons.

A theta join of geometries becomes an equi-join: each side is put into the grid cells that its bounding box touches, and
a pair is judged only in the cell that has the lower left corner of the two boxes' overlap, so no pair appears twice
and no distinct is needed. Choose a cell about as large as the larger side's usual geometry,
or several sizes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from geoloom.functions import geometry as G
from geoloom.functions.keys import column_name, finite
from geoloom.operators.attributes import need
from geoloom.plans.stages import materialize

AREA_UNITS = {"m2": 1.0, "ha": 1e4, "km2": 1e6}
LENGTH_UNITS = {"m": 1.0, "km": 1e3}


def area(df: DataFrame, unit: str = "m2", output_field: str | None = None, decimals: int | None = None) -> DataFrame:
    value = G.area(F.col("geometry")) / AREA_UNITS[unit]
    return df.withColumn(output_field or f"area_{unit}", value if decimals is None else F.bround(value, decimals))


def length(df: DataFrame, unit: str = "m", output_field: str | None = None, decimals: int | None = None) -> DataFrame:
    value = G.length(F.col("geometry")) / LENGTH_UNITS[unit]
    return df.withColumn(output_field or f"length_{unit}", value if decimals is None else F.bround(value, decimals))


def buffer_points(df: DataFrame, radius_km: float) -> DataFrame:
    """Points become polygons of 64 corners."""
    g = F.col("geometry")
    return df.withColumn("geometry", G.circle(G.px(g), G.py(g), radius_km * 1000))


def homogenize_geometry(df: DataFrame) -> DataFrame:
    """Only the rows of the highest dimension that there is."""
    top = df.agg(F.max("geometry.dim").alias("__top"))
    return df.join(F.broadcast(top), F.col("geometry.dim") == F.col("__top"), "left_semi")


def _cells(df: DataFrame, cell: float, prefix: str, reach: float = 0.0) -> DataFrame:
    """Rows once for each cell (cx, cy) that the bounding box, widened by reach, touches."""
    b = G.bbox(F.col("geometry"))
    df = df.withColumn(f"{prefix}b", b).filter(F.col(f"{prefix}b.xmin").isNotNull())
    span = lambda lo, hi: F.sequence(F.floor((F.col(f"{prefix}b.{lo}") - reach) / cell).cast("long"), F.floor((F.col(f"{prefix}b.{hi}") + reach) / cell).cast("long"))
    return df.withColumn("cx", F.explode(span("xmin", "xmax"))).withColumn("cy", F.explode(span("ymin", "ymax")))


def _placed(df: DataFrame, sizes: Sequence[float], prefix: str) -> DataFrame:
    """Rows (row, box, own) once for each cell (at, cx, cy) that they touch in the grid of their size and in those of larger
    sizes: own is the first of the sizes that the box does not exceed, or the last."""
    b = f"{prefix}b"
    rows = df.select(F.struct(*df.columns).alias(prefix), G.bbox(F.col("geometry")).alias(b)).filter(F.col(f"{b}.xmin").isNotNull())
    side = F.greatest(F.col(f"{b}.xmax") - F.col(f"{b}.xmin"), F.col(f"{b}.ymax") - F.col(f"{b}.ymin"))
    own = F.coalesce(*[F.when(side <= size, F.lit(i)) for i, size in enumerate(sizes)], F.lit(len(sizes) - 1))
    rows = rows.withColumn(f"{prefix}_own", own).withColumn("at", F.explode(F.sequence(f"{prefix}_own", F.lit(len(sizes) - 1))))
    size = F.array(*map(F.lit, sizes))[F.col("at")]
    for k in "xy":
        rows = rows.withColumn(f"c{k}", F.explode(F.sequence(*[F.floor(F.col(f"{b}.{k}{end}") / size).cast("long") for end in ("min", "max")])))
    return rows


def pairs(left: DataFrame, right: DataFrame, cell: float | Sequence[float], test: Column) -> DataFrame:
    """(l, r): rows of both whose boxes overlap and for which test, on l.geometry and r.geometry, holds.

    Several sizes of cells, for layers of very uneven shapes: two rows meet in the grid of the larger one's size, so that a
    large shape lies in few cells, and small ones meet each other in small cells only.
    """
    sizes = [float(cell)] if isinstance(cell, int | float) else sorted(map(float, cell))
    if len(sizes) == 1:
        rows = lambda df, k: _cells(df, sizes[0], k).select(F.struct(*df.columns).alias(k), f"{k}b", "cx", "cy")
        size, met = F.lit(sizes[0]), rows(left, "l").join(rows(right, "r"), ["cx", "cy"])
    else:
        a, b = _placed(left, sizes, "l"), _placed(right, sizes, "r")
        size, on = F.array(*map(F.lit, sizes))[F.col("at")], ["at", "cx", "cy"]
        met = a.filter("l_own = at").join(b, on).unionByName(a.filter("l_own < at").join(b.filter("r_own = at"), on))
    low = lambda k: F.greatest(F.col(f"lb.{k}min"), F.col(f"rb.{k}min"))
    high = lambda k: F.least(F.col(f"lb.{k}max"), F.col(f"rb.{k}max"))
    here = (F.floor(low("x") / size) == F.col("cx")) & (F.floor(low("y") / size) == F.col("cy"))
    overlap = (low("x") <= high("x")) & (low("y") <= high("y"))
    return met.filter(here & overlap & test).select("l", "r")


def some(left: DataFrame, right: DataFrame, cell: float, test: Column, keep: str) -> DataFrame:
    """The rows of one side (l or r, which keep names) that have a pair in pairs(), perhaps repeated: the search of a cell ends
    with the first."""
    rows = lambda df, k: _cells(df, cell, k).select(F.struct(*df.columns).alias(k), f"{k}b", "cx", "cy")
    a, b = (rows(left, "l"), rows(right, "r")) if keep == "l" else (rows(right, "r"), rows(left, "l"))
    a, b = a.alias("own"), b.alias("other")
    same = [F.col(f"own.{c}") == F.col(f"other.{c}") for c in ("cx", "cy")]
    apart = [F.col(f"lb.{k}max") < F.col(f"rb.{k}min") for k in "xy"] + [F.col(f"rb.{k}max") < F.col(f"lb.{k}min") for k in "xy"]
    return a.join(b, reduce(lambda p, q: p & q, [*same, *[~x for x in apart], test]), "left_semi").select(keep)


def _test(predicate: str) -> Column:
    return G.PREDICATES[predicate](F.col("l.geometry"), F.col("r.geometry"))


def spatial_join(left: DataFrame, right: DataFrame, key: str, predicate: str = "intersects", cell: float | Sequence[float] = 1000.0) -> DataFrame:
    """left (unique in key) with each right row it meets, or nulls; clashing names get _left and _right; no right geometry."""
    need(left, key)
    clash = (set(left.columns) & set(right.columns)) - {"geometry"}
    right_names = {c: f"{c}_right" if c in clash else c for c in right.columns if c != "geometry"}
    met = pairs(left, right, cell, _test(predicate)).select(F.col(f"l.{key}").alias("__k"), "r")
    out = left.join(met, left[key] == F.col("__k"), "left")
    return out.select(*[F.col(c).alias(f"{c}_left" if c in clash else c) for c in left.columns], *[F.col(f"r.{c}").alias(n) for c, n in right_names.items()])


def aggregate(zones: DataFrame, features: DataFrame, key: str, statistic: str = "count", value_field: str | None = None, group_by: str | None = None, predicate: str = "intersects", cell: float | Sequence[float] = 1000.0) -> DataFrame:
    """zones (unique in key) with count, sum or mean of the features in them; group_by gives a count for each value."""
    need(zones, key)
    test = G.PREDICATES[predicate](F.col("r.geometry"), F.col("l.geometry"))
    if not group_by and predicate == "intersects" and not isinstance(cell, int | float) and len(cell) > 1:
        return _aggregate_by_cells(zones, features, key, statistic, value_field, sorted(map(float, cell)), test)
    met = pairs(zones, features, cell, test)
    if group_by:
        values = sorted(r[0] for r in features.select(group_by).distinct().filter(F.col(group_by).isNotNull()).collect())
        aggs = [F.count_if(F.col(f"r.{group_by}") == v).alias(f"count_{column_name(str(v))}") for v in values]
        fill = {f"count_{column_name(str(v))}": 0 for v in values}
    else:
        v = finite(F.col(f"r.{value_field}")) if value_field else None
        name = statistic
        aggs = [{"count": lambda: F.count("*"), "sum": lambda: F.sum(v), "mean": lambda: F.avg(v)}[statistic]().alias(name)]
        fill = {"count": {name: 0}, "sum": {name: 0.0}, "mean": {}}[statistic]
    by_zone = met.groupBy(F.col(f"l.{key}").alias("__k")).agg(*aggs)
    out = zones.join(by_zone, zones[key] == F.col("__k"), "left").drop("__k")
    return out.fillna(fill) if fill else out


#: Cells of the finest grid of _aggregate_by_cells() along the smallest cell that is asked for, at most, and levels at most.
FINER, LEVELS = 8, 16


def _cut_cells(batches: Iterator[pa.RecordBatch], widths: Sequence[float]) -> Iterator[pa.RecordBatch]:
    """Cells (k, geometry, whole, l, cx, cy) of polygons (k, geometry): whole ones, without the geometry, and the finest ones
    that a border meets. Level l has cells of widths[l], half of those above."""
    steps = np.array([(0, 0), (0, 1), (1, 0), (1, 1)])

    def cut(parts: list) -> Iterator[tuple[bool, int, np.ndarray]]:
        rings = [np.array([(v["x"], v["y"]) for v in ring]) for part in parts for ring in part if len(ring) > 1]
        if not rings:
            return
        p, q = np.concatenate([r[:-1] for r in rings]), np.concatenate([r[1:] for r in rings])
        low, high = np.minimum(p, q), np.maximum(p, q)
        side = (high.max(0) - low.min(0)).max()
        level = next((i for i, w in enumerate(widths) if side >= w), len(widths) - 1)
        (x0, y0), (x1, y1) = (np.floor(v / widths[level]).astype(np.int64) for v in (low.min(0), high.max(0)))
        cells = np.stack(np.meshgrid(np.arange(x0, x1 + 1), np.arange(y0, y1 + 1), indexing="ij"), -1).reshape(-1, 2)
        for at in range(level, len(widths)):
            border, inside = np.zeros(len(cells), bool), np.zeros(len(cells), bool)
            several = max(1, 1_000_000 // len(p))
            for i in range(0, len(cells), several):
                c = cells[i : i + several, None, :]
                # A hair wider, so that rounding takes no cell for free of borders.
                a, b = (c - 1e-6) * widths[at], (c + 1 + 1e-6) * widths[at]
                near = ((high >= a) & (low <= b)).all(-1)
                over = [(q[:, 0] - p[:, 0]) * (y[..., 1] - p[:, 1]) - (q[:, 1] - p[:, 1]) * (x[..., 0] - p[:, 0]) for x in (a, b) for y in (a, b)]
                border[i : i + several] = (near & (np.minimum.reduce(over) <= 0) & (np.maximum.reduce(over) >= 0)).any(1)
                m = (c + 0.5) * widths[at]
                spans = (p[:, 1] > m[..., 1]) != (q[:, 1] > m[..., 1])
                with np.errstate(divide="ignore", invalid="ignore"):
                    right = m[..., 0] < (q[:, 0] - p[:, 0]) * (m[..., 1] - p[:, 1]) / (q[:, 1] - p[:, 1]) + p[:, 0]
                inside[i : i + several] = (spans & right).sum(1) % 2 == 1
            yield True, at, cells[~border & inside]
            cells = cells[border]
            if at + 1 < len(widths):
                cells = (2 * cells[:, None, :] + steps).reshape(-1, 2)
        yield False, len(widths) - 1, cells

    for b in batches:
        held, n = [], 0
        for i in range(b.num_rows):
            parts = b.column("geometry")[i].as_py()["parts"] or []
            for x in cut(parts):
                held.append((i, *x))
                n += len(x[2])
            if n and (n > 100_000 or i == b.num_rows - 1):
                row = np.concatenate([np.full(len(c), i) for i, _, _, c in held])
                full = np.concatenate([np.full(len(c), w) for _, w, _, c in held])
                level = np.concatenate([np.full(len(c), at, np.int32) for _, _, at, c in held])
                cells = np.concatenate([c for *_, c in held])
                shapes = b.column("geometry").take(pa.array(row, mask=full))
                yield pa.RecordBatch.from_arrays([b.column("k").take(pa.array(row)), shapes, *map(pa.array, (full, level, cells[:, 0], cells[:, 1]))], ["k", "geometry", "whole", "l", "cx", "cy"])
                held, n = [], 0


def _aggregate_by_cells(zones: DataFrame, features: DataFrame, key: str, statistic: str, value_field: str | None, sizes: Sequence[float], test: Column) -> DataFrame:
    """aggregate() without pairs of a zone and the points deep in it, for zones that hold very many.

    A zone of polygons is cut into cells, each half as wide as those of the level above, until no border meets a cell: a
    whole one adds what its points add up to, a cell outside goes. Points are looked at one by one only in the finest cells
    that a border meets. The finest cells hold about one point, but are not much finer than sizes[0]. Other zones and
    features make pairs.
    """
    v = finite(F.col(value_field)).cast("double") if value_field else F.lit(None).cast("double")
    g, x, y = F.col("geometry"), F.col("x"), F.col("y")
    single = F.coalesce((g["dim"] == 0) & (F.size(G.vertices(g)) == 1), F.lit(False))
    points = features.filter(single).select(G.px(g).alias("x"), G.py(g).alias("y"), v.alias("v")).filter("x IS NOT NULL AND y IS NOT NULL")
    facts = points.agg(F.count("*"), (F.max("x") - F.min("x")) * (F.max("y") - F.min("y"))).first()
    fine = max(sizes[0] / FINER, math.sqrt((facts[1] or 0.0) / max(1, facts[0])))
    last = min(LEVELS, max(0, math.ceil(math.log2(sizes[-1] / fine))))
    widths = [sizes[-1] / 2**i for i in range(last + 1)]
    width = lambda level: F.array(*map(F.lit, widths))[level]
    at = lambda c, level: F.floor(c / width(level)).cast("long")

    whole_zones = F.coalesce(g["dim"] == 2, F.lit(False))
    rows = zones.filter(whole_zones).select(F.col(key).alias("k"), "geometry")
    # A large zone's cells are the work, so few rows go to many tasks.
    rows = rows.repartition(int(zones.sparkSession.conf.get("spark.sql.shuffle.partitions")), "k")
    made = StructType([rows.schema["k"], StructField("geometry", rows.schema["geometry"].dataType), *StructType.fromDDL("whole boolean, l int, cx long, cy long")])
    rows = materialize(rows.mapInArrow(lambda batches: _cut_cells(batches, widths), made), "cells")
    whole = rows.filter("whole").select("k", "l", "cx", "cy")

    sums = [F.count("*").alias("n"), F.sum("v").alias("s"), F.count("v").alias("m")]
    cells = points.withColumn("l", F.explode(F.sequence(F.lit(0), F.lit(last)))).groupBy("l", at(x, F.col("l")).alias("cx"), at(y, F.col("l")).alias("cy")).agg(*sums)
    place = points.select("x", "y", "v", at(x, F.lit(last)).alias("cx"), at(y, F.lit(last)).alias("cy"))
    at_border = rows.filter("NOT whole").drop("l", "whole").join(place, ["cx", "cy"]).filter(G.covers_point(g, x, y))
    parts = [whole.join(cells, ["l", "cx", "cy"]).select("k", "n", "s", "m"), at_border.groupBy("k").agg(*sums)]
    rv = finite(F.col(f"r.{value_field}")).cast("double") if value_field else F.lit(None).cast("double")
    for some_zones, others in ((zones.filter(whole_zones), features.filter(~single)), (zones.filter(~whole_zones), features)):
        if not (some_zones.isEmpty() or others.isEmpty()):
            rest = pairs(some_zones, others, sizes, test).select(F.col(f"l.{key}").alias("k"), rv.alias("v"))
            parts.append(rest.groupBy("k").agg(*sums))
    total = reduce(DataFrame.union, parts).groupBy(F.col("k").alias("__k")).agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("m").alias("m"))
    value = {"count": F.col("n"), "sum": F.col("s"), "mean": F.try_divide("s", "m")}[statistic].alias(statistic)
    joined = zones.join(total.select("__k", value), zones[key] == F.col("__k"), "left").drop("__k")
    fill = {"count": {statistic: 0}, "sum": {statistic: 0.0}, "mean": {}}[statistic]
    return joined.fillna(fill) if fill else joined


def _hex_axes(width: float) -> tuple[float, float]:
    """Circumradius and row height of pointy-top hexagons of this flat-to-flat width."""
    radius = width / math.sqrt(3)
    return radius, 1.5 * radius


def hex_of(x: Column, y: Column, width: float) -> Column:
    """struct(q, r): the axial cell of a point, by cube rounding."""
    radius, _ = _hex_axes(width)
    q, r = (math.sqrt(3) / 3 * x - y / 3) / radius, (2.0 / 3 * y) / radius
    s = -q - r
    rq, rr, rs = F.rint(q), F.rint(r), F.rint(s)
    dq, dr, ds = F.abs(rq - q), F.abs(rr - r), F.abs(rs - s)
    fix_q = (dq > dr) & (dq > ds)
    return F.struct(F.when(fix_q, -rr - rs).otherwise(rq).cast("long").alias("q"), F.when(~fix_q & (dr > ds), -rq - rs).otherwise(rr).cast("long").alias("r"))


def hex_polygon(q: Column, r: Column, width: float) -> Column:
    radius, _ = _hex_axes(width)
    x, y = radius * math.sqrt(3) * (q + r / 2), radius * 1.5 * r
    corners = [G.xy(x + radius * math.cos(math.radians(60 * i - 30)), y + radius * math.sin(math.radians(60 * i - 30))) for i in (0, 1, 2, 3, 4, 5, 0)]
    return G.polygon_of(F.array(*corners))


def hexbin(points: DataFrame, cell_km: float, min_count: int = 1) -> DataFrame:
    """q, r, count and the hexagon of each cell that has points."""
    g, width = F.col("geometry"), cell_km * 1000
    cells = points.select(hex_of(G.px(g), G.py(g), width).alias("h")).filter("h.q IS NOT NULL")
    counts = cells.groupBy("h.q", "h.r").agg(F.count("*").alias("count")).filter(F.col("count") >= min_count)
    return counts.withColumn("geometry", hex_polygon(F.col("q"), F.col("r"), width))


def hex_grid(region: DataFrame, cell_km: float) -> DataFrame:
    """q, r and the hexagon of all cells whose centre lies in one of the region's polygons or on its border."""
    width = cell_km * 1000
    radius, rise = _hex_axes(width)
    b = G.bbox(F.col("geometry"))
    rows = region.select("geometry", b.alias("b")).filter("b.xmin IS NOT NULL")
    rows = rows.withColumn("r", F.explode(F.sequence(F.floor(F.col("b.ymin") / rise).cast("long"), F.ceil(F.col("b.ymax") / rise).cast("long"))))
    first, last = (F.col(f"b.{k}") / width - F.col("r") / 2 for k in ("xmin", "xmax"))
    rows = rows.withColumn("q", F.explode(F.sequence(F.floor(first).cast("long"), F.ceil(last).cast("long"))))
    x, y = radius * math.sqrt(3) * (F.col("q") + F.col("r") / 2), rise * F.col("r")
    rows = rows.filter(G.covers_point(F.col("geometry"), x, y)).select("q", "r").distinct()
    return rows.withColumn("geometry", hex_polygon(F.col("q"), F.col("r"), width))
