"""Boolean operators on polygons: overlay, clip, dissolve, area share, line buffers, isochrones, repair.

Candidate pairs come from the grid join of geoloom.operators.spatial. What unites many polygons, or sets them against
many, first cuts them by the cells of a grid, so that a group is what lies in one cell and never a whole layer; cells that
are crowded are cut further, and large shapes level by level. One small kernel works on a pair or a cell, by vertical slabs: the corners and crossings of all edges cut the plane into
slabs in which no two edges cross, so inside a slab each polygon is a list of intervals between edges.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from geoloom.functions import geometry as G
from geoloom.operators.spatial import _cells, pairs
from geoloom.plans.stages import components, materialize

Edges = np.ndarray  # (n, 4): x1, y1, x2, y2 with x1 < x2
EPS = 1e-9


def _edges(parts: list) -> Edges:
    """The edges of a polygon's rings that are not vertical, from left to right."""
    out = []
    for part in parts:
        for ring in part:
            p = np.array([(v["x"], v["y"]) if isinstance(v, dict) else (v[0], v[1]) for v in ring], float)
            out.append(np.hstack([p[:-1], p[1:]]))
    e = np.vstack(out) if out else np.empty((0, 4))
    e = e[e[:, 0] != e[:, 2]]
    back = e[:, 0] > e[:, 2]
    e[back] = e[back][:, [2, 3, 0, 1]]
    return e


def _cuts(e: Edges) -> np.ndarray:
    """The x of all corners and crossings."""
    xs = [e[:, 0], e[:, 2]]
    order = np.argsort(e[:, 0])
    s = e[order]
    for i in range(len(s)):
        stop = np.searchsorted(s[:, 0], s[i, 2])
        t = s[i + 1 : stop]
        if not len(t):
            continue
        slope, slopes = (s[i, 3] - s[i, 1]) / (s[i, 2] - s[i, 0]), (t[:, 3] - t[:, 1]) / (t[:, 2] - t[:, 0])
        with np.errstate(divide="ignore", invalid="ignore"):
            x = (t[:, 1] - slopes * t[:, 0] - s[i, 1] + slope * s[i, 0]) / (slope - slopes)
        ok = np.isfinite(x) & (x > np.maximum(s[i, 0], t[:, 0])) & (x < np.minimum(s[i, 2], t[:, 2]))
        xs.append(x[ok])
    x = np.unique(np.concatenate(xs)) if len(e) else np.empty(0)
    return x[np.r_[True, np.diff(x) > EPS * max(1.0, np.abs(x).max())]] if len(x) else x


def trapezoids(groups: Sequence[Sequence[list]], keep) -> list[tuple]:  # noqa: ANN001
    """(x0, x1, low at x0, low at x1, high at x0, high at x1) where keep(inside) holds.

    groups: for each of the two sides, its polygons' parts; inside[i] counts the polygons of side i that cover the place.
    """
    edges, owner = [], []
    for side, polygons in enumerate(groups):
        for k, parts in enumerate(polygons):
            e = _edges(parts)
            edges.append(e)
            owner += [(side, k)] * len(e)
    e = np.vstack(edges) if edges else np.empty((0, 4))
    xs, out = _cuts(e), []
    for x0, x1 in zip(xs, xs[1:], strict=False):
        mid = (x0 + x1) / 2
        on = np.flatnonzero((e[:, 0] <= mid) & (e[:, 2] >= mid))
        slope = (e[on, 3] - e[on, 1]) / (e[on, 2] - e[on, 0])
        at = lambda x: e[on, 1] + slope * (x - e[on, 0])  # noqa: E731, B023
        order = np.argsort(at(mid), kind="stable")
        lows, highs = at(x0)[order], at(x1)[order]
        odd: dict = {}
        inside = [0] * len(groups)
        start, was = None, False
        for j, i in enumerate(on[order]):
            side, k = owner[i]
            odd[side, k] = not odd.get((side, k), False)
            inside[side] += 1 if odd[side, k] else -1
            now = keep(inside)
            if now and not was:
                start = j
            elif was and not now:
                piece = (x0, x1, lows[start], highs[start], lows[j], highs[j])
                if piece[4] - piece[2] > EPS or piece[5] - piece[3] > EPS:
                    # Intervals that touch, as where two polygons share an edge, are one.
                    if out and out[-1][0] == x0 and abs(out[-1][4] - piece[2]) <= EPS * max(1, abs(piece[2])) and abs(out[-1][5] - piece[3]) <= EPS * max(1, abs(piece[3])):
                        piece = (x0, x1, out[-1][2], out[-1][3], piece[4], piece[5])
                        out.pop()
                    out.append(piece)
            was = now
    return out


def total_area(pieces: list[tuple]) -> float:
    return float(sum((x1 - x0) * ((c - a) + (d - b)) / 2 for x0, x1, a, b, c, d in pieces))


def polygon_parts(pieces: list[tuple]) -> list:
    """The trapezoids as parts of a MultiPolygon, neighbours with the same border lines made one."""
    parts: list = []
    open_: dict = {}
    for x0, x1, a, b, c, d in sorted(pieces):
        found = None
        for key, (ax, ay, bx, by, cy, dy) in list(open_.items()):
            if abs(bx - x0) <= EPS * max(1, abs(x0)) and abs(by - a) <= 1e-7 * max(1, abs(a)) and abs(dy - c) <= 1e-7 * max(1, abs(c)):
                w, v = bx - ax, x1 - x0
                if abs((by - ay) * v - (b - a) * w) <= 1e-6 * w * v and abs((dy - cy) * v - (d - c) * w) <= 1e-6 * w * v:
                    found = key
                    break
        if found is None:
            open_[len(parts)] = (x0, a, x1, b, c, d)
            parts.append(None)
        else:
            ax, ay, _, _, cy, _ = open_[found]
            open_[found] = (ax, ay, x1, b, cy, d)
        for key in [k for k, o in open_.items() if o[2] < x0]:
            parts[key] = open_.pop(key)
    for key, o in open_.items():
        parts[key] = o
    out = []
    for x0, a, x1, b, c, d in parts:
        ring = [(x0, a), (x1, b), (x1, d), (x0, c), (x0, a)]
        ring = [p for i, p in enumerate(ring) if i == 0 or p != ring[i - 1]]
        out.append([[{"x": float(x), "y": float(y)} for x, y in ring]])
    return out


def mapped(df: DataFrame, run: Callable, schema: str) -> DataFrame:
    """df through run, a function of pandas frames. Columns go as Python objects: rings of different lengths side by side
    are no array.
    """
    kinds = to_arrow_schema(StructType.fromDDL(schema))

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frames = (pd.DataFrame({n: pd.Series(c.to_pylist(), dtype=object) for n, c in zip(b.schema.names, b.columns, strict=True)}) for b in rows)
        for out in run(frames):
            yield pa.RecordBatch.from_arrays([pa.array(list(out[k.name]), k.type) for k in kinds], schema=kinds)

    return df.mapInArrow(batches, schema)


def multi(pieces: list[tuple]) -> dict | None:
    return {"kind": "MultiPolygon", "dim": 2, "parts": polygon_parts(pieces)} if pieces else None


RULES = {
    "intersection": lambda n: n[0] > 0 and n[1] > 0,
    "union": lambda n: n[0] > 0 or n[1] > 0,
    "difference": lambda n: n[0] > 0 and n[1] == 0,
}


def _parts(g) -> list:  # noqa: ANN001
    return [[[(v["x"], v["y"]) for v in r] for r in p] for p in g["parts"]]


#: A shape is cut by squares of which at most BLOCK x BLOCK (and a border) meet it, and the pieces by the squares in those.
BLOCK = 16
#: A cell with more pieces than this to be set against others is cut into 4 x 4, at most DEPTH times.
CROWD = 256
DEPTH = 8
#: Cells whose cuts make more than this many pieces out of one hold shapes too large for smaller cells to part.
GROWTH = 3


def _square(cx: float, cy: float, size: float) -> list:
    x0, y0, x1, y1 = cx * size, cy * size, (cx + 1) * size, (cy + 1) * size
    return [[[(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]]]


def _cut_by(rows: DataFrame, size: float) -> DataFrame:
    """(k, cx, cy, g, whole) of rows (k, geometry), cut by squares of this size; whole: the piece is the square."""
    kind = dict(rows.dtypes)["k"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            cut, whole = [], []
            for g, cx, cy in zip(f["geometry"], f["cx"], f["cy"], strict=True):
                parts, square = _parts(g), _square(cx, cy, size)
                corners = set(square[0][0])
                xs, ys = zip(*(v for p in parts for r in p for v in r), strict=True)
                (x0, y0), (x1, y1) = min(corners), max(corners)
                inside = x0 <= min(xs) and max(xs) <= x1 and y0 <= min(ys) and max(ys) <= y1
                if inside and (max(xs) - min(xs) < x1 - x0 or max(ys) - min(ys) < y1 - y0):
                    cut.append(g)
                    whole.append(False)
                    continue
                cut.append(multi(trapezoids([[parts], [square]], RULES["intersection"])))
                rings = [r for p in cut[-1]["parts"] for r in p] if cut[-1] else []
                whole.append(len(rings) == 1 and len(rings[0]) == 5 and {(v["x"], v["y"]) for v in rings[0]} == corners)
            out = f[["k", "cx", "cy"]].assign(g=cut, whole=whole)
            yield out[out["g"].notna()]

    return mapped(_cells(rows, size, "l").select("k", "cx", "cy", "geometry"), run, f"k {kind}, cx long, cy long, g {G.GEOMETRY}, whole boolean")


def _cut(df: DataFrame, key: str | None, cell: float) -> DataFrame:
    """(k, cx, cy, g, whole): the polygons of df cut by the grid's cells; pieces without area are left out.

    Large ones are cut level by level, by blocks of cells first, so that no shape is copied whole to all its cells; the
    pieces of a level are dealt out before the next one. How many levels there are is asked of the data.
    """
    rows = df.select(F.col(key).alias("k") if key else F.lit(0).alias("k"), "geometry").filter("geometry.dim = 2")
    b = G.bbox(F.col("geometry"))
    side = rows.agg(F.max(F.greatest(b["xmax"] - b["xmin"], b["ymax"] - b["ymin"]))).first()[0] or 0.0
    if not math.isfinite(side):
        raise ValueError("a polygon has a corner that is not finite")
    tasks, size = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), cell
    while side > size * BLOCK:
        size *= BLOCK
    while size > cell:
        rows = _cut_by(rows, size).select("k", F.col("g").alias("geometry")).repartition(tasks)
        size /= BLOCK
    return _cut_by(rows, cell)


def _parted(crowd: DataFrame, by: list[str], cell: float, also: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """crowd, and also along the same squares, as (k, size, cx, cy, g): pieces whose squares are cut further where crowd has
    more than CROWD pieces with the same values of by (cx, cy and perhaps k).

    Where a piece is the whole square, the others there add nothing to a union: the square stands for all. Equal pieces are
    one. What is left crowded are squares that many borders cross so that smaller ones would not part them.
    """
    was = F.lit(None).cast("double")
    crowd = materialize(crowd.withColumn("was", was), "pieces")
    also = also if also is None else materialize(also, "pieces")
    size, out, beside = cell, [], []
    final = lambda df: df.select("k", F.lit(size).alias("size"), "cx", "cy", "g")  # noqa: E731, B023
    for depth in range(DEPTH + 1):
        up = [F.floor(F.col(c) / 4).alias(f"up_{c}") if c != "k" else F.col("k").alias("up_k") for c in by]
        n = crowd.groupBy(*by).agg(F.count("*").alias("n"), F.max("whole").alias("any"), F.max("was").alias("was"))
        full = n.filter(F.col("n") > CROWD)
        full = materialize(full.select("*", *up), "crowded")
        if depth == DEPTH or full.isEmpty():
            break
        # What a square was cut into: all its pieces, also those of squares that are crowded no more.
        total = crowd.select(*up, "was").filter("was IS NOT NULL").groupBy(*[f"up_{c}" for c in by]).agg((F.count("*") <= GROWTH * F.max("was")).alias("parts"))
        cut = full.filter("NOT any").join(total, [f"up_{c}" for c in by], "left").filter("coalesce(parts, true)").select(*by, F.col("n").cast("double").alias("n"))
        cut = materialize(cut, "cut")
        squares = full.filter("any").select(*by)
        gone = cut.select(*by).union(squares)
        square = G.box(*[(F.col(c) + i) * size for i in (0, 1) for c in ("cx", "cy")])
        named = squares if "k" in by else squares.withColumn("k", F.lit(0))
        out += [final(crowd.join(gone, by, "left_anti")), final(named.withColumn("g", square))]
        if also is not None:
            beside.append(final(also.join(cut, by, "left_anti")))
            also = materialize(_cut_by(also.join(cut, by, "left_semi").select("k", F.col("g").alias("geometry")), size / 4), "pieces")
        kids = _cut_by(crowd.join(cut, by, "left_semi").select("k", F.col("g").alias("geometry")).distinct(), size / 4)
        sizes = cut.select(*[c for c in by if c == "k"], *[F.col(c).alias(f"up_{c}") for c in ("cx", "cy")], F.col("n").alias("was"))
        kids = kids.withColumns({f"up_{c}": F.floor(F.col(c) / 4) for c in ("cx", "cy")}).join(sizes, ["up_cx", "up_cy", *[c for c in by if c == "k"]])
        crowd = materialize(kids.select("k", "cx", "cy", "g", "whole", "was"), "pieces")
        size /= 4
    out.append(final(crowd))
    if also is not None:
        beside.append(final(also))
    return reduce(DataFrame.union, out), reduce(DataFrame.union, beside) if beside else None


def _by_cell(cells: DataFrame, rule: str, kind: str) -> DataFrame:
    """(k, geometry, area) from rows (k, gs, os) of cells: gs and os are what the two sides have there, united by the rule.

    Cells do not overlap, so areas add up and the pieces of all cells together are the result.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            sides = lambda gs: [_parts(g) for g in gs] if gs is not None else []
            cut = [trapezoids([sides(gs), sides(os)], RULES[rule]) for gs, os in zip(f["gs"], f["os"], strict=True)]
            out = pd.DataFrame({"k": f["k"], "g": [multi(c) for c in cut], "part": [total_area(c) for c in cut]})
            yield out[out["part"] > 0]

    parts = mapped(cells.select("k", "gs", "os"), run, f"k {kind}, g {G.GEOMETRY}, part double")
    whole = parts.groupBy("k").agg(F.flatten(F.collect_list("g.parts")).alias("parts"), F.sum("part").alias("area"))
    return whole.select("k", G.geometry("MultiPolygon", F.col("parts")).alias("geometry"), "area")


def united(df: DataFrame, key: str, cell: float = 1000.0) -> DataFrame:
    """(k, geometry, area): the union of the polygons of each key, cell by cell."""
    pieces, _ = _parted(_cut(df, key, cell), ["k", "cx", "cy"], cell)
    groups = pieces.groupBy("k", "size", "cx", "cy").agg(F.collect_list("g").alias("gs"))
    return _by_cell(groups.withColumn("os", F.array().cast(f"array<{G.GEOMETRY}>")), "union", dict(df.dtypes)[key])


def _against(one: DataFrame, other: DataFrame, key: str, rule: str, cell: float) -> DataFrame:
    """(k, geometry, area) of each polygon of one (unique in key) by the rule against all polygons of other."""
    there, here = _parted(_cut(other, None, cell), ["cx", "cy"], cell, _cut(one, key, cell))
    there = there.groupBy("size", "cx", "cy").agg(F.collect_list("g").alias("os"))
    met = here.join(there, ["size", "cx", "cy"], "inner" if rule == "intersection" else "left")
    return _by_cell(met.withColumn("gs", F.array("g")), rule, dict(one.dtypes)[key])


def overlay(a: DataFrame, b: DataFrame, key_a: str, key_b: str, how: str = "intersection", cell: float = 1000.0, *, attributes: bool = False) -> DataFrame:
    """(key_a_1, key_b_2, geometry, area): pieces of two polygon layers, each unique in its key.

    intersection: a piece for each pair; difference: each a without all b (key_b null); union: the intersection, and each
    side without the other. attributes adds the other columns of both sides; names that both have get _1 and _2.
    """
    polygons = lambda df: df.filter(F.col("geometry.dim") == 2)
    types = [dict(a.dtypes)[key_a], dict(b.dtypes)[key_b]]
    schema = f"__a {types[0]}, __b {types[1]}, geometry {G.GEOMETRY}, area double"

    def clip_pairs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            cut = [trapezoids([[_parts(x)], [_parts(y)]], RULES["intersection"]) for x, y in zip(f["ga"], f["gb"], strict=True)]
            out = pd.DataFrame({"__a": f["__a"], "__b": f["__b"], "geometry": [multi(c) for c in cut], "area": [total_area(c) for c in cut]})
            yield out[out["area"] > 0]

    a, b = polygons(a), polygons(b)
    none = [F.lit(None).cast(t) for t in types]
    out = []
    if how in ("intersection", "union"):
        met = pairs(a, b, cell, F.lit(True)).select(F.col(f"l.{key_a}").alias("__a"), F.col(f"r.{key_b}").alias("__b"), F.col("l.geometry").alias("ga"), F.col("r.geometry").alias("gb"))
        out.append(mapped(met, clip_pairs, schema))
    if how in ("difference", "union"):
        out.append(_against(a, b, key_a, "difference", cell).select(F.col("k").alias("__a"), none[1].alias("__b"), "geometry", "area"))
    if how == "union":
        out.append(_against(b, a, key_b, "difference", cell).select(none[0].alias("__a"), F.col("k").alias("__b"), "geometry", "area"))
    whole = reduce(DataFrame.union, out)
    more = []
    if attributes:
        clash = set(a.columns) & set(b.columns)
        for side, df, key, n in (("__a", a, key_a, 1), ("__b", b, key_b, 2)):
            names = {c: f"{c}_{n}" if c in clash else c for c in df.columns if c not in (key, "geometry")}
            own = df.select(F.col(key).alias(f"__k{n}"), *[F.col(c).alias(x) for c, x in names.items()])
            whole = whole.join(own, F.col(side) == F.col(f"__k{n}"), "left")
            more += names.values()
    return whole.select(F.col("__a").alias(f"{key_a}_1"), F.col("__b").alias(f"{key_b}_2"), *more, "geometry", "area")


def clip(features: DataFrame, mask: DataFrame, key: str, cell: float = 1000.0) -> DataFrame:
    """The features' parts (unique in key) inside the mask's polygons. A line or polygon that only touches them goes; of several
    points those in the mask or on its border stay.
    """
    mask = mask.filter("geometry.dim = 2").select("geometry")
    met = pairs(features.filter("geometry.dim = 1 OR geometry.kind = 'Point'"), mask, cell, G.intersects(F.col("l.geometry"), F.col("r.geometry")))
    points = met.filter("l.geometry.kind = 'Point'").select(F.col(f"l.{key}").alias("__k")).distinct()
    out = features.join(points, features[key] == F.col("__k"), "left_semi")
    # Each of several points by itself, named by its place among them.
    many = features.filter("geometry.kind = 'MultiPoint'").select(F.col(key).alias("k"), F.posexplode(G.vertices(F.col("geometry"))).alias("i", "v"))
    many = many.select(F.struct("k", "i").alias("one"), G.point(F.col("v.x"), F.col("v.y")).alias("geometry"))
    stay = pairs(many, mask, cell, G.covers_point(F.col("r.geometry"), G.px(F.col("l.geometry")), G.py(F.col("l.geometry")))).select("l.one", F.col("l.geometry.parts").alias("p")).dropDuplicates(["one"])
    parts = F.transform(F.array_sort(F.collect_list(F.struct(F.col("one.i").alias("i"), F.col("p")[0].alias("p")))), lambda s: s["p"])
    stay = stay.groupBy(F.col("one.k").alias("k")).agg(parts.alias("p"))
    stay = stay.select("k", F.when(F.size("p") == 1, G.geometry("Point", F.col("p"))).otherwise(G.geometry("MultiPoint", F.col("p"))).alias("geometry"))
    lines = inside_lines(met.filter("l.geometry.dim = 1"), features, key)
    polygons = _against(features.filter("geometry.dim = 2"), mask, key, "intersection", cell).select("k", "geometry")
    cut = lines.union(polygons).union(stay).select(F.col("k").alias("__k"), F.col("geometry").alias("__g"))
    new = features.join(cut, features[key] == F.col("__k")).withColumn("geometry", F.col("__g")).drop("__k", "__g")
    return out.unionByName(new)


def _inside(a: tuple, b: tuple, edges: np.ndarray) -> list[tuple[float, float]]:
    """The stretches (t0, t1) of the segment from a to b that lie in the polygon with these edges, or on its border."""
    (ax, ay), d = a, (b[0] - a[0], b[1] - a[1])
    ex, ey = edges[:, 2] - edges[:, 0], edges[:, 3] - edges[:, 1]
    px, py = edges[:, 0] - ax, edges[:, 1] - ay
    cross, long = d[0] * ey - d[1] * ex, d[0] ** 2 + d[1] ** 2
    with np.errstate(divide="ignore", invalid="ignore"):
        t, u = (px * ey - py * ex) / cross, (px * d[1] - py * d[0]) / cross
    ends = [((edges[:, i] - ax) * d[0] + (edges[:, i + 1] - ay) * d[1]) / long for i in (0, 2)] if long else []
    ts = np.concatenate([[0.0, 1.0], t[(cross != 0) & (u >= -EPS) & (u <= 1 + EPS)], *[e[cross == 0] for e in ends]])
    ts = np.unique(ts[(ts >= 0) & (ts <= 1)])
    out: list[tuple[float, float]] = []
    for t0, t1 in zip(ts, ts[1:], strict=False):
        x, y = ax + d[0] * (t0 + t1) / 2, ay + d[1] * (t0 + t1) / 2
        side = ex * (y - edges[:, 1]) - ey * (x - edges[:, 0])
        hit = ((edges[:, 1] > y) != (edges[:, 3] > y)) & ((side > 0) == (ey > 0))
        size = np.hypot(ex, ey)
        along = ((x - edges[:, 0]) * ex + (y - edges[:, 1]) * ey) / np.maximum(size, EPS)
        border = (np.abs(side) <= 1e-7 * size) & (along >= -EPS) & (along <= size + EPS)
        if hit.sum() % 2 or border.any():
            out.append((out.pop()[0], t1) if out and out[-1][1] == t0 else (t0, t1))
    return out


def inside_lines(met: DataFrame, features: DataFrame, key: str) -> DataFrame:
    """(k, geometry) of the lines in pairs (l, r) inside the polygons they meet, overlaps of polygons taken once."""
    kind = dict(features.dtypes)[key]

    def stretches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for k, g, o in zip(f["k"], f["g"], f["o"], strict=True):
                rings = [np.array(r, float) for p in _parts(o) for r in p]
                edges = np.vstack([np.hstack([r[:-1], r[1:]]) for r in rings])
                for p, (line,) in enumerate(_parts(g)):
                    rows += [(k, p, i, t0, t1) for i, (a, b) in enumerate(zip(line, line[1:], strict=False)) for t0, t1 in _inside(a, b, edges)]
            yield pd.DataFrame(rows, columns=["k", "p", "i", "t0", "t1"])

    pieces = mapped(met.select(F.col(f"l.{key}").alias("k"), F.col("l.geometry").alias("g"), F.col("r.geometry").alias("o")), stretches, f"k {kind}, p long, i long, t0 double, t1 double")
    of_line = pieces.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("p", "i", "t0", "t1"))).alias("at"))
    rows = features.select(F.col(key).alias("__k"), F.col("geometry").alias("g")).join(of_line, F.col("__k") == F.col("k"))

    def build(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            made = []
            for g, at in zip(f["g"], f["at"], strict=True):
                lines, parts, last = _parts(g), [], None
                for p, i, t0, t1 in ((s["p"], s["i"], s["t0"], s["t1"]) for s in at):
                    (a, b) = lines[p][0][i : i + 2]
                    place = lambda t: (a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1])) if t < 1 else b  # noqa: E731, B023
                    if last and (p, i + t0) <= last:  # goes on from, or overlaps with, what is there
                        if (p, i + t1) > last:
                            parts[-1].append(place(t1))
                            last = (p, i + t1)
                    else:
                        parts.append([place(t0), place(t1)])
                        last = (p, i + t1)
                made.append({"kind": "MultiLineString", "dim": 1, "parts": [[[{"x": float(x), "y": float(y)} for x, y in part]] for part in parts]})
            yield pd.DataFrame({"k": f["k"], "geometry": made})

    return mapped(rows.select("k", "g", "at"), build, f"k {kind}, geometry {G.GEOMETRY}")


def area_share(zones: DataFrame, features: DataFrame, key: str, output_field: str = "share", dissolve: bool = True, decimals: int = 3, absolute_field: str | None = None, cell: float = 1000.0) -> DataFrame:
    """zones (unique in key) with the share of their area that features cover; dissolve counts overlaps once."""
    features = features.filter(F.col("geometry.dim") == 2)

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"__k": f["__k"], "part": [total_area(trapezoids([[_parts(g)], [_parts(o)]], RULES["intersection"])) for g, o in zip(f["g"], f["o"], strict=True)]})

    if dissolve:
        parts = _against(zones, features, key, "intersection", cell).select(F.col("k").alias("__k"), F.col("area").alias("part"))
    else:
        met = pairs(zones, features, cell, F.lit(True)).select(F.col(f"l.{key}").alias("__k"), F.col("l.geometry").alias("g"), F.col("r.geometry").alias("o"))
        parts = mapped(met, each, f"__k {dict(zones.dtypes)[key]}, part double").groupBy("__k").agg(F.sum("part").alias("part"))
    out = zones.join(parts, zones[key] == F.col("__k"), "left")
    whole = G.area(F.col("geometry"))
    covered = F.coalesce("part", F.lit(0.0))
    out = out.withColumn(output_field, F.when(whole > 0, F.bround(covered / whole, decimals)))
    if absolute_field:
        out = out.withColumn(absolute_field, covered)
    return out.drop("__k", "part")


def dissolve(df: DataFrame, by: str | None = None, key: str | None = None, cell: float = 1000.0, first: Sequence[str] = (), order: Sequence[str] = ()) -> DataFrame:
    """(by, geometry, area): one geometry for each value of by (null goes); or, by key, one for each connected part.

    first: further columns, of which each value of by keeps the first that is not null in the order given.
    """
    df = df.filter(F.col("geometry.dim") == 2)
    if by:
        df = df.filter(F.col(by).isNotNull())
        out = united(df, by, cell).withColumnRenamed("k", by)
        if not first:
            return out
        kept = df.groupBy(by).agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), F.struct(*order))).alias(c) for c in first])
        return out.join(kept, by).select(by, *first, "geometry", "area")
    met = pairs(df, df, cell, (F.col(f"l.{key}") < F.col(f"r.{key}")) & G.intersects(F.col("l.geometry"), F.col("r.geometry")))
    roots = components(met.select(F.col(f"l.{key}").alias("a"), F.col(f"r.{key}").alias("b")))
    groups = df.join(roots, df[key] == roots.node, "left").select(F.coalesce("root", key).alias("id"), "geometry")
    return united(groups, "id", cell).withColumnRenamed("k", "id")


def buffer(df: DataFrame, key: str, radius_km: float) -> DataFrame:
    """(key, geometry, area): each geometry widened by the radius: its own area, discs at its corners, strips at its edges."""
    r = radius_km * 1000

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            made = [trapezoids([grown(g["dim"], _parts(g), r)], lambda n: n[0] > 0) for g in f["geometry"]]
            yield pd.DataFrame({"k": f["k"], "geometry": [multi(m) for m in made], "area": [total_area(m) for m in made]})

    rows = df.filter("geometry IS NOT NULL").select(F.col(key).alias("k"), "geometry")
    return mapped(rows, run, f"k {dict(df.dtypes)[key]}, geometry {G.GEOMETRY}, area double").withColumnRenamed("k", key)


def grown(dim: int, parts: list, r: float) -> list:
    """Polygons whose union is the buffer of a geometry."""
    n = 64
    disc = lambda x, y: [[[(x + r * math.cos(2 * math.pi * i / n), y + r * math.sin(2 * math.pi * i / n)) for i in [*range(n), 0]]]]
    out = [parts] if dim == 2 else []
    for ring in (ring for part in parts for ring in part):
        out += [disc(x, y) for x, y in dict.fromkeys(ring)]
        for (x1, y1), (x2, y2) in zip(ring, ring[1:], strict=False):
            d = math.hypot(x2 - x1, y2 - y1)
            if d:
                u, v = -(y2 - y1) / d * r, (x2 - x1) / d * r
                out.append([[[(x1 + u, y1 + v), (x2 + u, y2 + v), (x2 - u, y2 - v), (x1 - u, y1 - v), (x1 + u, y1 + v)]]])
    return out


def isochrone(reached: DataFrame, edges: DataFrame, breaks_m: Sequence[float], buffer_m: float = 100.0) -> DataFrame:
    """(limit_m, geometry, area) for each break: reached nodes (id, x, y, d) and the edges between them, widened and united."""
    limits = F.explode(F.array(*[F.lit(float(b)) for b in breaks_m])).alias("limit_m")
    at = reached.select("id", "x", "y", "d", limits).filter("d <= limit_m")
    a = at.select("limit_m", F.col("id").alias("u"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    b = at.select("limit_m", F.col("id").alias("v"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    met = edges.select("u", "v").join(a, "u").join(b, ["limit_m", "v"])
    # Discs at the nodes and strips along the edges, as SQL expressions; each is a polygon of its own.
    d = F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    u, v = -(F.col("y2") - F.col("y1")) / d * buffer_m, (F.col("x2") - F.col("x1")) / d * buffer_m
    corner = lambda n, s: G.xy(F.col(f"x{n}") + s * u, F.col(f"y{n}") + s * v)
    strips = met.filter(d > 0).select("limit_m", G.polygon_of(F.array(corner(1, 1), corner(2, 1), corner(2, -1), corner(1, -1), corner(1, 1))).alias("geometry"))
    discs = at.select("limit_m", G.circle(F.col("x"), F.col("y"), buffer_m).alias("geometry"))
    return united(discs.union(strips), "limit_m", 8 * buffer_m).withColumnRenamed("k", "limit_m")


#: Polygons with at most this many edges are cut side by side, about SLABS slabs times edges at once; others one by one.
SMALL, SLABS = 32, 2_000_000


def _edges_of(parts: pa.Array) -> tuple[np.ndarray, Edges]:
    """(row, edges) of polygons' parts, as _edges() gives them, in one array."""
    rows, where, at = parts, np.arange(len(parts)), None
    for _ in range(3):  # parts, rings, vertices
        at = np.repeat(np.arange(len(rows)), pc.fill_null(pc.list_value_length(rows), 0).to_numpy(zero_copy_only=False))
        rows, where = rows.flatten(), where[at]
    x, y = (rows.field(k).to_numpy(zero_copy_only=False).astype(float) for k in "xy")
    k = np.flatnonzero(at[1:] == at[:-1])
    e, row = np.stack([x[k], y[k], x[k + 1], y[k + 1]], 1), where[k]
    e, row = e[e[:, 0] != e[:, 2]], row[e[:, 0] != e[:, 2]]
    back = e[:, 0] > e[:, 2]
    e[back] = e[back][:, [2, 3, 0, 1]]
    return row, e


def _cut_alike(e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """trapezoids() of each of the polygons e (n, edges, 4) by itself: (polygon, slab, pieces, joined), pieces in order. joined are
    polygons with intervals that touch, which are for trapezoids()."""
    n, m, _ = e.shape
    s = np.take_along_axis(e, np.argsort(e[:, :, 0], axis=1)[:, :, None], 1)
    slope = (s[:, :, 3] - s[:, :, 1]) / (s[:, :, 2] - s[:, :, 0])
    i, j = np.triu_indices(m, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        x = (s[:, j, 1] - slope[:, j] * s[:, j, 0] - s[:, i, 1] + slope[:, i] * s[:, i, 0]) / (slope[:, i] - slope[:, j])
    ok = np.isfinite(x) & (x > np.maximum(s[:, i, 0], s[:, j, 0])) & (x < np.minimum(s[:, i, 2], s[:, j, 2]))
    xs = np.sort(np.concatenate([e[:, :, 0], e[:, :, 2], np.where(ok, x, e[:, :1, 0])], 1), axis=1)
    most = np.maximum(np.abs(xs[:, :1]), np.abs(xs[:, -1:]))
    poly, at = np.nonzero(np.concatenate([np.full((n, 1), True), np.diff(xs, axis=1) > EPS * np.maximum(1.0, most)], 1))
    x = xs[poly, at]
    slab = np.flatnonzero(poly[1:] == poly[:-1])
    poly, x0, x1 = poly[slab], x[slab], x[slab + 1]
    mid, own = ((x0 + x1) / 2)[:, None], e[poly]
    on = (own[:, :, 0] <= mid) & (own[:, :, 2] >= mid)
    slope = (own[:, :, 3] - own[:, :, 1]) / (own[:, :, 2] - own[:, :, 0])
    y = lambda v: own[:, :, 1] + slope * (v - own[:, :, 0])
    order = np.argsort(np.where(on, y(mid), np.inf), axis=1, kind="stable")
    low, high = (np.take_along_axis(y(v[:, None]), order, 1) for v in (x0, x1))
    count = on.sum(1)
    joined, out = np.full(n, False), []
    last = np.full((len(poly), 2), np.nan)
    for k in range(0, m - 1, 2):  # edges come in pairs by the even-odd rule
        c = [low[:, k], high[:, k], low[:, k + 1], high[:, k + 1]]
        has = (k + 1 < count) & ((c[2] - c[0] > EPS) | (c[3] - c[1] > EPS))
        near = [np.abs(last[:, d] - c[d]) <= EPS * np.maximum(1, np.abs(c[d])) for d in (0, 1)]
        joined[poly[has & near[0] & near[1]]] = True
        last[has] = np.stack(c[2:], 1)[has]
        out.append((np.flatnonzero(has), np.stack([x0, x1, *c], 1)[has]))
    slab, pieces = (np.concatenate([o[d] for o in out]) for d in (0, 1))
    order = np.argsort(slab, kind="stable")
    return poly[slab[order]], slab[order], pieces[order], joined


def _merging(pieces: np.ndarray) -> np.ndarray:
    """Whether polygon_parts() makes a piece and the next one into one, if no other lies between them."""
    ax, bx, ay, by, cy, dy = pieces[:-1].T
    x0, x1, a, b, c, d = pieces[1:].T
    w, v = bx - ax, x1 - x0
    near = (np.abs(bx - x0) <= EPS * np.maximum(1, np.abs(x0))) & (np.abs(by - a) <= 1e-7 * np.maximum(1, np.abs(a))) & (np.abs(dy - c) <= 1e-7 * np.maximum(1, np.abs(c)))
    return near & (np.abs((by - ay) * v - (b - a) * w) <= 1e-6 * w * v) & (np.abs((dy - cy) * v - (d - c) * w) <= 1e-6 * w * v)


def _rebuilt_batch(parts: pa.Array, kind: pa.StructType) -> tuple[pa.Array, np.ndarray]:
    """(geometry, area) of a batch of polygons, each by the even-odd rule."""
    n = len(parts)
    row, e = _edges_of(parts)
    order = np.argsort(row, kind="stable")
    row, e = row[order], e[order]
    size = np.bincount(row, minlength=n)
    first = np.cumsum(size) - size
    odd = np.full(n, False)
    odd[row[~np.isfinite(e).all(1)]] = True
    alone, cut = odd | (size > SMALL), [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty((0, 6)))]  # cut: (row, slab, pieces)
    for m in np.unique(size[~alone]).tolist():
        rows = np.flatnonzero((size == m) & ~alone)
        step = max(1, SLABS // max(1, m * (2 * m + m * (m - 1) // 2)))
        for k in range(0, len(rows) if m > 1 else 0, step):
            some = rows[k : k + step]
            poly, slab, pieces, joined = _cut_alike(e[first[some][:, None] + np.arange(m)])
            alone[some[joined]] = True
            whole = ~joined[poly]
            cut.append((some[poly[whole]], slab[whole], pieces[whole]))
    for i in np.flatnonzero(alone).tolist():
        pieces = trapezoids([[_parts({"parts": parts[i].as_py()})]], lambda n: n[0] > 0)
        cut.append((np.full(len(pieces), i), np.arange(len(pieces)), np.array(pieces, float).reshape(-1, 6)))
    at, slab, pieces = (np.concatenate(c) for c in zip(*cut, strict=True))
    order = np.argsort(at, kind="stable")
    at, slab, pieces = at[order], slab[order], pieces[order]
    area = np.bincount(at, (pieces[:, 1] - pieces[:, 0]) * ((pieces[:, 4] - pieces[:, 2]) + (pieces[:, 5] - pieces[:, 3])) / 2, n)
    # Where pieces can't grow together, each is a ring of its own.
    together = at[1:] == at[:-1]
    grows = alone.copy()
    grows[at[1:][together & ((slab[1:] == slab[:-1]) | _merging(pieces))]] = True
    own = ~grows[at]
    x0, x1, a, b, c, d = pieces[own].T
    xy = np.stack([np.stack([x0, x1, x1, x0, x0], 1), np.stack([a, b, d, c, a], 1)], 2)
    stays = np.concatenate([np.full((len(xy), 1), True), (xy[:, 1:] != xy[:, :-1]).any(2)], 1)
    ring_row, ring_size, points = [at[own]], [stays.sum(1)], [xy[stays]]
    starts = np.searchsorted(at, np.arange(n + 1))
    for i in np.flatnonzero(grows & (starts[1:] > starts[:-1])).tolist():
        rings = [part[0] for part in polygon_parts([tuple(p) for p in pieces[starts[i] : starts[i + 1]].tolist()])]
        ring_row.append(np.full(len(rings), i))
        ring_size.append(np.array([len(r) for r in rings]))
        points.append(np.array([(v["x"], v["y"]) for r in rings for v in r], float))
    ring_row, ring_size, points = np.concatenate(ring_row), np.concatenate(ring_size), np.concatenate(points)
    order = np.argsort(ring_row, kind="stable")
    points = points[np.argsort(np.repeat(ring_row, ring_size), kind="stable")]
    ends = lambda sizes: pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
    listed = kind.field("parts").type
    xy = pa.StructArray.from_arrays([pa.array(points[:, k].copy()) for k in (0, 1)], fields=list(listed.value_type.value_type.value_type))
    rings = pa.ListArray.from_arrays(ends(ring_size[order]), xy)
    shapes = pa.ListArray.from_arrays(ends(np.bincount(ring_row, minlength=n)), pa.ListArray.from_arrays(pa.array(np.arange(len(ring_row) + 1), pa.int32()), rings)).cast(listed)
    fields = {"kind": pa.array(["MultiPolygon"] * n, pa.string()), "dim": pa.array(np.full(n, 2), kind.field("dim").type), "parts": shapes}
    return pa.StructArray.from_arrays([fields[f.name] for f in kind], fields=list(kind), mask=pa.array(starts[1:] == starts[:-1])), area


def _rebuilt(rows: DataFrame, key_type: str) -> DataFrame:
    """(k, geometry, area): each polygon by the even-odd rule; small ones side by side."""
    schema = f"k {key_type}, geometry {G.GEOMETRY}, area double"
    kinds = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            geometry, area = _rebuilt_batch(pc.struct_field(b.column("geometry"), "parts"), kinds.field("geometry").type)
            yield pa.RecordBatch.from_arrays([b.column("k"), geometry, pa.array(area)], schema=kinds)

    return rows.mapInArrow(run, schema)


def repair_geometry(df: DataFrame, key: str) -> DataFrame:
    """Rows without a geometry go; polygons are rebuilt by the even-odd rule, and go if nothing is left of them."""
    rest = df.filter((F.col("geometry.dim") < 2) & (F.size(G.vertices(F.col("geometry"))) > 0))
    rows = df.filter(F.col("geometry.dim") == 2).select(F.col(key).alias("k"), "geometry")
    fixed = _rebuilt(rows, dict(df.dtypes)[key]).filter("area > 0").select(F.col("k").alias("__k"), F.col("geometry").alias("__g"))
    polygons = df.join(fixed, df[key] == F.col("__k")).withColumn("geometry", F.col("__g")).drop("__k", "__g")
    return rest.unionByName(polygons)


def to_points(df: DataFrame) -> DataFrame:
    """Every geometry as a point on it: a polygon's in its widest interval at half height, a line's at its middle vertex."""
    schema = ", ".join(f"{c} {t}" for c, t in df.dtypes)

    def inner(g) -> dict | None:  # noqa: ANN001
        if g is None:
            return None
        if g["dim"] < 2:
            p = g["parts"][0][0][len(g["parts"][0][0]) // 2]
            x, y = p["x"], p["y"]
        else:
            cut = trapezoids([[_parts(g)]], lambda n: n[0] > 0)
            if not cut:
                return None
            x0, x1, a, b, c, d = max(cut, key=lambda t: (t[1] - t[0]) * (t[4] - t[2] + t[5] - t[3]))
            x, y = (x0 + x1) / 2, (a + b + c + d) / 4
        return {"kind": "Point", "dim": 0, "parts": [[[{"x": float(x), "y": float(y)}]]]}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.assign(geometry=[inner(g) for g in f["geometry"]])

    return mapped(df, run, schema)
