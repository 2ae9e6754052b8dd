"""Writing layers: GeoJSON, CSV with WKT, Turtle, GeoTIFF, an HTML map. Text formats are written by many tasks."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.functions import geometry as G
from geoloom.operators.raster import MAX_CELLS, Grid
from geoloom.sources.geotiff import encode_tif


def feature(df: DataFrame, geometry: str = "geometry") -> Column:
    """A GeoJSON feature as text."""
    attributes = [c for c in df.columns if c != geometry]
    props = F.to_json(F.struct(*attributes), {"ignoreNullFields": "false"}) if attributes else F.lit("{}")
    return F.concat(F.lit('{"type":"Feature","properties":'), props, F.lit(',"geometry":'), F.coalesce(G.geojson(F.col(geometry)), F.lit("null")), F.lit("}"))


def write_geojson(df: DataFrame, path: str) -> None:
    """A folder of text files with one feature a line, which read_geojson(lines=True) reads."""
    df.select(feature(df).alias("value")).write.text(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with the geometry as the last column, wkt."""
    df.select(*[c for c in df.columns if c != "geometry"], G.wkt(F.col("geometry")).alias("wkt")).write.csv(path, header=True)


def turtle(df: DataFrame, key: str, base: str) -> DataFrame:
    """Lines of Turtle: a GeoSPARQL feature with its geometry (WGS84) and attributes for each row."""
    q = lambda c: F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace(c.cast("string"), r"\\", r"\\\\"), '"', r'\\"'), F.lit('"'))
    me = F.concat(F.lit(f"<{base}"), F.col(key).cast("string"), F.lit(">"))
    geo = F.concat(F.lit(f"<{base}"), F.col(key).cast("string"), F.lit("/geometry>"))
    lines = [F.concat(me, F.lit(" a <http://www.opengis.net/ont/geosparql#Feature> ; <http://www.opengis.net/ont/geosparql#hasGeometry> "), geo, F.lit(" ."))]
    lines.append(F.concat(geo, F.lit(" <http://www.opengis.net/ont/geosparql#asWKT> "), q(G.wkt(F.col("geometry"))), F.lit("^^<http://www.opengis.net/ont/geosparql#wktLiteral> .")))
    lines += [F.concat(me, F.lit(f" <{base}{c}> "), q(F.col(c)), F.lit(" .")) for c in df.columns if c not in (key, "geometry")]
    return df.select(F.explode(F.array_compact(F.array(*lines))).alias("value"))


def geotiff(cells: DataFrame, bands: Sequence[str], grid: Grid, epsg: int, nodata: float = -9999.0) -> bytes:
    """A GeoTIFF of a raster within the cell budget as bytes, for small rasters; geotiff.write_tifs() writes large ones."""
    if grid.rows * grid.cols * len(bands) > MAX_CELLS:
        raise ValueError(f"more than {MAX_CELLS} cells")
    data = np.full((grid.rows, grid.cols, len(bands)), nodata, "<f4")
    rows = cells.select("row", "col", *bands).toPandas()
    for i, b in enumerate(bands):
        data[rows["row"], rows["col"], i] = rows[b].astype(float).fillna(nodata)
    return encode_tif(data, grid.x0, grid.y0, grid.cell, epsg, nodata)


def html_map(df: DataFrame, limit: int = 5000) -> str:
    """A page that draws up to ``limit`` features as SVG: a preview, so it says how many it leaves out."""
    n = df.count()
    shapes = [r[0] for r in df.select(feature(df)).limit(limit).collect()]
    script = "const f=[" + ",".join(shapes) + "];const s=document.querySelector('svg');let b=[1e99,1e99,-1e99,-1e99];const e=(c,g)=>typeof c[0]==='number'?g(c):c.forEach(x=>e(x,g));f.forEach(x=>x.geometry&&e(x.geometry.coordinates,c=>{b=[Math.min(b[0],c[0]),Math.min(b[1],c[1]),Math.max(b[2],c[0]),Math.max(b[3],c[1])]}));const w=Math.max(b[2]-b[0],b[3]-b[1],1e-9);s.setAttribute('viewBox',`${b[0]} ${-b[3]} ${w} ${w}`);const d=c=>typeof c[0][0]==='number'?'M'+c.map(p=>p[0]+' '+-p[1]).join('L'):c.map(d).join('');f.forEach(x=>{const g=x.geometry;if(!g)return;const t=g.type.includes('Point')?'circle':'path';const o=document.createElementNS('http://www.w3.org/2000/svg',t);if(t==='path')o.setAttribute('d',d(g.coordinates));else{const c=g.type==='Point'?g.coordinates:g.coordinates[0];o.setAttribute('cx',c[0]);o.setAttribute('cy',-c[1]);o.setAttribute('r',w/300)}o.setAttribute('fill',g.type.includes('Line')?'none':'#48a8');o.setAttribute('stroke','#246');o.setAttribute('stroke-width',w/1500);s.append(o)});"
    note = f"{min(n, limit)} of {n} features"
    return f"<!DOCTYPE html><meta charset='utf-8'><title>{note}</title><p>{note}</p><svg width='100%' height='90vh'></svg><script>{script.replace('</', '<' + chr(92) + '/')}</script>"


def summary(df: DataFrame, numeric: Sequence[str] = ()) -> DataFrame:
    """One row: rows, kinds of geometry, bounds, and minimum, maximum and mean of each number column."""
    b = G.bbox(F.col("geometry"))
    out = [F.count("*").alias("rows"), F.array_sort(F.collect_set("geometry.kind")).alias("kinds"), F.min(b.xmin).alias("xmin"), F.min(b.ymin).alias("ymin"), F.max(b.xmax).alias("xmax"), F.max(b.ymax).alias("ymax")]
    for c in numeric:
        out += [F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max"), F.avg(c).alias(f"{c}_mean")]
    return df.agg(*out)


def preview(df: DataFrame, rows: int, columns: int | None = None) -> DataFrame:
    """At most ``rows`` rows, shared among the kinds of geometry by their numbers (one of each at least), and the
    ``columns`` attributes that are filled most. A report: it leaves rows out on purpose.
    """
    kinds = {r[0]: r[1] for r in df.groupBy("geometry.kind").count().collect()}  # six kinds at most
    total = sum(kinds.values())
    attributes = [c for c in df.columns if c != "geometry"]
    if columns is not None and columns < len(attributes):
        filled = df.agg(*[F.count(c).alias(c) for c in attributes]).first()
        attributes = sorted(sorted(attributes, key=lambda c: -filled[c])[:columns], key=attributes.index)
    slim, out = df.select(*attributes, "geometry"), None
    for kind, n in kinds.items():
        part = slim.filter(F.col("geometry.kind").eqNullSafe(F.lit(kind))).limit(n if total <= rows else max(1, rows * n // total))
        out = part if out is None else out.union(part)
    return slim.limit(0) if out is None else out


def coverage(df: DataFrame, region: DataFrame) -> DataFrame:
    """One row: how much of the region's bounding box the layer's covers, in each direction (0 to 1)."""
    b, r = G.bbox(F.col("geometry")), G.bbox(F.col("geometry"))
    ends = lambda d, c, p: d.agg(F.min(c.xmin).alias(f"{p}x0"), F.min(c.ymin).alias(f"{p}y0"), F.max(c.xmax).alias(f"{p}x1"), F.max(c.ymax).alias(f"{p}y1"))
    both = ends(df, b, "a").crossJoin(ends(region, r, "b"))  # one row each
    share = lambda k: F.try_divide(F.greatest(F.least(f"a{k}1", f"b{k}1") - F.greatest(f"a{k}0", f"b{k}0"), F.lit(0.0)), F.col(f"b{k}1") - F.col(f"b{k}0"))
    return both.select(share("x").alias("width"), share("y").alias("height"))
