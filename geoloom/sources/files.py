"""Reading layers and tables from files. What Spark reads itself it reads; single-file formats (databases, workbooks,
archives) come in as binaryFile rows and are taken apart inside a task, never on the driver; GeoTIFF is in geotiff.py.
"""

from __future__ import annotations

import csv
import io
import os
import re
import sqlite3
import struct
import tempfile
import uuid
import zipfile
from collections.abc import Iterator, Sequence
from urllib.parse import unquote, urlparse
from xml.etree import ElementTree

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.functions import geometry as G
from geoloom.functions.keys import CASTS
from geoloom.sources.collections import PIECE, feature_texts


# --- tables -----------------------------------------------------------------------------------------------------


def shape(df: DataFrame, columns: dict[str, dict] | None = None, decimal: str = ".", thousands: str | None = None, x: str | None = None, y: str | None = None, wkt: str | None = None) -> DataFrame:
    """Project, rename and cast text columns ({source: {as, type}}), and build the geometry from x and y or from WKT."""
    def number(c: Column) -> Column:
        c = F.replace(c, F.lit(thousands), F.lit("")) if thousands else c
        return F.replace(c, F.lit(decimal), F.lit(".")) if decimal != "." else c

    g = None
    if x and y:
        g = G.point(CASTS["float"](number(F.col(x))), CASTS["float"](number(F.col(y))))
    elif wkt:
        g = G.from_wkt(F.col(wkt))
    picked = []
    for name, spec in (columns or {c: {} for c in df.columns if c != wkt}).items():
        kind = spec.get("type")
        value = number(F.col(name)) if kind in ("integer", "float") else F.col(name)
        picked.append((CASTS[kind](value) if kind else value).alias(spec.get("as", name)))
    return df.select(*picked, *([g.alias("geometry")] if g is not None else []))


def read_csv(spark: SparkSession, path: str, delimiter: str = ",", quote: str = '"', encoding: str = "utf-8", **how) -> DataFrame:
    """All cells are text until shape() casts them."""
    return shape(spark.read.csv(path, header=True, sep=delimiter, quote=quote, escape=quote, encoding=encoding, inferSchema=False), **how)


def read_fwf(spark: SparkSession, path: str, colspecs: Sequence[tuple[int, int]], names: Sequence[str], skiprows: int = 0, **how) -> DataFrame:
    """Fixed-width text: [start, end) of each column. skiprows counts from a file's start."""
    lines = spark.read.text(path)
    if skiprows:
        whole = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("i", "value"))
        lines = whole.filter(F.col("i") >= skiprows).select("value")
    cells = [F.trim(F.substring("value", a + 1, b - a)).alias(n) for (a, b), n in zip(colspecs, names, strict=True)]
    return shape(lines.filter(F.length(F.trim("value")) > 0).select(*cells), **how)


def _rows_of(spark: SparkSession, path: str, parse, names: Sequence[str]) -> DataFrame:  # noqa: ANN001
    """Text rows that parse(bytes) gives for each file of the path."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for content in f["content"]:
                yield pd.DataFrame([[None if v is None else str(v) for v in r] for r in parse(bytes(content))], columns=list(names), dtype=object)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, ", ".join(f"`{n}` string" for n in names))


def _sqlite(content: bytes, sql: str) -> list[tuple]:
    with tempfile.TemporaryDirectory() as d:  # the task's own scratch; nothing is read from it afterwards
        name = os.path.join(d, "db")
        with open(name, "wb") as f:
            f.write(content)
        con = sqlite3.connect(name)
        try:
            return con.execute(sql).fetchall()
        finally:
            con.close()


def read_sqlite(spark: SparkSession, path: str, names: Sequence[str], table: str | None = None, query: str | None = None, **how) -> DataFrame:
    """Columns ``names`` of a table or query of a SQLite file."""
    quoted = ", ".join('"' + n.replace('"', '""') + '"' for n in names)
    sql = query or f'SELECT {quoted} FROM "{table}"'
    return shape(_rows_of(spark, path, lambda b: _sqlite(b, sql), names), **how)


def read_sql_dump(spark: SparkSession, path: str, names: Sequence[str], table: str, **how) -> DataFrame:
    """A table of an SQL script of CREATE TABLE and INSERT statements."""
    def parse(content: bytes) -> list[tuple]:
        con = sqlite3.connect(":memory:")
        try:
            con.executescript(content.decode("utf-8"))
            return con.execute("SELECT " + ", ".join(f'"{n}"' for n in names) + f' FROM "{table}"').fetchall()
        finally:
            con.close()

    return shape(_rows_of(spark, path, parse, names), **how)


def _xlsx(content: bytes, sheet: str | None) -> list[list]:
    """Rows of a worksheet as text cells."""
    ns = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{{{ns['m']}}}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", ns)]
        # A sheet's file is named by the workbook's relations; where there are none, by its place.
        relation = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
        sheets = {s.get("name"): s.get(relation) for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{{{ns['m']}}}sheet")}
        if sheet not in sheets and (sheet is not None or len(sheets) > 1):
            raise ValueError(f"name one of the sheets {list(sheets)}")
        name = sheet if sheet is not None else next(iter(sheets))
        targets = {}
        if "xl/_rels/workbook.xml.rels" in z.namelist():
            targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        target = targets.get(sheets[name], f"worksheets/sheet{list(sheets).index(name) + 1}.xml")
        tree = ElementTree.fromstring(z.read(target[1:] if target.startswith("/") else f"xl/{target}"))
    out = []
    for row in tree.iter(f"{{{ns['m']}}}row"):
        cells: dict[int, str | None] = {}
        for c in row.findall("m:c", ns):
            col = 0
            for ch in re.match("[A-Z]+", c.get("r"))[0]:
                col = col * 26 + ord(ch) - 64
            v, inline = c.find("m:v", ns), c.find("m:is", ns)
            text = "".join(t.text or "" for t in inline.iter(f"{{{ns['m']}}}t")) if inline is not None else v.text if v is not None else None
            cells[col - 1] = shared[int(text)] if c.get("t") == "s" and text is not None else text
        out.append([cells.get(i) for i in range(max(cells, default=-1) + 1)])
    return out


def read_xlsx(spark: SparkSession, path: str, names: Sequence[str], sheet: str | None = None, **how) -> DataFrame:
    """Columns ``names`` of a worksheet whose first row is the header."""
    def parse(content: bytes) -> list[list]:
        head, *rows = _xlsx(content, sheet)
        at = [head.index(n) for n in names]
        return [[r[i] if i < len(r) else None for i in at] for r in rows]

    return shape(_rows_of(spark, path, parse, names), **how)


def read_gtfs(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """stops, routes, trips and stop_times of a timetable archive, as gtfs_edges() takes them."""
    wanted = {"stops": ["stop_id", "stop_name", "stop_lat", "stop_lon"], "routes": ["route_id", "route_type"], "trips": ["trip_id", "route_id"], "stop_times": ["trip_id", "stop_id", "stop_sequence"]}

    def parse(name: str, columns: list[str]):  # noqa: ANN202
        def run(content: bytes) -> list[list]:
            with zipfile.ZipFile(io.BytesIO(content)) as z, z.open(f"{name}.txt") as f:
                return [[r.get(c) for c in columns] for r in csv.DictReader(io.TextIOWrapper(f, "utf-8-sig"))]

        return run

    out = {n: _rows_of(spark, path, parse(n, c), c) for n, c in wanted.items()}
    out["routes"] = out["routes"].withColumn("route_type", F.col("route_type").try_cast("int"))
    return out


# --- vector layers ----------------------------------------------------------------------------------------------


def _from_geojson(kind: Column, text: Column) -> Column:
    """Geometry of a GeoJSON type and its coordinates as text."""
    p = lambda v: G.named(x=v[0], y=v[1])
    one = lambda t: F.from_json(text, t)
    ring = lambda r: F.transform(r, p)
    return (
        F.when(kind == "Point", G.geometry("Point", F.array(F.array(F.array(p(one("array<double>")))))))
        .when(kind == "MultiPoint", G.geometry("MultiPoint", F.transform(one("array<array<double>>"), lambda v: F.array(F.array(p(v))))))
        .when(kind == "LineString", G.geometry("LineString", F.array(F.array(ring(one("array<array<double>>"))))))
        .when(kind == "MultiLineString", G.geometry("MultiLineString", F.transform(one("array<array<array<double>>>"), lambda r: F.array(ring(r)))))
        .when(kind == "Polygon", G.geometry("Polygon", F.array(F.transform(one("array<array<array<double>>>"), ring))))
        .when(kind == "MultiPolygon", G.geometry("MultiPolygon", F.transform(one("array<array<array<array<double>>>>"), lambda q: F.transform(q, ring))))
    )


def read_geojson(spark: SparkSession, path: str, columns: dict[str, str] | None = None, lines: bool = False, piece: int = PIECE) -> DataFrame:
    """Features with their properties (a map of text, or the columns {name: type}) and geometry.

    lines: one feature a line; else a file is one FeatureCollection. Many tasks read a file of lines, or one of more bytes
    than piece.
    """
    feature = "struct<properties: map<string, string>, geometry: struct<type: string, coordinates: string>>"
    if lines:
        rows = spark.read.text(path).select(F.from_json("value", feature).alias("f"))
    else:
        whole = spark.read.text(path, wholetext=True).filter(F.col("_metadata.file_size") <= piece)
        rows = whole.select(F.explode(F.from_json("value", f"struct<features: array<{feature}>>")["features"]).alias("f"))
        if not spark.read.format("binaryFile").load(path).filter(F.col("length") > piece).select("path").isEmpty():
            rows = rows.union(feature_texts(spark, path, piece).select(F.from_json("value", feature).alias("f")))
    g = _from_geojson(F.col("f.geometry.type"), F.col("f.geometry.coordinates"))
    picked = [F.col("f.properties")] if columns is None else [CASTS[t](F.col("f.properties")[c]).alias(c) for c, t in columns.items()]
    return rows.select(*picked, g.alias("geometry"))


def _wkb(b: bytes) -> dict | None:
    """Geometry of well-known binary."""
    names = {1: "Point", 2: "LineString", 3: "Polygon", 4: "MultiPoint", 5: "MultiLineString", 6: "MultiPolygon"}

    def read(at: int) -> tuple[str, list, int]:
        e = "<" if b[at] else ">"
        (code,) = struct.unpack_from(e + "I", b, at + 1)
        at += 5
        kind, size = names[code % 1000 & 0xFF], 2 + (code // 1000 in (1, 2)) + 2 * (code // 1000 == 3)

        def points(at: int, n: int) -> tuple[list, int]:
            v = struct.unpack_from(f"{e}{n * size}d", b, at)
            return [{"x": v[i * size], "y": v[i * size + 1]} for i in range(n)], at + 8 * n * size

        def counted(at: int) -> tuple[int, int]:
            return struct.unpack_from(e + "I", b, at)[0], at + 4

        if kind == "Point":
            p, at = points(at, 1)
            return kind, [[p]], at
        n, at = counted(at)
        if kind == "LineString":
            p, at = points(at, n)
            return kind, [[p]], at
        parts: list = []
        if kind == "Polygon":
            rings = []
            for _ in range(n):
                m, at = counted(at)
                r, at = points(at, m)
                rings.append(r)
            return kind, [rings], at
        for _ in range(n):
            _, own, at = read(at)
            parts += own
        return kind, parts, at

    try:
        kind, parts, _ = read(0)
    except (KeyError, IndexError, struct.error):
        return None
    return {"kind": kind, "dim": G.DIMS[kind], "parts": parts}


def read_gpkg(spark: SparkSession, path: str, layer: str, names: Sequence[str], geom: str = "geom") -> DataFrame:
    """A layer of a GeoPackage: columns ``names`` as text, and geometry."""
    sql = f'SELECT {", ".join(chr(34) + n + chr(34) for n in (*names, geom))} FROM "{layer}"'
    envelope = (0, 32, 48, 48, 64)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for content in f["content"]:
                rows = _sqlite(bytes(content), sql)
                blobs = [r[-1][8 + envelope[r[-1][3] >> 1 & 7] :] if r[-1] else None for r in rows]
                out = pd.DataFrame([[None if v is None else str(v) for v in r[:-1]] for r in rows], columns=list(names), dtype=object)
                out["geometry"] = [_wkb(b) if b else None for b in blobs]
                yield out

    schema = ", ".join(f"`{n}` string" for n in names) + f", geometry {G.GEOMETRY}"
    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, schema)


def read_gml(spark: SparkSession, path: str, member: str, columns: dict[str, str], swap_xy: bool = False) -> DataFrame:
    """Features of an XML file, one for each element ``member``: points, lines and polygons with holes, single or in parts.

    Positions come from pos, posList or coordinates, of two numbers or of three where srsDimension says so; swap_xy turns
    latitude first into x first. A file is cut at its elements, so many tasks read it.
    """
    rows = spark.read.format("xml").option("rowTag", member).option("wildcardColName", "__any").schema(", ".join([*(f"`{c}` string" for c in columns), "`__any` array<string>"])).load(path)
    rows = rows.withColumn("__text", F.array_join("__any", " "))
    # A ring or line goes from its element to the end of its numbers; a curve may have several stretches, each its own part.
    found = r"(?s)<(?:\w+:)?(exterior|interior|outerBoundaryIs|innerBoundaryIs|LineString|LineStringSegment|Point)\b[^>]*>((?:(?!</(?:\w+:)?\1\b).)*)"
    of = lambda i: F.regexp_extract_all("__text", F.lit(found), F.lit(i))
    rows = rows.withColumn("__rings", F.arrays_zip(of(1).alias("what"), of(2).alias("body")))
    width = F.when(F.col("__text").rlike(r"srsDimension\s*=\s*[\"']3"), 3).otherwise(2)

    def ring(r: Column) -> Column:
        told = F.array_join(F.regexp_extract_all(r["body"], F.lit(r"<(?:\w+:)?(?:pos|posList|coordinates)\b[^>]*>([^<]*)<"), F.lit(1)), " ")
        v = F.transform(F.filter(F.split(told, r"[\s,]+"), lambda t: t != ""), lambda t: t.try_cast("double"))
        at = lambda i, k: F.get(v, i * width + k)
        x, y = (1, 0) if swap_xy else (0, 1)
        n = F.floor(F.size(v) / width).cast("int")
        return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: G.xy(at(i, x), at(i, y)))).otherwise(F.array().cast(f"array<{G.XY}>"))

    hole = lambda r: r["what"].isin("interior", "innerBoundaryIs")
    parts = F.aggregate(
        "__rings",
        F.array().cast(f"array<array<array<{G.XY}>>>"),
        lambda acc, r: F.when(hole(r) & (F.size(acc) > 0), F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.concat(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.array().cast(f"array<array<{G.XY}>>")), F.array(ring(r)))))).otherwise(F.concat(acc, F.array(F.array(ring(r))))),
    )
    first, many = F.get("__rings", F.lit(0))["what"], F.size("__parts") > 1
    kind = F.when(first.isin("exterior", "outerBoundaryIs"), F.when(many, "MultiPolygon").otherwise("Polygon")).when(first == "Point", F.when(many, "MultiPoint").otherwise("Point")).otherwise(F.when(many, "MultiLineString").otherwise("LineString"))
    whole = F.forall(F.flatten(F.flatten("__parts")), lambda v: v["x"].isNotNull() & v["y"].isNotNull()) & F.forall(F.flatten("__parts"), lambda r: F.size(r) > 0)
    dim = F.when(kind.endswith("Polygon"), 2).when(kind.endswith("LineString"), 1).otherwise(0)
    g = F.when((F.size("__parts") > 0) & whole, G.named(kind=kind, dim=dim, parts=F.col("__parts")).cast(G.GEOMETRY))
    return rows.withColumn("__parts", parts).select(*[CASTS[t](F.col(c)).alias(c) for c, t in columns.items()], g.alias("geometry"))


# --- map data ---------------------------------------------------------------------------------------------------


def tag_filter(tags: Column, wanted: dict[str, str] | Sequence[dict[str, str]]) -> Column:
    """Whether a map of tags has all of a dict, or all of any dict of a list; * stands for any value."""
    def all_of(spec: dict[str, str]) -> Column:
        out = F.lit(True)
        for k, v in spec.items():
            out = out & (F.map_contains_key(tags, k) if v == "*" else F.coalesce(F.try_element_at(tags, F.lit(k)) == v, F.lit(False)))
        return out

    specs = [wanted] if isinstance(wanted, dict) else list(wanted)
    out = all_of(specs[0])
    for s in specs[1:]:
        out = out | all_of(s)
    return out


def read_osm(spark: SparkSession, path: str, tags: dict | Sequence[dict], kinds: Sequence[str] = (), columns: Sequence[str] = ()) -> DataFrame:
    """Objects of an extract kept as Parquet (tags map<string, string>, geometry), by tags and kinds of geometry."""
    rows = spark.read.parquet(path).filter(tag_filter(F.col("tags"), tags))
    if kinds:
        rows = rows.filter(F.col("geometry.kind").isin(*kinds))
    return rows.select(*[F.try_element_at("tags", F.lit(c)).alias(c) for c in columns], *(["tags"] if not columns else []), "geometry")


#: Rows that a region may have; they are sent to all tasks.
REGION_ROWS = 64


def region_filter(df: DataFrame, region: DataFrame, how: str = "intersects") -> DataFrame:
    """Rows that meet the region, all of its polygon rows together: by bounding boxes, or exactly, its border included."""
    if region.limit(REGION_ROWS + 1).count() > REGION_ROWS:
        raise ValueError(f"a region has up to {REGION_ROWS} rows; join with larger layers by spatial_join or clip")
    b, r = G.bbox(F.col("geometry")), region.select(F.col("geometry").alias("__r"), G.bbox(F.col("geometry")).alias("__rb"))
    near = (b.xmin <= F.col("__rb.xmax")) & (b.xmax >= F.col("__rb.xmin")) & (b.ymin <= F.col("__rb.ymax")) & (b.ymax >= F.col("__rb.ymin"))
    test = near if how == "bbox" else near & G.intersects(F.col("geometry"), F.col("__r"))
    return df.join(F.broadcast(r), test, "left_semi")


def places(spark: SparkSession, named: Sequence[tuple[str, float, float]]) -> DataFrame:
    """A layer of (name, lon, lat)."""
    rows = spark.createDataFrame([(n, float(x), float(y)) for n, x, y in named], "name string, lon double, lat double")
    return rows.withColumn("geometry", G.point(F.col("lon"), F.col("lat")))


_SHAPES = {1: "Point", 3: "MultiLineString", 5: "MultiPolygon", 8: "MultiPoint"}


def _shp(content: bytes) -> Iterator[dict | None]:
    """Geometries of a .shp file; Z and M values are passed over."""
    at = 100
    while at + 8 <= len(content):
        (size,) = struct.unpack_from(">i", content, at + 4)
        at += 8
        (code,) = struct.unpack_from("<i", content, at)
        kind = _SHAPES.get(code % 10)
        if kind is None:
            yield None
        elif kind == "Point":
            x, y = struct.unpack_from("<2d", content, at + 4)
            yield {"kind": kind, "dim": 0, "parts": [[[{"x": x, "y": y}]]]}
        elif kind == "MultiPoint":
            (n,) = struct.unpack_from("<i", content, at + 36)
            p = np.frombuffer(content, "<f8", 2 * n, at + 40).reshape(n, 2)
            yield {"kind": kind, "dim": 0, "parts": [[[{"x": float(x), "y": float(y)}]] for x, y in p]}
        else:
            m, n = struct.unpack_from("<2i", content, at + 36)
            starts = [*struct.unpack_from(f"<{m}i", content, at + 44), n]
            p = np.frombuffer(content, "<f8", 2 * n, at + 44 + 4 * m).reshape(n, 2)
            rings = [[{"x": float(x), "y": float(y)} for x, y in p[a:b]] for a, b in zip(starts, starts[1:], strict=False)]
            if kind == "MultiLineString":
                yield {"kind": kind, "dim": 1, "parts": [[r] for r in rings]}
            else:
                parts: list = []
                for r in rings:  # outer rings turn clockwise; holes follow theirs
                    turn = sum(a["x"] * b["y"] - b["x"] * a["y"] for a, b in zip(r, r[1:], strict=False))
                    if turn <= 0 or not parts:
                        parts.append([r])
                    else:
                        parts[-1].append(r)
                yield {"kind": kind, "dim": 2, "parts": parts}
        at += 2 * size


def _dbf(content: bytes, names: Sequence[str], encoding: str | None = None) -> Iterator[list[str | None]]:
    """Fields ``names`` of each record as text, null where blank; in the order of the shapes, deleted ones too."""
    n, start, size = struct.unpack_from("<IHH", content, 4)
    fields, at, where = {}, 32, 1
    while content[at] != 0x0D:
        name = content[at : at + 11].split(b"\0")[0].decode("latin-1")
        fields[name.lower()] = (where, content[at + 16])
        where += content[at + 16]
        at += 32
    if missing := [c for c in names if c.lower() not in fields]:
        raise ValueError(f"no field {', '.join(missing)} among {', '.join(fields)}")

    def text(raw: bytes) -> str | None:
        try:
            out = raw.decode(encoding or "utf-8")
        except UnicodeDecodeError:
            out = raw.decode("latin-1")
        return out.strip(" \0") or None

    for i in range(n):
        record = content[start + i * size : start + (i + 1) * size]
        yield [text(record[a : a + k]) for a, k in (fields[c.lower()] for c in names)]


def read_shp(spark: SparkSession, path: str, columns: dict[str, str] | None = None, encoding: str | None = None) -> DataFrame:
    """(position, columns, geometry) of the .shp files of a path; null shapes have no geometry.

    columns ({name: type}) are fields of the .dbf file beside each. Its encoding is the one given, or that of the .cpg file
    beside it, or UTF-8, or Latin-1 where that fails.
    """
    names = list(columns or {})

    def beside(shp: str, ending: str) -> bytes | None:
        from pyarrow import fs

        url = urlparse(shp)
        store, name = (fs.LocalFileSystem(), unquote(url.path)) if url.scheme in ("", "file") else fs.FileSystem.from_uri(shp.replace("s3a://", "s3://", 1))
        for end in (ending, ending.upper()):
            if store.get_file_info(name[:-3] + end).type == fs.FileType.File:
                with store.open_input_file(name[:-3] + end) as f:
                    return f.read()
        return None

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for shp, content in zip(f["path"], map(bytes, f["content"]), strict=True):
                shapes = list(_shp(content))
                out = pd.DataFrame({"position": range(len(shapes))})
                if names:
                    table = beside(shp, "dbf")
                    if table is None:
                        raise ValueError(f"{shp} has no .dbf file beside it")
                    code = encoding or (beside(shp, "cpg") or b"").decode("ascii", "ignore").strip() or None
                    rows = list(_dbf(table, names, code))
                    if len(rows) != len(shapes):
                        raise ValueError(f"{shp} has {len(shapes)} shapes, its .dbf file {len(rows)} records")
                    out[names] = pd.DataFrame(rows, columns=names, dtype=object)
                out["geometry"] = shapes
                yield out

    fields = "".join(f"`{n}` string, " for n in names)
    rows = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, f"position long, {fields}geometry {G.GEOMETRY}")
    return rows.select("position", *[CASTS[t](F.col(n)).alias(n) for n, t in (columns or {}).items()], "geometry")


# --- archives and look-up by extension ------------------------------------------------------------------------------

#: What a file's ending says, and the endings of files that belong to it.
ENDINGS = {"csv": "csv", "geojson": "geojson", "json": "geojson", "shp": "shp", "gml": "gml", "xml": "gml", "gpkg": "gpkg", "tif": "tif", "tiff": "tif", "xlsx": "xlsx", "sqlite": "sqlite", "db": "sqlite", "sql": "sql"}
BESIDE = {"shp": ("dbf", "shx", "cpg", "prj")}


def unzipped(spark: SparkSession, path: str, member: str | None = None, kinds: Sequence[str] = tuple(ENDINGS)) -> str:
    """The address of a member of a ZIP archive, unpacked by a task into the shared folder with what belongs to it.

    Without ``member`` the archive must have just one file with an ending of ``kinds``; none or several are an error that
    names them.
    """
    from geoloom.plans.stages import shared_dir
    from geoloom.sources.geotiff import write_file

    folder = f"{shared_dir(spark)}/unzipped-{uuid.uuid4().hex}"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for content in map(bytes, f["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    names = [n for n in z.namelist() if not n.endswith("/")]
                    found = [n for n in names if n == member] if member else [n for n in names if n.rpartition(".")[2].lower() in kinds]
                    if len(found) != 1:
                        raise ValueError(f"{'no' if not found else 'more than one'} member for it among {sorted(names)}; name one")
                    stem, _, ending = found[0].rpartition(".")
                    for n in names:
                        if n == found[0] or (n.rpartition(".")[0] == stem and n.rpartition(".")[2].lower() in BESIDE.get(ending.lower(), ())):
                            write_file(f"{folder}/{n.rpartition('/')[2]}", z.read(n))
                    yield pd.DataFrame({"name": [found[0].rpartition("/")[2]]})

    made = spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "name string").collect()  # one row
    if len(made) != 1:
        raise ValueError(f"{path} is {len(made)} archives")
    return f"{folder}/{made[0].name}"


def read_file(spark: SparkSession, path: str, kind: str | None = None, member: str | None = None, **how) -> DataFrame:
    """A layer or table by its file's ending (or kind, which goes before it); a ZIP archive's by that of its member.

    how: the arguments of the reader, such as columns for geojson or layer and names for gpkg.
    """
    from geoloom.sources.geotiff import read_tif

    ending = path.rpartition(".")[2].lower()
    if ending == "zip":
        wanted = [e for e, k in ENDINGS.items() if k == kind] if kind else list(ENDINGS)
        path = unzipped(spark, path, member, wanted)
        ending = path.rpartition(".")[2].lower()
    elif member:
        raise ValueError("only an archive has members")
    kind = kind or ENDINGS.get(ending)
    readers = {"csv": read_csv, "geojson": read_geojson, "shp": read_shp, "gml": read_gml, "gpkg": read_gpkg, "tif": read_tif, "xlsx": read_xlsx, "sqlite": read_sqlite, "sql": read_sql_dump, "fwf": read_fwf}
    if kind not in readers:
        raise ValueError(f"no reader for the ending {ending!r}; name a kind of {', '.join(readers)}")
    return readers[kind](spark, path, **how)
