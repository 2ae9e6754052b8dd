"""GeoTIFF files by tiles, read and written by many tasks.

A header pass makes a row for each tile (or strip) that a window meets: where its bytes are, and how they are packed. Tasks
then read these byte ranges by position, unpack them and give cells, or sums over blocks of cells where a coarser
resolution is asked for; bands that aren't chosen are dropped there, or not read at all where the file keeps bands apart.
So one large file is read by as many tasks as it has tiles, and a window costs only its tiles.

A raster is written as one GeoTIFF for each block of the grid, by the task that holds the block's cells, and an index
(mosaic.vrt) that makes one raster of them.
"""

from __future__ import annotations

import math
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from urllib.parse import unquote, urlparse

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.operators.raster import Grid

# Fixed values: (sample format, bits) of the tags 339 and 258, and the sizes of field types.
_TYPES = {(1, 8): "u1", (1, 16): "u2", (1, 32): "u4", (2, 8): "i1", (2, 16): "i2", (2, 32): "i4", (3, 32): "f4", (3, 64): "f8"}
_FIELDS = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
_PACKED = {1: "plain", 5: "lzw", 8: "deflate", 32946: "deflate", 32773: "packbits", 50000: "zstd"}
#: A part of a cell by which the edge of a window may miss a whole cell.
NEARLY = 1e-6
#: Bytes of tiles, as packed, that a task reads, about.
TASK_BYTES = 16 << 20

ReadAt = Callable[[int, int], bytes]


def read_at(path: str) -> ReadAt:
    """Reads (offset, size) of a file that pyarrow's file systems know: local, HDFS, S3, GCS."""
    from pyarrow import fs

    url = urlparse(path)
    if url.scheme in ("", "file"):
        files, name = fs.LocalFileSystem(), unquote(url.path)
    else:
        files, name = fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))
    f = files.open_input_file(name)
    return lambda at, size: f.read_at(size, at)


@dataclass(frozen=True)
class Head:
    """The first image of a TIFF and its grid."""

    order: str
    rows: int
    cols: int
    tile_rows: int
    tile_cols: int
    bands: int
    kind: str
    packed: str
    predictor: int
    apart: bool  # bands are kept in tiles of their own
    x0: float
    y0: float
    dx: float
    dy: float
    nodata: float | None
    epsg: int | None
    metres: bool
    offsets: tuple
    sizes: tuple


def head(at: ReadAt) -> Head:
    """The header, in classic or big form; reads its bytes only."""
    start = at(0, 16)
    e = "<" if start[:2] == b"II" else ">"
    (magic,) = struct.unpack_from(e + "H", start, 2)
    if start[:2] not in (b"II", b"MM") or magic not in (42, 43):
        raise ValueError("not a TIFF file")
    big = magic == 43
    (where,) = struct.unpack_from(e + ("Q" if big else "I"), start, 8 if big else 4)
    count, entry, inline, pointer = (e + "Q", 20, 8, "Q") if big else (e + "H", 12, 4, "I")
    size = struct.calcsize(count)
    (n,) = struct.unpack(count, at(where, size))
    block, tags = at(where + size, n * entry), {}
    for i in range(n):
        tag, kind, times = struct.unpack_from(e + "HH" + pointer, block, i * entry)
        if kind not in _FIELDS:
            continue
        code = f"{e}{times}s" if kind == 2 else e + ("II" * times if kind == 5 else f"{times}{_FIELDS[kind]}")
        value = block[i * entry + entry - inline : (i + 1) * entry]
        if (length := struct.calcsize(code)) > inline:
            value = at(struct.unpack(e + pointer, value)[0], length)
        tags[tag] = struct.unpack_from(code, value)
    one = lambda tag, other: tags.get(tag, (other,))[0]
    scale, tie = tags.get(33550, (1.0, 1.0, 0.0)), tags.get(33922, (0.0,) * 6)
    if 34264 in tags:
        m = tags[34264]
        if m[1] or m[4]:
            raise ValueError("rotated rasters are not read")
        scale, tie = (m[0], -m[5], 0.0), (0.0, 0.0, 0.0, m[3], m[7], 0.0)
    keys = tags.get(34735, ())
    geo = {keys[i]: keys[i + 3] for i in range(4, len(keys) - 3, 4) if keys[i + 1] == 0}
    tiled, packed = 322 in tags, one(259, 1)
    if packed not in _PACKED or one(317, 1) not in (1, 2, 3) or (one(339, 1), one(258, 1)) not in _TYPES:
        raise ValueError(f"compression {packed}, predictor {one(317, 1)} or samples of {one(258, 1)} bits (format {one(339, 1)}) are not read")
    rows, cols, none = one(257, 0), one(256, 0), tags.get(42113)
    return Head(
        e, rows, cols, one(323, 0) if tiled else min(one(278, rows), rows), one(322, 0) if tiled else cols, one(277, 1), _TYPES[one(339, 1), one(258, 1)], _PACKED[packed], one(317, 1), one(284, 1) == 2 and one(277, 1) > 1,
        tie[3] - tie[0] * scale[0], tie[4] + tie[1] * scale[1], scale[0], scale[1], float(none[0].split(b"\0")[0]) if none else None,
        geo.get(3072, geo.get(2048)), geo.get(1024) == 1 and geo.get(3076, 9001) == 9001, tags[324 if tiled else 273], tags[325 if tiled else 279],
    )


def unpack_lzw(data: bytes) -> bytes:
    """LZW with codes of 9 to 12 bits, highest bit first; 256 clears the table, 257 ends."""
    table, out, held, bits, width, before = [bytes((i,)) for i in range(256)] + [b"", b""], [], 0, 0, 9, b""
    for byte in data:
        held, bits = held << 8 | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, held = held >> bits, held & ((1 << bits) - 1)
        if code == 257:
            break
        if code == 256:
            del table[258:]
            width, before = 9, b""
            continue
        now = table[code] if code < len(table) else before + before[:1]
        out.append(now)
        if before:
            table.append(before + now[:1])
        before = now
        if len(table) + 1 >= 1 << width and width < 12:
            width += 1
    return b"".join(out)


def unpack_bits(data: bytes) -> bytes:
    """PackBits: n + 1 bytes as they are, or one byte 257 - n times."""
    out, i = [], 0
    while i < len(data):
        n = data[i]
        if n < 128:
            out.append(data[i + 1 : i + 2 + n])
            i += 2 + n
        else:
            out.append(data[i + 1 : i + 2] * (257 - n) if n > 128 else b"")
            i += 2 if n > 128 else 1
    return b"".join(out)


def unpack(data: bytes, h: dict, bands: int) -> np.ndarray:
    """(rows, columns, bands) of a tile; a last strip may have fewer rows."""
    if h["packed"] == "deflate":
        data = zlib.decompress(data)
    elif h["packed"] == "zstd":
        import zstandard

        data = zstandard.ZstdDecompressor().decompressobj().decompress(data)
    elif h["packed"] != "plain":
        data = {"lzw": unpack_lzw, "packbits": unpack_bits}[h["packed"]](data)
    kind, w = np.dtype(h["order"] + h["kind"]), h["tile_cols"]
    row = w * bands * kind.itemsize
    data = data[: len(data) // row * row]
    if h["predictor"] == 3:  # bytes of equal weight stand together, highest first, as differences
        b = np.cumsum(np.frombuffer(data, np.uint8).reshape(-1, kind.itemsize * w, bands), 1, dtype=np.uint8)
        b = b.reshape(len(b), kind.itemsize, w * bands).transpose(0, 2, 1)
        return np.ascontiguousarray(b).view(f">{h['kind']}").reshape(-1, w, bands)
    block = np.frombuffer(data, kind).reshape(-1, w, bands)
    return np.cumsum(block, 1, dtype=kind) if h["predictor"] == 2 else block


def window_of(h: Head, box: Sequence[float] | None, block: tuple[int, int] = (1, 1)) -> tuple[int, int, int, int]:
    """(first row, first column, end row, end column) of the whole cells, and whole blocks of cells, that a box (x0, y0, x1,
    y1) meets; all of the file without a box.
    """
    if box is None:
        return 0, 0, h.rows, h.cols
    c0, c1 = (box[0] - h.x0) / h.dx, (box[2] - h.x0) / h.dx
    r0, r1 = (h.y0 - box[3]) / h.dy, (h.y0 - box[1]) / h.dy
    low = lambda v, n: max(0, math.floor(v + NEARLY)) // n * n
    high = lambda v, n, most: min(most, -(-max(0, math.ceil(v - NEARLY)) // n) * n)
    return low(r0, block[0]), low(c0, block[1]), high(r1, block[0], h.rows), high(c1, block[1], h.cols)


def block_of(h: Head, resolution: float | None) -> tuple[int, int]:
    """Cells (down, across) of a block of this size in metres, a whole number of them."""
    if resolution is None:
        return 1, 1
    if not h.metres:
        raise ValueError("a resolution in metres needs a raster in a projection in metres")
    out = []
    for cell in (h.dy, h.dx):
        n = round(resolution / abs(cell))
        if n < 1 or abs(resolution / abs(cell) - n) > NEARLY * max(1.0, resolution / abs(cell)):
            raise ValueError(f"the resolution {resolution:g} m is no multiple of the cells' {abs(cell):g} m")
        out.append(n)
    return out[0], out[1]


_TILE = (
    "path string, row long, col long, offsets array<long>, sizes array<long>, r0 long, c0 long, r1 long, c1 long, down long, across long, shift_row long, shift_col long, "
    "order string, kind string, packed string, predictor int, apart boolean, bands int, tile_cols long, rows long, cols long, nodata double"
)


def tif_tiles(spark: SparkSession, path: str, window: Sequence[float] | None = None, bands: Sequence[int] | None = None, resolution: float | None = None, grid: Grid | None = None) -> DataFrame:
    """A row for each tile of the files at path that the window (x0, y0, x1, y1) meets, with the byte ranges to be read."""
    names = [n.split()[0] for n in _TILE.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for p in f["path"]:
                h = head(read_at(p))
                down, across = block_of(h, resolution)
                shift = (0, 0)
                if grid is not None:
                    cell, at = grid.cell, ((grid.y0 - h.y0) / grid.cell, (h.x0 - grid.x0) / grid.cell)
                    shift = tuple(round(v) for v in at)
                    if max(abs(h.dx * across - cell), abs(h.dy * down - cell)) > NEARLY * cell or max(abs(a - s) for a, s in zip(at, shift, strict=True)) > 1e-3:
                        raise ValueError(f"{p} doesn't lie on the grid that is asked for")
                r0, c0, r1, c1 = window_of(h, window, (down, across))
                wide, long = -(-h.cols // h.tile_cols), -(-h.rows // h.tile_rows)
                asked = [b - 1 for b in bands or range(1, h.bands + 1)] if h.apart else [0]
                out = []
                for i in range(r0 // h.tile_rows, -(-r1 // h.tile_rows)) if c0 < c1 else ():
                    for j in range(c0 // h.tile_cols, -(-c1 // h.tile_cols)):
                        of = [b * wide * long + i * wide + j for b in asked]
                        out.append((
                            p, i * h.tile_rows, j * h.tile_cols, [h.offsets[k] for k in of], [h.sizes[k] for k in of], r0, c0, r1, c1, down, across, *shift,
                            h.order, h.kind, h.packed, h.predictor, h.apart, h.bands, h.tile_cols, h.rows, h.cols, h.nodata,
                        ))
                yield pd.DataFrame(out, columns=names).astype({"nodata": "float64"})

    return spark.read.format("binaryFile").load(path).select("path").mapInPandas(run, _TILE)


def _cells(t: dict, at: ReadAt, bands: Sequence[int], names: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, col, values (bands, rows, cols)) of the part of a tile in the window; nodata is NaN."""
    parts = [unpack(at(o, n), t, 1 if t["apart"] else t["bands"]) if n else None for o, n in zip(t["offsets"], t["sizes"], strict=True)]
    whole = next((p for p in parts if p is not None), None)
    shape = (min(whole.shape[0] if whole is not None else t["rows"], t["rows"] - t["row"]), min(t["tile_cols"], t["cols"] - t["col"]))
    values = np.full((len(bands), *shape), np.nan)
    for k, b in enumerate(bands):
        p = parts[k if t["apart"] else 0]
        if p is not None:  # a tile without bytes has no data
            values[k] = p[: shape[0], : shape[1], 0 if t["apart"] else b - 1]
    if t["nodata"] is not None and not math.isnan(t["nodata"]):
        values[values == t["nodata"]] = np.nan
    values[~np.isfinite(values)] = np.nan
    a, b = max(0, t["r0"] - t["row"]), min(shape[0], t["r1"] - t["row"])
    c, d = max(0, t["c0"] - t["col"]), min(shape[1], t["c1"] - t["col"])
    return np.arange(t["row"] + a, t["row"] + b), np.arange(t["col"] + c, t["col"] + d), values[:, a:b, c:d]


def read_tif(
    spark: SparkSession,
    path: str,
    band_names: Sequence[str] = ("band",),
    window: Sequence[float] | None = None,
    bands: Sequence[int] | None = None,
    resolution: float | None = None,
    aggregation: str = "sum",
    grid: Grid | None = None,
) -> DataFrame:
    """(row, col, band_names) of the cells in the window (x0, y0, x1, y1; all without one); nodata and NaN are null.

    bands are numbers from 1, by default the first ones. With a resolution in metres, a multiple of the cells', blocks of
    cells are one: the sum or mean of those that have a value, null without any; blocks start at the file's corner, so they
    don't depend on the window. Rows and columns count from the file's corner, or are those of ``grid``, on which several
    files make one raster. A file whose projection isn't in metres takes no resolution; rotated files are refused.
    """
    if aggregation not in ("sum", "mean"):
        raise ValueError("aggregation is sum or mean")
    names, picked = list(band_names), list(bands or range(1, len(band_names) + 1))
    if len(names) != len(picked):
        raise ValueError("as many band names as bands")
    tiles = tif_tiles(spark, path, window, picked, resolution, grid)
    held = tiles.agg(F.count("*"), F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, b: a + b))).first()  # one row
    tasks = max(1, min(held[0], max(-(-(held[1] or 0) // TASK_BYTES), spark.sparkContext.defaultParallelism)))
    sums, counts = [f"{n}__sum" for n in names], [f"{n}__n" for n in names]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        opened: dict[str, ReadAt] = {}
        for f in frames:
            for t in f.to_dict("records"):
                if t["path"] not in opened:
                    opened = {t["path"]: read_at(t["path"])}
                rows, cols, values = _cells(t, opened[t["path"]], picked, names)
                if not values.size:
                    continue
                if resolution is None:
                    r, c = np.meshgrid(rows + t["shift_row"], cols + t["shift_col"], indexing="ij")
                    yield pd.DataFrame({"row": r.ravel(), "col": c.ravel()} | {n: v.ravel() for n, v in zip(names, values, strict=True)})
                    continue
                down, across = rows // t["down"], cols // t["across"]
                first_r, first_c, wide = down[0], across[0], int(across[-1] - across[0]) + 1
                at = ((down - first_r)[:, None] * wide + across - first_c).ravel()
                size = (int(down[-1] - first_r) + 1) * wide
                block = np.arange(size)
                out = {"row": block // wide + first_r + t["shift_row"], "col": block % wide + first_c + t["shift_col"]}
                for v, s, n in zip(values, sums, counts, strict=True):
                    good = np.isfinite(v.ravel())
                    out[s], out[n] = np.bincount(at[good], v.ravel()[good], size), np.bincount(at[good], minlength=size)
                yield pd.DataFrame(out)

    tiles = tiles.repartition(tasks)
    if resolution is None:
        cells = tiles.mapInPandas(run, "row long, col long, " + ", ".join(f"`{n}` double" for n in names))
        return cells.withColumns({n: F.when(~F.isnan(n), F.col(f"`{n}`")) for n in names})
    parts = tiles.mapInPandas(run, "row long, col long, " + ", ".join([f"`{s}` double, `{n}` long" for s, n in zip(sums, counts, strict=True)]))
    total = parts.groupBy("row", "col").agg(*[F.sum(c).alias(c) for c in [*sums, *counts]])
    value = {"sum": lambda s, n: F.col(s), "mean": lambda s, n: F.col(s) / F.col(n)}[aggregation]
    return total.select("row", "col", *[F.when(F.col(n) > 0, value(s, n)).alias(name) for name, s, n in zip(names, sums, counts, strict=True)])


def tif_grid(path: str, resolution: float | None = None) -> Grid:
    """The grid of a file, or of its blocks at a resolution; reads the header."""
    h = head(read_at(path))
    if abs(h.dx - h.dy) > NEARLY * abs(h.dx):
        raise ValueError("cells are not square")
    down, across = block_of(h, resolution)
    return Grid(h.x0, h.y0, h.dx * across, -(-h.rows // down), -(-h.cols // across))


# --- writing ------------------------------------------------------------------------------------------------------


def encode_tif(data: np.ndarray, x0: float, y0: float, cell: float, epsg: int, nodata: float, strip_cells: int = 1 << 16) -> bytes:
    """A deflated GeoTIFF of data (rows, cols, bands) of float32 or float64, in strips of about strip_cells cells."""
    rows, cols, bands = data.shape
    per = max(1, min(rows, strip_cells // max(1, cols)))
    strips = [zlib.compress(np.ascontiguousarray(data[i : i + per]).astype(data.dtype.newbyteorder("<")).tobytes(), 6) for i in range(0, rows, per)]
    starts = np.cumsum([8, *map(len, strips)]).tolist()
    geographic = epsg == 4326
    keys = (1, 1, 0, 3, 1024, 0, 1, 2 if geographic else 1, 1025, 0, 1, 1, 2048 if geographic else 3072, 0, 1, epsg)
    tags = [
        (256, "I", (cols,)), (257, "I", (rows,)), (258, "H", (8 * data.dtype.itemsize,) * bands), (259, "H", (8,)), (262, "H", (1,)), (273, "I", tuple(starts[:-1])),
        (277, "H", (bands,)), (278, "I", (per,)), (279, "I", tuple(map(len, strips))), (284, "H", (1,)), (339, "H", (3,) * bands),
        (33550, "d", (cell, cell, 0.0)), (33922, "d", (0.0, 0.0, 0.0, x0, y0, 0.0)), (34735, "H", keys), (42113, "s", f"{nodata:g}\0".encode()),
    ]
    ids = {"H": 3, "I": 4, "d": 12, "s": 2}
    at = starts[-1] + starts[-1] % 2
    more, entries, end = b"", b"", at + 2 + 12 * len(tags) + 4
    for tag, code, values in tags:
        raw = values if code == "s" else struct.pack(f"<{len(values)}{code}", *values)
        entries += struct.pack("<HHI", tag, ids[code], len(values))
        entries += raw.ljust(4, b"\0") if len(raw) <= 4 else struct.pack("<I", end + len(more))
        more += raw + b"\0" * (len(raw) % 2) if len(raw) > 4 else b""
    body = b"II*\0" + struct.pack("<I", at) + b"".join(strips)
    return body.ljust(at, b"\0") + struct.pack("<H", len(tags)) + entries + struct.pack("<I", 0) + more


def write_file(path: str, data: bytes) -> None:
    """All of data or nothing, over what an earlier attempt left."""
    from pyarrow import fs

    url = urlparse(path)
    if url.scheme in ("", "file"):
        files, name = fs.LocalFileSystem(), unquote(url.path)
        files.create_dir(name.rpartition("/")[0])
        part = f"{name}.{uuid.uuid4().hex}"
        with files.open_output_stream(part) as f:
            f.write(data)
        files.move(part, name)
    else:
        files, name = fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))
        with files.open_output_stream(name) as f:
            f.write(data)


def write_tifs(cells: DataFrame, bands: Sequence[str], grid: Grid, epsg: int, folder: str, nodata: float = -9999.0, block: int = 1024) -> DataFrame:
    """Write a raster as GeoTIFFs of up to block x block cells and mosaic.vrt, which names them; gives (file, row, col, n).

    Cells outside the grid are an error; blocks without a cell get no file. A block is 4 MB a band, whatever the raster's size.
    """
    side = int(block)
    inside = F.col("row").between(0, grid.rows - 1) & F.col("col").between(0, grid.cols - 1)
    rows = cells.select(F.when(inside, F.col("row")).otherwise(F.raise_error(F.lit("a cell outside the grid"))).alias("row"), "col", *[F.col(b).cast("double").alias(b) for b in bands])
    rows = rows.withColumns({"br": F.floor(F.col("row") / side), "bc": F.floor(F.col("col") / side)})

    def run(f: pd.DataFrame) -> pd.DataFrame:
        r, c = int(f["br"].iloc[0]) * side, int(f["bc"].iloc[0]) * side
        data = np.full((min(side, grid.rows - r), min(side, grid.cols - c), len(bands)), nodata, np.float32)
        for i, b in enumerate(bands):
            data[f["row"] - r, f["col"] - c, i] = f[b].fillna(nodata)
        name = f"r{r}_c{c}.tif"
        write_file(f"{folder}/{name}", encode_tif(data, grid.x0 + c * grid.cell, grid.y0 - r * grid.cell, grid.cell, epsg, nodata))
        return pd.DataFrame({"file": [name], "row": [r], "col": [c], "n": [len(f)], "rows": [data.shape[0]], "cols": [data.shape[1]]})

    made = rows.groupBy("br", "bc").applyInPandas(run, "file string, row long, col long, n long, rows long, cols long")
    found = sorted(map(tuple, made.collect()), key=lambda t: (t[1], t[2]))  # a row for each file
    part = lambda b: "".join(
        f'<SimpleSource><SourceFilename relativeToVRT="1">{n}</SourceFilename><SourceBand>{b}</SourceBand><SrcRect xOff="0" yOff="0" xSize="{w}" ySize="{h}"/><DstRect xOff="{c}" yOff="{r}" xSize="{w}" ySize="{h}"/></SimpleSource>'
        for n, r, c, _, h, w in found
    )
    bands_ = "".join(f'<VRTRasterBand dataType="Float32" band="{i}"><NoDataValue>{nodata:g}</NoDataValue>{part(i)}</VRTRasterBand>' for i in range(1, len(bands) + 1))
    index = f'<VRTDataset rasterXSize="{grid.cols}" rasterYSize="{grid.rows}"><SRS>EPSG:{epsg}</SRS><GeoTransform>{grid.x0}, {grid.cell}, 0, {grid.y0}, 0, {-grid.cell}</GeoTransform>{bands_}</VRTDataset>'
    write_file(f"{folder}/mosaic.vrt", index.encode())
    return cells.sparkSession.createDataFrame([t[:4] for t in found], "file string, row long, col long, n long")
