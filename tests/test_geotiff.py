"""GeoTIFFs of all layouts, windows that read only their tiles, blocks at a resolution, and rasters written by blocks."""

import os
import struct
import zlib

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from geoloom.operators.raster import Grid
from geoloom.sources import geotiff

X0, Y0, CELL = 4_000_000.0, 3_000_000.0, 100.0


def lzw(data):
    """Encode with codes of 9 to 12 bits."""
    out, held, bits = bytearray(), 0, 0

    def put(code, width):
        nonlocal held, bits
        held, bits = held << width | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits & 255)
        held &= (1 << bits) - 1

    table, width, word = {bytes((i,)): i for i in range(256)}, 9, b""
    n = 258
    put(256, 9)
    for b in data:
        more = word + bytes((b,))
        if more in table:
            word = more
            continue
        put(table[word], width)
        table[more] = n
        n += 1
        word = bytes((b,))
        if n + 1 > 1 << width:
            width += 1
        if n >= 4094:
            put(table[word], width)
            put(256, width)
            table, width, word, n = {bytes((i,)): i for i in range(256)}, 9, b"", 258
    if word:
        put(table[word], width)
        n += 1
        if n + 1 > 1 << width and width < 12:
            width += 1
    put(257, width)
    put(0, 7)
    return bytes(out)


def packbits(data):
    return b"".join(bytes((len(data[i : i + 100]) - 1,)) + data[i : i + 100] for i in range(0, len(data), 100))


PACK = {1: bytes, 5: lzw, 8: zlib.compress, 32773: packbits, 50000: zstandard.ZstdCompressor().compress}


def tif(data, tile=None, strip=7, packed=8, predictor=1, apart=False, big=False, order="<", nodata=None, epsg=3035):
    """A file with data (rows, cols, bands) in tiles (rows, cols) or strips."""
    rows, cols, bands = data.shape
    kind = data.dtype.newbyteorder(order)
    h, w = tile or (strip, cols)
    chunks = []
    for planes in [[b] for b in range(bands)] if apart else [list(range(bands))]:
        for r in range(0, rows, h):
            for c in range(0, cols, w):
                part = data[r : r + h, c : c + w][:, :, planes]
                if tile:
                    part = np.pad(part, ((0, h - part.shape[0]), (0, w - part.shape[1]), (0, 0)))
                if predictor == 2:
                    part = np.concatenate([part[:, :1], np.diff(part, axis=1)], 1).astype(data.dtype)
                raw = np.ascontiguousarray(part.astype(kind))
                if predictor == 3:
                    planes_ = raw.astype(raw.dtype.newbyteorder(">")).view(np.uint8).reshape(len(part), -1, raw.dtype.itemsize).transpose(0, 2, 1).reshape(len(part), -1, len(planes))
                    raw = np.concatenate([planes_[:, :1], np.diff(planes_, axis=1)], 1)
                chunks.append(PACK[packed](raw.tobytes()))
    fmt = {"u": 1, "i": 2, "f": 3}[data.dtype.kind]
    head = 16 if big else 8
    starts = np.cumsum([head, *map(len, chunks)]).tolist()
    keys = (1, 1, 0, 3, 1024, 0, 1, 2 if epsg == 4326 else 1, 1025, 0, 1, 1, 2048 if epsg == 4326 else 3072, 0, 1, epsg)
    ptr = "Q" if big else "I"
    where = [(322, "I", (w,)), (323, "I", (h,)), (324, ptr, starts[:-1]), (325, ptr, list(map(len, chunks)))] if tile else [(273, ptr, starts[:-1]), (278, "I", (h,)), (279, ptr, list(map(len, chunks)))]
    tags = [(256, "I", (cols,)), (257, "I", (rows,)), (258, "H", (8 * data.dtype.itemsize,) * bands), (259, "H", (packed,)), (277, "H", (bands,)), (284, "H", (2 if apart else 1,)), (317, "H", (predictor,)), (339, "H", (fmt,) * bands), *where]
    tags += [(33550, "d", (CELL, CELL, 0.0)), (33922, "d", (0.0, 0.0, 0.0, X0, Y0, 0.0)), (34735, "H", keys)] + ([(42113, "s", f"{nodata}\0".encode())] if nodata is not None else [])
    tags.sort()
    ids, inline = {"H": 3, "I": 4, "d": 12, "s": 2, "Q": 16}, 8 if big else 4
    at = starts[-1]
    entries, more, end = b"", b"", at + (8 if big else 2) + (20 if big else 12) * len(tags) + inline
    for tag, code, values in tags:
        raw = values if code == "s" else struct.pack(f"{order}{len(values)}{code}", *values)
        entries += struct.pack(f"{order}HH{ptr}", tag, ids[code], len(values))
        entries += raw.ljust(inline, b"\0") if len(raw) <= inline else struct.pack(order + ptr, end + len(more))
        more += raw if len(raw) > inline else b""
    mark = b"II" if order == "<" else b"MM"
    start = mark + (struct.pack(order + "HHHQ", 43, 8, 0, at) if big else struct.pack(order + "HI", 42, at))
    return start + b"".join(chunks) + struct.pack(order + ("Q" if big else "H"), len(tags)) + entries + b"\0" * inline + more


def seen(df, *bands):
    return {(r.row, r.col): tuple(r[b] for b in bands) for r in df.collect()}


LAYOUTS = [
    {"packed": 1}, {"packed": 5}, {"packed": 8, "predictor": 2}, {"packed": 32773}, {"packed": 50000, "tile": (16, 16)}, {"tile": (16, 32), "predictor": 3, "kind": "f4"},
    {"tile": (32, 16), "apart": True, "order": ">", "kind": "i2"}, {"big": True, "tile": (16, 16), "kind": "f8"}, {"big": True, "order": ">", "predictor": 3, "kind": "f8", "packed": 5}, {"kind": "u1", "packed": 5, "predictor": 2},
]


@pytest.mark.parametrize("layout", LAYOUTS, ids=str)
def test_layouts(spark, tmp_path, layout):
    layout = dict(layout)
    kind = layout.pop("kind", "i4")
    rng = np.random.default_rng(1)
    data = rng.integers(0, 100, (37, 53, 3)).astype(kind)
    (tmp_path / "a.tif").write_bytes(tif(data, **layout))
    out = geotiff.read_tif(spark, str(tmp_path / "a.tif"), ["x", "z"], bands=[1, 3])
    got = seen(out, "x", "z")
    assert got == {(r, c): (float(data[r, c, 0]), float(data[r, c, 2])) for r in range(37) for c in range(53)}
    h = geotiff.head(geotiff.read_at(str(tmp_path / "a.tif")))
    assert (h.x0, h.y0, h.dx, h.epsg, h.metres, h.bands) == (X0, Y0, CELL, 3035, True, 3)


def test_window_reads_only_its_tiles(spark, tmp_path):
    rng = np.random.default_rng(2)
    data = rng.random((256, 320, 1)).astype("f4")
    whole = tif(data, tile=(32, 32))
    path = str(tmp_path / "a.tif")
    (tmp_path / "a.tif").write_bytes(whole)
    box = (X0 + 70 * CELL, Y0 - 100 * CELL, X0 + 130.4 * CELL, Y0 - 40 * CELL)  # columns 70-130, rows 40-99
    tiles = geotiff.tif_tiles(spark, path, box)
    found = tiles.select(F.col("offsets")[0].alias("at"), F.col("sizes")[0].alias("n")).collect()
    assert len(found) == 3 * 3 and sum(r.n for r in found) < len(whole) / 8
    # All other tiles' bytes are destroyed: whoever reads one fails.
    h = geotiff.head(geotiff.read_at(path))
    spoilt = bytearray(whole)
    for at, n in zip(h.offsets, h.sizes, strict=True):
        if at not in {r.at for r in found}:
            spoilt[at : at + n] = b"\xff" * n
    (tmp_path / "b.tif").write_bytes(spoilt)
    out = geotiff.read_tif(spark, str(tmp_path / "b.tif"), ["v"], window=box)
    assert seen(out, "v") == {(r, c): (float(data[r, c, 0]),) for r in range(40, 100) for c in range(70, 131)}
    assert geotiff.read_tif(spark, path, ["v"]).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert geotiff.read_tif(spark, path, ["v"], window=(0, 0, 1, 1)).count() == 0
    # The header pass lists files without their contents.
    assert "content" not in geotiff.tif_tiles(spark, path)._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[-1]


@pytest.mark.parametrize("how", ["sum", "mean"])
def test_blocks_at_a_resolution(spark, tmp_path, how):
    rng = np.random.default_rng(7)
    data = rng.uniform(0, 50, (25, 37, 1)).round(3)
    data[3:6, 4:9] = -200.0
    data[20:, 30:] = -200.0
    data[1, 1] = np.nan
    (tmp_path / "a.tif").write_bytes(tif(data, tile=(16, 16), nodata=-200.0))
    path = str(tmp_path / "a.tif")
    valid = ~np.isnan(data[:, :, 0]) & (data[:, :, 0] != -200)
    want = {}
    for r in range(3):
        for c in range(4):
            block, good = data[r * 10 : r * 10 + 10, c * 10 : c * 10 + 10, 0], valid[r * 10 : r * 10 + 10, c * 10 : c * 10 + 10]
            want[r, c] = getattr(block[good], how)() if good.any() else None
    got = seen(geotiff.read_tif(spark, path, ["v"], resolution=1000, aggregation=how), "v")
    assert set(got) == set(want) and all(got[k][0] == (pytest.approx(v) if v is not None else None) for k, v in want.items())
    assert geotiff.tif_grid(path, 1000) == Grid(X0, Y0, 1000.0, 3, 4)
    # A window takes whole blocks, those that it gives without it.
    box = (X0 + 1500, Y0 - 1200, X0 + 1700, Y0 - 900)
    part = seen(geotiff.read_tif(spark, path, ["v"], window=box, resolution=1000, aggregation=how), "v")
    assert set(part) == {(0, 1), (1, 1)} and all(part[k][0] == pytest.approx(want[k]) for k in part)
    with pytest.raises(Exception, match="no multiple"):
        geotiff.read_tif(spark, path, ["v"], resolution=150).count()
    (tmp_path / "d.tif").write_bytes(tif(data, epsg=4326))
    with pytest.raises(Exception, match="in metres"):
        geotiff.read_tif(spark, str(tmp_path / "d.tif"), ["v"], resolution=1000).count()
    with pytest.raises(ValueError, match="sum or mean"):
        geotiff.read_tif(spark, path, ["v"], aggregation="max")


def test_write_blocks_and_read_them_as_one(spark, tmp_path):
    grid = Grid(X0, Y0, CELL, 70, 90)
    cells = spark.range(70 * 90).select(F.floor(F.col("id") / 90).alias("row"), (F.col("id") % 90).alias("col"), (F.col("id") * 0.5).alias("a"), F.when(F.col("id") % 7 > 0, F.col("id") % 100).cast("double").alias("b"))
    cells = cells.filter("NOT (row < 32 AND col >= 64)")  # a block without a cell
    made = geotiff.write_tifs(cells, ["a", "b"], grid, 3035, str(tmp_path / "out"), block=32)
    assert [tuple(r) for r in made.select("file", "row", "col").collect()][:3] == [("r0_c0.tif", 0, 0), ("r0_c32.tif", 0, 32), ("r32_c0.tif", 32, 0)]
    assert sum(r.n for r in made.collect()) == cells.count()
    files = sorted(os.listdir(tmp_path / "out"))
    assert len(files) == 9 and "mosaic.vrt" in files and 'rasterXSize="90"' in (tmp_path / "out" / "mosaic.vrt").read_text()
    back = geotiff.read_tif(spark, str(tmp_path / "out" / "*.tif"), ["a", "b"], grid=grid)
    assert {k: v for k, v in seen(back, "a", "b").items() if v != (None, None)} == seen(cells, "a", "b")
    with pytest.raises(Exception, match="outside the grid"):
        geotiff.write_tifs(cells.withColumn("row", F.col("row") + 70), ["a"], grid, 3035, str(tmp_path / "no"), block=32)


def test_what_is_no_geotiff(spark, tmp_path):
    (tmp_path / "a.tif").write_bytes(b"GIF89a" + b"\0" * 100)
    with pytest.raises(Exception, match="not a TIFF"):
        geotiff.read_tif(spark, str(tmp_path / "a.tif")).count()
    with pytest.raises(ValueError, match="as many"):
        geotiff.read_tif(spark, str(tmp_path / "a.tif"), ["a"], bands=[1, 2])
