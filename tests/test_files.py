"""Attributes of shapefiles, GML of all kinds, archives and look-up by ending."""

import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from geoloom.functions import geometry as G
from geoloom.sources import files


def dbf(fields, rows, code="utf-8"):
    """A table of text fields [(name, size)]."""
    head = b"".join(n.encode().ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes((k, 0)) + b"\0" * 14 for n, k in fields)
    body = b"".join(b" " + b"".join((v or "").encode(code).ljust(k) for v, (_, k) in zip(r, fields, strict=True)) for r in rows)
    return struct.pack("<4BIHH20x", 3, 124, 1, 1, len(rows), 33 + len(head), 1 + sum(k for _, k in fields)) + head + b"\r" + body + b"\x1a"


def shp(points):
    return b"\0" * 100 + b"".join(struct.pack(">ii", i, 10) + struct.pack("<i2d", 1, *p) for i, p in enumerate(points, 1))


def test_shapefile_attributes(spark, tmp_path):
    (tmp_path / "a.shp").write_bytes(shp([(1, 2), (3, 4)]))
    (tmp_path / "a.dbf").write_bytes(dbf([("NAME", 12), ("pop", 6)], [("Größe", "12"), (None, "x")]))
    cols = {"name": "string", "POP": "integer"}
    out = files.read_shp(spark, str(tmp_path / "a.shp"), cols).orderBy("position").collect()
    assert [(r.position, r.name, r.POP, r.geometry.parts[0][0][0].y) for r in out] == [(0, "Größe", 12, 2.0), (1, None, None, 4.0)]
    (tmp_path / "a.dbf").write_bytes(dbf([("NAME", 12), ("pop", 6)], [("Größe", "12"), ("b", "1")], "cp1252"))
    (tmp_path / "a.cpg").write_bytes(b"cp1252\n")
    assert files.read_shp(spark, str(tmp_path / "a.shp"), cols).filter("name = 'Größe'").count() == 1
    with pytest.raises(Exception, match="no field depth"):
        files.read_shp(spark, str(tmp_path / "a.shp"), {"depth": "float"}).count()
    (tmp_path / "b.shp").write_bytes(shp([(1, 2)]))
    with pytest.raises(Exception, match="no .dbf file"):
        files.read_shp(spark, str(tmp_path / "b.shp"), cols).count()
    (tmp_path / "b.dbf").write_bytes(dbf([("NAME", 12), ("pop", 6)], []))
    with pytest.raises(Exception, match="1 shapes, its .dbf file 0 records"):
        files.read_shp(spark, str(tmp_path / "b.shp"), cols).count()


RING = "<gml:exterior><gml:LinearRing><gml:posList>0 0 4 0 4 4 0 4 0 0</gml:posList></gml:LinearRing></gml:exterior>"
HOLE = "<gml:interior><gml:LinearRing><gml:posList>1 1 1 2 2 2 1 1</gml:posList></gml:LinearRing></gml:interior>"
SHAPES = {
    "point": ("<gml:Point><gml:pos>1.5 2</gml:pos></gml:Point>", "POINT (1.5 2.0)"),
    "three": ('<gml:Point srsDimension="3"><gml:pos>1 2 9</gml:pos></gml:Point>', "POINT (1.0 2.0)"),
    "line": ("<gml:LineString><gml:posList>0 0 1 1\n 2 0</gml:posList></gml:LineString>", "LINESTRING (0.0 0.0, 1.0 1.0, 2.0 0.0)"),
    "old": ("<gml:LineString><gml:coordinates>0,0 1,1</gml:coordinates></gml:LineString>", "LINESTRING (0.0 0.0, 1.0 1.0)"),
    "single": ("<gml:LineString><gml:pos>0 0</gml:pos><gml:pos>5 1</gml:pos></gml:LineString>", "LINESTRING (0.0 0.0, 5.0 1.0)"),
    "curve": ("<gml:MultiCurve><gml:curveMember><gml:Curve><gml:segments><gml:LineStringSegment><gml:posList>0 0 1 1</gml:posList></gml:LineStringSegment></gml:segments></gml:Curve></gml:curveMember><gml:curveMember><gml:LineString><gml:posList>5 5 6 6</gml:posList></gml:LineString></gml:curveMember></gml:MultiCurve>", "MULTILINESTRING ((0.0 0.0, 1.0 1.0), (5.0 5.0, 6.0 6.0))"),
    "polygon": (f"<gml:Polygon>{RING}{HOLE}</gml:Polygon>", "POLYGON ((0.0 0.0, 4.0 0.0, 4.0 4.0, 0.0 4.0, 0.0 0.0), (1.0 1.0, 1.0 2.0, 2.0 2.0, 1.0 1.0))"),
    "surface": (f"<gml:MultiSurface><gml:surfaceMember><gml:Polygon>{RING}{HOLE}</gml:Polygon></gml:surfaceMember><gml:surfaceMember><gml:Polygon>{RING}</gml:Polygon></gml:surfaceMember></gml:MultiSurface>", None),
    "broken": ("<gml:Point><gml:pos>1 x</gml:pos></gml:Point>", None),
    "none": ("", None),
}


def test_gml_of_all_kinds(spark, tmp_path):
    rows = "".join(f'<m><id>{k}</id><n>7</n><geom>{v}</geom></m>' for k, (v, _) in SHAPES.items())
    (tmp_path / "a.gml").write_text(f'<c xmlns:gml="http://www.opengis.net/gml/3.2">{rows}</c>')
    out = files.read_gml(spark, str(tmp_path / "a.gml"), "m", {"id": "string", "n": "integer"})
    got = {r.id: (r.n, r.w, r.kind, r.area) for r in out.select("id", "n", G.wkt(F.col("geometry")).alias("w"), "geometry.kind", G.area(F.col("geometry")).alias("area")).collect()}
    assert set(got) == set(SHAPES) and all(v[0] == 7 for v in got.values())
    assert {k: got[k][1] for k, (_, w) in SHAPES.items() if w} == {k: w for k, (_, w) in SHAPES.items() if w}
    assert got["polygon"][3] == 15.5 and got["surface"][2:] == ("MultiPolygon", 31.5)
    assert got["broken"][2] is None and got["none"][2] is None
    turned = files.read_gml(spark, str(tmp_path / "a.gml"), "m", {"id": "string"}, swap_xy=True).filter("id = 'point'").select(G.wkt(F.col("geometry"))).first()[0]
    assert turned == "POINT (2.0 1.5)"


def test_archives_and_endings(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "one.zip", "w") as z:
        z.writestr("data/readme.txt", "x")
        z.writestr("data/a.shp", shp([(1, 2)]))
        z.writestr("data/a.dbf", dbf([("name", 5)], [("Ann",)]))
    assert files.read_file(spark, str(tmp_path / "one.zip"), columns={"name": "string"}).first().name == "Ann"
    with zipfile.ZipFile(tmp_path / "two.zip", "w") as z:
        z.writestr("a.csv", "id,v\n1,2\n")
        z.writestr("b.csv", "id,v\n3,4\n5,6\n")
        z.writestr("c.geojson", '{"type":"FeatureCollection","features":[{"type":"Feature","properties":{"id":"9"},"geometry":{"type":"Point","coordinates":[1,2]}}]}')
    assert files.read_file(spark, str(tmp_path / "two.zip"), member="b.csv").count() == 2
    assert files.read_file(spark, str(tmp_path / "two.zip"), kind="geojson", columns={"id": "integer"}).first().id == 9
    with pytest.raises(Exception, match="more than one member"):
        files.read_file(spark, str(tmp_path / "two.zip"))
    with pytest.raises(Exception, match="no member for it"):
        files.read_file(spark, str(tmp_path / "two.zip"), member="z.csv")
    (tmp_path / "a.csv").write_text("id,v\n1,2\n")
    (tmp_path / "a.dat").write_text("id,v\n1,2\n")
    assert files.read_file(spark, str(tmp_path / "a.csv")).columns == ["id", "v"] == files.read_file(spark, str(tmp_path / "a.dat"), kind="csv").columns
    with pytest.raises(ValueError, match="no reader for the ending 'dat'"):
        files.read_file(spark, str(tmp_path / "a.dat"))
    with pytest.raises(ValueError, match="only an archive"):
        files.read_file(spark, str(tmp_path / "a.csv"), member="x")
