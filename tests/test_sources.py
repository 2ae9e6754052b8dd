"""Files, services and outputs, by round trips and small known inputs."""

import json
import sqlite3
import zipfile

import pytest
from pyspark.sql import functions as F

from geoloom.functions import geometry as G
from geoloom.operators import network as N
from geoloom.operators import raster as R
from geoloom.outputs import writers
from geoloom.sources import catalogues, files, geotiff, web
from geoloom.streaming.hexbin import windowed_hexbin


def layer(spark):
    return spark.createDataFrame([(1, "a\"b", "POINT (1 2)"), (2, None, "POLYGON ((0 0, 2 0, 2 2, 0 0))"), (3, "c", "MULTILINESTRING ((0 0, 1 1), (2 2, 3 3))")], "id long, name string, t string").select("id", "name", G.from_wkt(F.col("t")).alias("geometry"))


def test_paging_goes_to_the_end(spark):
    from urllib.parse import parse_qs, urlparse

    def service(n):
        def get(url):
            q = {k: int(v[0]) for k, v in parse_qs(urlparse(url).query).items()}
            return json.dumps({"items": [{"id": i} for i in range(q["offset"], min(n, q["offset"] + q["limit"]))]})

        return get

    urls = lambda at, n: web.offset_urls("http://x", 5, n, at)
    for n in (0, 3, 5, 23, 40):
        pages = web.all_pages(spark, urls, 5, "items", service(n), wave=2)
        assert sorted(r.id for r in web.items(pages, "items", {"id": "integer"}).collect()) == list(range(n))
    with pytest.raises(ValueError, match="more than 4 pages"):
        web.all_pages(spark, urls, 5, "items", service(100), wave=2, most=4)


def test_geojson_round_trip(spark, tmp_path):
    df = layer(spark)
    writers.write_geojson(df, str(tmp_path / "out"))
    again = files.read_geojson(spark, str(tmp_path / "out"), {"id": "integer", "name": "string"}, lines=True)
    assert sorted(map(str, again.collect())) == sorted(map(str, df.collect()))
    whole = {"type": "FeatureCollection", "features": [json.loads(r[0]) for r in df.select(writers.feature(df)).collect()]}
    (tmp_path / "one.geojson").write_text(json.dumps(whole, indent=1))
    assert files.read_geojson(spark, str(tmp_path / "one.geojson"), {"id": "integer", "name": "string"}).count() == 3


def test_tables(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id;lon;lat;kw\n1;13,5;51,0;1.234,5\n2;x;51,1;\n")
    df = files.read_csv(spark, str(tmp_path / "a.csv"), delimiter=";", decimal=",", thousands=".", columns={"id": {"type": "integer"}, "kw": {"as": "power", "type": "float"}})
    assert [tuple(r) for r in df.orderBy("id").collect()] == [(1, 1234.5), (2, None)]
    (tmp_path / "a.txt").write_text("id  name\n--------\n1   Ann \n2   Bob \n")
    assert [tuple(r) for r in files.read_fwf(spark, str(tmp_path / "a.txt"), [(0, 4), (4, 8)], ["id", "name"], 2).orderBy("id").collect()] == [("1", "Ann"), ("2", "Bob")]
    con = sqlite3.connect(tmp_path / "a.db")
    con.executescript("CREATE TABLE t (id TEXT, v INTEGER, g TEXT); INSERT INTO t VALUES ('a', 110, 'POINT (1 2)'), ('b', NULL, NULL);")
    con.commit()
    con.close()
    df = files.read_sqlite(spark, str(tmp_path / "a.db"), ["id", "v", "g"], "t", wkt="g", columns={"id": {}, "v": {"type": "integer"}})
    assert [(r.id, r.v, r.geometry is None) for r in df.orderBy("id").collect()] == [("a", 110, False), ("b", None, True)]
    (tmp_path / "a.sql").write_text("CREATE TABLE t (id TEXT, v INTEGER); INSERT INTO t VALUES ('a', 110);")
    assert files.read_sql_dump(spark, str(tmp_path / "a.sql"), ["id", "v"], "t").count() == 1
    ns = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    with zipfile.ZipFile(tmp_path / "a.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{ns}"><sheets><sheet name="S" sheetId="1"/></sheets></workbook>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{ns}"><si><t>id</t></si><si><t>Ann</t></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{ns}"><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>n</t></is></c></row><row><c r="A2" t="s"><v>1</v></c><c r="C2"><v>7</v></c></row></sheetData></worksheet>')
    assert [tuple(r) for r in files.read_xlsx(spark, str(tmp_path / "a.xlsx"), ["id", "n"]).collect()] == [("Ann", "7")]


def test_gtfs(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "g.zip", "w") as z:
        z.writestr("stops.txt", "stop_id,stop_name,stop_lat,stop_lon\n" + "".join(f"{s},{s},51.{i},13.{i}\n" for i, s in enumerate("ABCD")))
        z.writestr("routes.txt", "route_id,route_type\nbus,3\ntram,0\n")
        z.writestr("trips.txt", "trip_id,route_id\nt1,bus\nt2,bus\nt3,tram\n")
        z.writestr("stop_times.txt", "trip_id,stop_id,stop_sequence\nt1,A,1\nt1,B,2\nt1,C,10\nt2,A,1\nt2,B,2\nt3,C,1\nt3,D,2\n")
    t = files.read_gtfs(spark, str(tmp_path / "g.zip"))
    _, edges = N.gtfs_edges(t["stop_times"], t["trips"], t["routes"], t["stops"], [3])
    assert sorted((r.from_id, r.to_id) for r in edges.collect()) == [("A", "B"), ("B", "C")]


def test_geotiff_round_trip(spark, tmp_path):
    grid = R.Grid(100.0, 200.0, 10.0, 3, 4)
    cells = grid.cells(spark).withColumn("v", F.when(F.col("col") != 2, F.col("row") * 4.0 + F.col("col")))
    data = writers.geotiff(cells, ["v"], grid, 32633)
    (tmp_path / "a.tif").write_bytes(data)
    head = geotiff.head(lambda at, size: data[at : at + size])
    assert (head.rows, head.cols, head.x0, head.y0, head.dx) == (3, 4, 100.0, 200.0, 10.0)
    assert sorted(map(tuple, geotiff.read_tif(spark, str(tmp_path / "a.tif"), ["v"]).collect()), key=str) == sorted(map(tuple, cells.select("row", "col", "v").collect()), key=str)


def test_services(spark):
    page = json.dumps({"features": [{"properties": {"id": "1"}, "geometry": {"type": "Point", "coordinates": [13.0, 51.0]}}]})
    pages = web.fetch_pages(spark, web.wfs_urls("http://x/wfs", "l", (1, 2, 3, 4), 10, 2), lambda url: page)
    assert web.features(pages, {"id": "integer"}).count() == 1
    pages = web.fetch_pages(spark, ["u"], lambda url: json.dumps({"data": {"rows": [{"n": "5", "lon": "1", "lat": "2"}]}}))
    assert web.items(pages, "data.rows", {"n": "integer"}, "lon", "lat").first().n == 5
    scenes = spark.createDataFrame([("d1", 0.6, 1.0), ("d1", 0.6, 1.0), ("d2", 1.0, 9.0)], "date string, covered double, cloud double")
    assert [r.date for r in web.best_date(scenes).collect()] == ["d2"]


def test_filters_and_text_outputs(spark, tmp_path):
    df = layer(spark)
    region = spark.range(1).select(G.box(F.lit(0.5), F.lit(0.5), F.lit(1.5), F.lit(2.5)).alias("geometry"))
    assert {r.id for r in files.region_filter(df, region).collect()} == {1, 2, 3}
    far = spark.range(1).select(G.box(F.lit(1.9), F.lit(0), F.lit(2.1), F.lit(0.1)).alias("geometry"))
    assert {r.id for r in files.region_filter(df, far).collect()} == {2}
    tags = spark.createDataFrame([(1, {"a": "x"}), (2, {"b": "y"})], "id long, tags map<string,string>")
    assert [r.id for r in tags.filter(files.tag_filter(F.col("tags"), [{"a": "*"}, {"b": "z"}])).collect()] == [1]
    assert writers.turtle(df, "id", "http://x/").count() == 8
    assert "3 of 3 features" in writers.html_map(df)
    assert writers.summary(df, ["id"]).first().rows == 3
    writers.write_csv(df, str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).columns == ["id", "name", "wkt"]


def test_stream(spark, tmp_path):
    spark.createDataFrame([("2024-01-01 00:10:00", 1.0, 1.0), ("2024-01-01 00:20:00", 2.0, 1.0)], "ts string, x double, y double").selectExpr("timestamp(ts) AS ts", "x", "y").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, x double, y double").parquet(str(tmp_path / "in"))
    q = windowed_hexbin(stream, "ts", "x", "y", 1.0).writeStream.format("memory").queryName("hexes").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert [r["count"] for r in spark.table("hexes").collect()] == [2]


def test_shapefile(spark, tmp_path):
    import struct

    def record(i, body):
        return struct.pack(">ii", i, len(body) // 2) + body

    ring = [(0, 0), (0, 2), (2, 2), (2, 0), (0, 0)]
    hole = [(0.5, 0.5), (1, 0.5), (1, 1), (0.5, 1), (0.5, 0.5)]
    flat = [v for p in ring + hole for v in p]
    polygon = struct.pack("<i4d2i2i", 5, 0, 0, 2, 2, 2, 10, 0, 5) + struct.pack("<20d", *flat)
    body = record(1, struct.pack("<i2d", 1, 3.0, 4.0)) + record(2, polygon) + record(3, struct.pack("<i", 0))
    (tmp_path / "a.shp").write_bytes(b"\0" * 100 + body)
    rows = files.read_shp(spark, str(tmp_path / "a.shp")).select("position", G.wkt(F.col("geometry")).alias("w"), G.area(F.col("geometry")).alias("a")).orderBy("position").collect()
    assert rows[0].w == "POINT (3.0 4.0)"
    assert rows[1].a == 4 - 0.25
    assert rows[2].w is None or rows[2].a is None


def test_preview_and_coverage(spark):
    df = layer(spark)
    many = df.unionByName(df.filter("id = 1").crossJoin(spark.range(20)).select("name", "geometry", F.lit(1).cast("long").alias("id")).select("id", "name", "geometry"))
    shown = writers.preview(many, 10, 1)
    assert shown.columns == ["id", "geometry"]
    assert shown.count() <= 12
    assert shown.select("geometry.kind").distinct().count() == 3
    region = spark.range(1).select(G.box(F.lit(0), F.lit(0), F.lit(6), F.lit(3)).alias("geometry"))
    assert tuple(writers.coverage(df, region).first()) == (0.5, 1.0)
    assert writers.preview(df.limit(0), 5).count() == 0


def test_layer_through_a_service(spark):
    df = layer(spark)
    same = web.through_service(df, "u", {"id": "integer", "name": "string"}, 2, lambda url, body: body)
    assert sorted(map(str, same.collect())) == sorted(map(str, df.collect()))


def test_pages_that_link_to_the_next(spark):
    def chain(n, back=None):
        def get(url):
            k = int(url.rsplit("=")[-1])
            to = k + 1 if k + 1 < n else back
            links = [{"rel": "self", "href": url}] + ([{"rel": "next", "href": f"/items?k={to}"}] if to is not None else [])
            return json.dumps({"links": links, "features": [{"properties": {"id": str(k)}, "geometry": {"type": "Point", "coordinates": [1.0, k]}}]})

        return get

    pages = catalogues.linked_pages(spark, ["http://x/items?k=0", "http://x/items?k=3"], chain(5))
    assert sorted(r.id for r in web.features(pages, {"id": "integer"}).collect()) == [0, 1, 2, 3, 4]
    assert pages.count() == 7
    for get, most in ((chain(5), 4), (chain(5, 2), 100)):
        with pytest.raises(Exception, match="links in a circle"):
            catalogues.linked_pages(spark, ["http://x/items?k=0"], get, most).collect()


def test_portal(spark):
    resources = [{"url": "http://x/1", "format": "PDF"}, {"url": "http://x/2", "format": "GeoJSON"}, {"url": "http://x/3", "format": "GPKG"}, {"url": "http://x/4", "format": "geojson"}]
    layer_of = lambda n: json.dumps({"features": [{"properties": {"n": str(n)}, "geometry": {"type": "Point", "coordinates": [1, 2]}}]})

    def get(url):
        if "package_show?id=a" in url:
            return json.dumps({"success": True, "result": {"resources": resources}})
        if "package_show?id=b" in url:
            return json.dumps({"success": True, "result": {"resources": resources[:1]}})
        if "resource_show?id=r" in url:
            return json.dumps({"success": True, "result": {"url": "http://x/9", "format": "JSON"}})
        return json.dumps({"success": False, "error": "no"}) if "action" in url else layer_of(url[-1])

    chosen = lambda wanted, *names: [tuple(r) for r in catalogues.ckan_resources(catalogues.linked_pages(spark, catalogues.ckan_urls("http://x/", names), get), wanted).select("url", "format").collect()]
    assert chosen("", "a") == [("http://x/4", "geojson")]
    assert chosen("GeoJSON", "a") == [("http://x/2", "geojson")]
    assert chosen("gpkg", "a") == [("http://x/3", "gpkg")]
    assert chosen("", "b") == [("http://x/1", "pdf")]
    assert [r.n for r in catalogues.read_ckan(spark, "http://x", {"n": "integer"}, ["a"], ["r"], get=get).orderBy("n").collect()] == [4, 9]
    with pytest.raises(Exception, match="no resource"):
        catalogues.read_ckan(spark, "http://x", {"n": "integer"}, ["gone"], get=get).collect()
    with pytest.raises(Exception, match="download it"):
        catalogues.read_ckan(spark, "http://x", {"n": "integer"}, ["b"], get=get).collect()


def test_scene_search(spark):
    def item(i, day, cloud):
        props = {"datetime": f"2024-06-{day:02}T10:00:00Z", "grid:code": "g"} | ({} if cloud is None else {"eo:cloud_cover": cloud})
        return {"id": i, "properties": props, "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 0]]]}, "assets": {"B04": {"href": f"http://x/{i}/red"}}}

    items = [item("a", 1, 5.5), item("b", 2, 3), item("c", 2, 9), item("d", 3, 1), item("e", 4, 2)]

    def send(url, body):
        at = json.loads(body).get("token", 0)
        links = [{"rel": "next", "href": url, "merge": True, "body": {"token": at + 2}}] if at + 2 < len(items) else []
        assert json.loads(body)["query"] == {"eo:cloud_cover": {"lte": 20}}
        return json.dumps({"features": items[at : at + 2], "links": links})

    body = catalogues.scene_query("s2", (0, 0, 1, 1), "2024-06-01/2024-06-30", 20)
    found = catalogues.scenes(catalogues.search_pages(spark, "http://x/search", [body, body], send), {"red": "B04", "nir": "B08"})
    rows = found.orderBy("id").collect()
    assert [(r.id, r.cloud, str(r.date), r.red, r.nir) for r in rows][:2] == [("a", 5.5, "2024-06-01", "http://x/a/red", None), ("b", 3.0, "2024-06-02", "http://x/b/red", None)]
    assert len(rows) == 5
    share = F.when(F.col("id").isin("b", "c"), 0.6).when(F.col("id") == "d", 0.9).otherwise(1.0)
    covered = found.withColumn("covered", share)
    ids = lambda df, order: sorted(r.id for r in catalogues.choose_scenes(df, order).collect())
    assert ids(covered, "cloud_cover") == ["e"]
    assert ids(covered.filter("id <> 'e'"), "cloud_cover") == ["a"]  # d has fewer clouds and does not cover; c has more
    assert ids(covered.filter("id NOT IN ('a', 'e')"), "latest") == ["b", "c"]
    assert ids(covered, "earliest") == ["a"]
    with pytest.raises(Exception, match="does not tell its clouds"):
        catalogues.choose_scenes(covered.withColumn("cloud", F.lit(None).cast("double"))).collect()
    cells = spark.createDataFrame([(0, 4, 1000.0), (1, 9, 1000.0), (2, None, 0.0)], "i int, scl int, red double")
    seen = catalogues.reflectance(catalogues.mask_clouds(cells, ["red"]), ["red"], 0.0001, -0.1, 0.0)
    assert [r.red for r in seen.orderBy("i").collect()] == [pytest.approx(0.0), None, None]


def test_regions_and_snapshots(spark, tmp_path):
    assert catalogues.box_region(spark, "13.5, 51, 14, 51.2").select(G.area(F.col("geometry"))).first()[0] == pytest.approx(0.1)
    for bad in ("14,51,13,52", "1,2,3", "a,b,c,d", "0,-91,1,1"):
        with pytest.raises(ValueError):
            catalogues.box_region(spark, bad)
    ring = [[0, 0], [2, 0], [2, 2], [0, 0]]
    answers = [("a", json.dumps([{"display_name": "P", "geojson": {"type": "Point", "coordinates": [1, 1]}}, {"display_name": "T", "geojson": {"type": "Polygon", "coordinates": [ring]}}])), ("b", "[]")]
    hits = catalogues.named_region(spark.createDataFrame(answers, "url string, body string")).collect()
    assert [(r.url, r.name, r.geometry.kind) for r in hits] == [("a", "T", "Polygon")]
    calls = []

    def make():
        calls.append(1)
        return spark.range(3 * len(calls))

    path = str(tmp_path / "kept")
    assert [catalogues.snapshot(spark, path, make, refresh=r).count() for r in (False, False, True)] == [3, 3, 6]
    assert len(calls) == 2


def wfs(n, cap=None, matched=True, repeat=False):
    """A service of n features that gives at most cap in a page."""
    from urllib.parse import parse_qs, urlparse

    def get(url):
        q = {k: v[0] for k, v in parse_qs(urlparse(url).query).items()}
        start, count = int(q["startIndex"]), int(q["count"])
        start = 0 if repeat else start
        found = [{"properties": {"id": str(i)}, "geometry": {"type": "Point", "coordinates": [i, i]}} for i in range(start, min(n, start + min(count, cap or count)))]
        return json.dumps({"type": "FeatureCollection", "timeStamp": url} | ({"numberMatched": n} if matched else {}) | {"features": found})

    return get


def test_wfs_pages_add_up(spark):
    url_at = web.wfs_url("http://x/wfs", "l", (1, 2, 3, 4))
    ids = lambda get, size=10, **how: sorted(r.id for r in web.features(web.every_page(spark, url_at, size, "features", get, **how), {"id": "integer"}).collect())
    for n in (0, 3, 10, 11, 47):
        assert ids(wfs(n), wave=2) == ids(wfs(n, matched=False), wave=2) == list(range(n))
    assert ids(wfs(10, cap=2)) == list(range(10)) and ids(wfs(11, cap=3)) == list(range(11))  # a server with a limit of its own
    for matched in (True, False):
        with pytest.raises(ValueError, match="gives a page again"):
            ids(wfs(40, matched=matched, repeat=True))
    lost = wfs(40)
    with pytest.raises(ValueError, match="gave 30 of 40"):
        ids(lambda url: lost(url) if "startIndex=20" not in url else json.dumps({"numberMatched": 40, "features": []}))
    with pytest.raises(ValueError, match="more than 3 pages"):
        ids(wfs(100), wave=2, most=3)


def test_sheets_by_relation(spark, tmp_path):
    ns, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    sheet = lambda v: f'<worksheet xmlns="{ns}"><sheetData><row><c r="A1" t="inlineStr"><is><t>id</t></is></c></row><row><c r="A2"><v>{v}</v></c></row></sheetData></worksheet>'
    with zipfile.ZipFile(tmp_path / "a.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{ns}" xmlns:r="{rel}"><sheets><sheet name="B" sheetId="7" r:id="r2"/><sheet name="A" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Target="/xl/worksheets/sheet4.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", sheet(1))
        z.writestr("xl/worksheets/sheet4.xml", sheet(4))
    assert [files.read_xlsx(spark, str(tmp_path / "a.xlsx"), ["id"], s).first().id for s in "AB"] == ["1", "4"]
    with pytest.raises(Exception, match="name one of the sheets"):
        files.read_xlsx(spark, str(tmp_path / "a.xlsx"), ["id"]).collect()
