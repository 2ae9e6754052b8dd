"""Services that answer in pages: OGC WFS, REST, STAC items, geocoding.

A page is a row; tasks fetch pages in parallel through ``fetch(url) -> text`` (urllib unless given), so that tests and
closed networks pass recorded answers. Only URL building is service-specific.
"""

from __future__ import annotations

import urllib.request
from collections.abc import Callable, Iterator, Sequence
from urllib.parse import urlencode

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from geoloom.functions import geometry as G
from geoloom.functions.keys import CASTS
from geoloom.plans.stages import materialize
from geoloom.sources.files import _from_geojson


def http(url: str) -> str:
    with urllib.request.urlopen(url, timeout=60) as r:  # noqa: S310
        return r.read().decode("utf-8")


def fetch_pages(spark: SparkSession, urls: Sequence[str], fetch: Callable[[str], str] = http) -> DataFrame:
    """(url, body) of each address."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for url in f["url"]:
                yield pd.DataFrame({"url": [url], "body": [fetch(url)]})

    rows = spark.createDataFrame([(u,) for u in urls], "url string").repartition(max(1, len(urls)))
    return rows.mapInPandas(run, "url string, body string")


def features(pages: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Features of GeoJSON pages, each once even if a service repeats a page."""
    feature = "struct<properties: map<string, string>, geometry: struct<type: string, coordinates: string>>"
    rows = pages.dropDuplicates(["body"]).select(F.explode(F.from_json("body", f"struct<features: array<{feature}>>")["features"]).alias("f"))
    picked = [CASTS[t](F.col("f.properties")[c]).alias(c) for c, t in columns.items()]
    return rows.select(*picked, _from_geojson(F.col("f.geometry.type"), F.col("f.geometry.coordinates")).alias("geometry"))


def items(pages: DataFrame, path: str, columns: dict[str, str], x: str | None = None, y: str | None = None, wkt: str | None = None) -> DataFrame:
    """Items of JSON pages at a dotted path, with points from x and y or geometry from WKT."""
    inner = F.get_json_object("body", "$." + path if path else "$")
    rows = pages.select(F.explode(F.from_json(inner, "array<map<string, string>>")).alias("i"))
    picked = [CASTS[t](F.col("i")[c]).alias(c) for c, t in columns.items()]
    g = G.point(CASTS["float"](F.col("i")[x]), CASTS["float"](F.col("i")[y])) if x and y else G.from_wkt(F.col("i")[wkt]) if wkt else F.lit(None).cast(G.GEOMETRY)
    return rows.select(*picked, g.alias("geometry"))


def every_page(spark: SparkSession, url_at: Callable[[int, int], str], size: int, path: str, get: Callable[[str], str] = http, wave: int = 16, most: int = 10_000, matched: str | None = "numberMatched") -> DataFrame:
    """(url, body) of all pages of a service, as items at the dotted path; url_at(offset, count) is a page's address.

    The first page tells how many items a page really has: where the service says how many match in all and gives fewer
    than asked for, it has a limit of its own, and the next pages are asked for in its steps. Pages are then fetched by tasks
    in waves and written. The last page has fewer items than the others, or reaches the number that match. A page that comes
    again, pages that don't add up to that number, and more than ``most`` pages are errors, never a shorter layer.
    """
    listed = F.get_json_object("body", "$." + path)
    n = F.coalesce(F.size(F.from_json(listed, "array<string>")), F.lit(0))
    total = F.get_json_object("body", f"$.{matched}").cast("long") if matched else F.lit(None).cast("long")

    def fetched(urls: list[str]) -> DataFrame:
        return materialize(fetch_pages(spark, urls, get).select("url", "body", F.when(n > 0, F.xxhash64(listed)).alias("own"), n.cast("long").alias("n"), total.alias("total")), "pages")

    out = fetched([url_at(0, size)])
    first = out.select("n", "total").first()
    every, step = first.total, first.n if first.total is not None and 0 < first.n < min(size, first.total) else size
    at, pages = step, 1
    # Without a number, a page that is not full is the last one.
    ended = first.n < step if every is None else at >= every or not first.n
    while not ended:
        if pages >= most:
            raise ValueError(f"the service has more than {most} pages")
        k = min(wave, most - pages, wave if every is None else -(-(every - at) // step))
        out = out.union(fetched([url_at(at + i * step, step) for i in range(k)]))
        facts = out.agg(F.count("own").alias("filled"), F.count_distinct("own").alias("kinds"), F.min("n").alias("least"), F.sum("n").alias("items")).first()
        if facts.kinds < facts.filled:
            raise ValueError("the service gives a page again; it seems to ignore where a page starts")
        at, pages = at + k * step, pages + k
        ended = facts.least < step if every is None else at >= every
    got = out.agg(F.sum("n")).first()[0]
    if every is not None and got != every:
        raise ValueError(f"the service gave {got} of {every} items")
    return out.select("url", "body")


def all_pages(spark: SparkSession, urls_from: Callable[[int, int], list[str]], size: int, path: str, get: Callable[[str], str] = http, wave: int = 16, most: int = 10_000) -> DataFrame:
    """every_page() of a service whose pages have numbers: urls_from(k, n) gives the addresses of n pages from page k on."""

    def url_at(offset: int, count: int) -> str:
        if count != size:
            raise ValueError(f"the service gives {count} of {size} items that a page was asked for")
        return urls_from(offset // size, 1)[0]

    return every_page(spark, url_at, size, path, get, wave, most)


def wfs_urls(base: str, layer: str, bbox: tuple[float, float, float, float], count: int, pages: int, start: int = 0) -> list[str]:
    """GetFeature requests (WFS 2.0, latitude first) for so many pages from a page on; all_pages() finds how many there are."""
    west, south, east, north = bbox
    same = {"service": "WFS", "version": "2.0.0", "request": "GetFeature", "typeNames": layer, "outputFormat": "application/json", "bbox": f"{south},{west},{north},{east},urn:ogc:def:crs:EPSG::4326", "count": count}
    return [f"{base}?{urlencode(same | {'startIndex': k * count})}" for k in range(start, start + pages)]


def wfs_url(base: str, layer: str, bbox: tuple[float, float, float, float]) -> Callable[[int, int], str]:
    """url_at of every_page() for a WFS layer."""
    return lambda offset, count: wfs_urls(base, layer, bbox, count, 1)[0].replace("startIndex=0", f"startIndex={offset}")


def offset_urls(base: str, limit: int, pages: int, start: int = 0, **query: str) -> list[str]:
    return [f"{base}?{urlencode(query | {'limit': limit, 'offset': k * limit})}" for k in range(start, start + pages)]


def best_date(scenes: DataFrame, share: str = "covered", cloud: str = "cloud") -> DataFrame:
    """The scenes of the best date: one that covers all by itself first, then by coverage and little cloud, then the newest."""
    by_date = scenes.groupBy("date").agg(F.max(share).alias("single"), F.sum(share).alias("together"), F.avg(cloud).alias("clouds"))
    best = by_date.orderBy((F.col("single") >= 1).desc(), F.least("together", F.lit(1.0)).desc(), F.col("clouds"), F.col("date").desc()).limit(1)
    return scenes.join(F.broadcast(best.select("date")), "date", "left_semi")


def mosaic_first(cells: DataFrame, order: str, bands: Sequence[str], valid: Column) -> DataFrame:
    """(row, col, bands) of the first scene by order that has a valid value at a cell."""
    return cells.filter(valid).groupBy("row", "col").agg(F.min_by(F.struct(*bands), order).alias("b")).select("row", "col", "b.*")


def first_hits(pages: DataFrame, bbox: tuple[float, float, float, float]) -> DataFrame:
    """(url, name, lon, lat, geometry) of each geocoder answer's first hit, if it lies in the box."""
    hit = F.from_json("body", "array<struct<display_name: string, lon: string, lat: string>>")[0]
    rows = pages.select("url", hit.alias("h")).select("url", F.col("h.display_name").alias("name"), CASTS["float"](F.col("h.lon")).alias("lon"), CASTS["float"](F.col("h.lat")).alias("lat"))
    inside = F.col("lon").between(bbox[0], bbox[2]) & F.col("lat").between(bbox[1], bbox[3])
    return rows.filter(inside).withColumn("geometry", G.point(F.col("lon"), F.col("lat")))


def latest(rows: DataFrame, key: str, time: str) -> DataFrame:
    """The newest row of each key, for resources that list several versions."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(F.col(time).desc()))).filter("__n = 1").drop("__n")


def post(url: str, body: str) -> str:
    request = urllib.request.Request(url, body.encode("utf-8"), {"Content-Type": "application/json"}, method="POST")
    with urllib.request.urlopen(request, timeout=60) as r:  # noqa: S310
        return r.read().decode("utf-8")


def through_service(df: DataFrame, url: str, columns: dict[str, str], batch: int = 1000, send: Callable[[str, str], str] = post) -> DataFrame:
    """What a service makes of a layer: tasks post FeatureCollections of up to ``batch`` features and read those of the replies."""
    from geoloom.outputs.writers import feature

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for at in range(0, len(f), batch):
                body = '{"type":"FeatureCollection","features":[' + ",".join(f["value"].iloc[at : at + batch]) + "]}"
                yield pd.DataFrame({"url": [url], "body": [send(url, body)]})

    replies = df.select(feature(df).alias("value")).mapInPandas(run, "url string, body string")
    named = "struct<properties: map<string, string>, geometry: struct<type: string, coordinates: string>>"
    rows = replies.select(F.explode(F.from_json("body", f"struct<features: array<{named}>>")["features"]).alias("f"))
    picked = [CASTS[t](F.col("f.properties")[c]).alias(c) for c, t in columns.items()]
    return rows.select(*picked, _from_geojson(F.col("f.geometry.type"), F.col("f.geometry.coordinates")).alias("geometry"))
