"""Catalogues and regions: pages that link to the next one, CKAN portals, STAC searches, boxes and named regions.

A start address or a search is a row; tasks follow its pages through ``get(url) -> text`` or ``send(url, body) -> text``.
A chain of links can only be followed one page after the other, so what runs in parallel are the starts.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from urllib.parse import urlencode, urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.functions import geometry as G
from geoloom.sources.files import _from_geojson
from geoloom.sources.web import features, http, post

# Classes of a scene classification that count as clouds or their shadows, and formats by preference.
CLOUD_CLASSES = (3, 8, 9, 10)
FORMATS = ("geojson", "json", "gpkg")


def _next(body: str) -> dict | None:
    """The link to the page after this one."""
    return next((x for x in json.loads(body).get("links") or [] if x.get("rel") == "next"), None)


def linked_pages(spark: SparkSession, starts: Sequence[str], get: Callable[[str], str] = http, most: int = 1000) -> DataFrame:
    """(url, body) of the pages from each start on, as far as their next links go.

    More than ``most`` pages, or a link back to an earlier page, are an error, never a shorter layer.
    """
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for start in f["url"]:
                url, seen = start, set()
                while url is not None:
                    if url in seen or len(seen) == most:
                        raise ValueError(f"{start} has more than {most} pages, or links in a circle")
                    seen.add(url)
                    body = get(url)
                    yield pd.DataFrame({"url": [url], "body": [body]})
                    link = _next(body)
                    url = urljoin(url, link["href"]) if link else None

    rows = spark.createDataFrame([(u,) for u in starts], "url string").repartition(max(1, len(starts)))
    return rows.mapInPandas(run, "url string, body string")


# --- CKAN -------------------------------------------------------------------------------------------------------


def ckan_urls(base: str, datasets: Sequence[str] = (), resources: Sequence[str] = ()) -> list[str]:
    """Addresses that describe datasets and single resources of a portal."""
    asked = [("package_show", d) for d in datasets] + [("resource_show", r) for r in resources]
    return [f"{base.rstrip('/')}/api/3/action/{action}?{urlencode({'id': i})}" for action, i in asked]


def ckan_resources(pages: DataFrame, wanted: str = "") -> DataFrame:
    """(described, url, format): the resource of each answer to ckan_urls().

    The first one of the wanted format; else the last one of the best format in FORMATS; else the first. An answer that
    tells of a failure, or has no resource, is an error.
    """
    resource = "struct<url: string, format: string>"
    said = F.from_json("body", f"struct<success: boolean, result: struct<url: string, format: string, resources: array<{resource}>>>")
    rows = pages.select(F.col("url").alias("described"), said.alias("s"))
    own = F.struct(F.col("s.result.url").alias("url"), F.col("s.result.format").alias("format"))
    listed = F.when(F.col("s.result.resources").isNotNull(), F.col("s.result.resources")).otherwise(F.array(own))

    def ranked(r: Column, at: Column) -> Column:
        kind = F.lower(F.coalesce(r["format"], F.lit("")))
        rank = F.when((kind == wanted.lower()) & F.lit(bool(wanted)), 0)
        for k, known in enumerate(FORMATS, 1):
            rank = rank.when(kind == known, k)
        best = rank.otherwise(len(FORMATS) + 1)
        place = F.when(best.between(1, len(FORMATS)), -at).otherwise(at)
        return G.named(rank=best, place=place, url=r["url"], format=kind)

    best = F.array_min(F.transform(listed, ranked))
    ok = F.coalesce(F.col("s.success"), F.lit(False)) & best["url"].isNotNull()
    fails = F.raise_error(F.concat(F.lit("the portal has no resource to give for "), F.col("described"))).cast("string")
    return rows.select("described", F.when(ok, best["url"]).otherwise(fails).alias("url"), best["format"].alias("format"))


def read_ckan(spark: SparkSession, base: str, columns: dict[str, str], datasets: Sequence[str] = (), resources: Sequence[str] = (), wanted: str = "", get: Callable[[str], str] = http) -> DataFrame:
    """Features of the GeoJSON resources of a portal. Other formats are an error that names the address: download such a
    file and read it with its own reader.
    """
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for url, kind in zip(f["url"], f["format"], strict=True):
                if kind not in ("geojson", "json"):
                    raise ValueError(f"{url} is {kind or 'of no known format'}; download it and read it as a file")
                yield pd.DataFrame({"url": [url], "body": [get(url)]})

    pages = linked_pages(spark, ckan_urls(base, datasets, resources), get)
    found = ckan_resources(pages, wanted).select("url", "format")
    return features(found.mapInPandas(run, "url string, body string"), columns)


# --- STAC -------------------------------------------------------------------------------------------------------

ORDERS = {"cloud_cover": ("properties.eo:cloud_cover", "asc"), "latest": ("properties.datetime", "desc"), "earliest": ("properties.datetime", "asc")}


def scene_query(collection: str, bbox: Sequence[float], dates: str, max_cloud_cover: float | None = None, order: str = "cloud_cover", limit: int = 100) -> str:
    """The body of a search; clouds are filtered by the service."""
    field, way = ORDERS[order]
    body: dict = {"collections": [collection], "bbox": list(bbox), "datetime": dates, "limit": limit, "sortby": [{"field": field, "direction": way}]}
    if max_cloud_cover is not None:
        body["query"] = {"eo:cloud_cover": {"lte": max_cloud_cover}}
    return json.dumps(body)


def search_pages(spark: SparkSession, url: str, bodies: Sequence[str], send: Callable[[str, str], str] = post, most: int = 1000) -> DataFrame:
    """(url, body) of all pages of each search; a next link brings a new body, or changes to the old one (merge)."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for first in f["body"]:
                to, asked, seen = url, json.loads(first), set()
                while to is not None:
                    at = (to, json.dumps(asked, sort_keys=True))
                    if at in seen or len(seen) == most:
                        raise ValueError(f"a search has more than {most} pages, or links in a circle; narrow its dates or clouds")
                    seen.add(at)
                    body = send(to, at[1])
                    yield pd.DataFrame({"url": [to], "body": [body]})
                    link = _next(body)
                    to = urljoin(to, link["href"]) if link else None
                    more = (link or {}).get("body") or {}
                    asked = asked | more if (link or {}).get("merge") else more

    rows = spark.createDataFrame([(b,) for b in bodies], "body string").repartition(max(1, len(bodies)))
    return rows.mapInPandas(run, "url string, body string")


def scenes(pages: DataFrame, assets: dict[str, str]) -> DataFrame:
    """(id, datetime, date, cloud, grid_code, geometry, and the address of each asset by band name), each scene once.

    cloud is null where a scene does not tell it; a scene that lacks an asset has a null address.
    """
    item = "struct<id: string, properties: map<string, string>, geometry: struct<type: string, coordinates: string>, assets: map<string, struct<href: string>>>"
    i = F.col("i")
    rows = pages.select(F.explode(F.from_json("body", f"struct<features: array<{item}>>")["features"]).alias("i"))
    time = F.try_to_timestamp(i["properties"]["datetime"])
    hrefs = [F.try_element_at(i["assets"], F.lit(key))["href"].alias(band) for band, key in assets.items()]
    cloud = F.try_element_at(i["properties"], F.lit("eo:cloud_cover")).try_cast("double")
    out = rows.select(i["id"].alias("id"), time.alias("datetime"), F.to_date(time).alias("date"), cloud.alias("cloud"), F.try_element_at(i["properties"], F.lit("grid:code")).alias("grid_code"), _from_geojson(i["geometry"]["type"], i["geometry"]["coordinates"]).alias("geometry"), *hrefs)
    return out.dropDuplicates(["id"])


def choose_scenes(found: DataFrame, order: str = "cloud_cover", share: str = "covered") -> DataFrame:
    """The scenes of the best date: the least cloudy one that covers the region by itself, else all of the date if their
    shares make the whole.

    Dates that cannot cover the region are out of the question. cloud_cover: the date whose worst chosen scene has the
    fewest clouds, then the earliest, and a scene that does not tell is an error; latest, earliest: by date.
    """
    cloud = F.coalesce("cloud", F.lit(float("inf")))
    if order == "cloud_cover":
        cloud = F.when(F.col("cloud").isNull(), F.raise_error(F.lit("a scene does not tell its clouds; order by date")).cast("double")).otherwise(F.col("cloud"))
    alone = F.col(share) >= 1
    rows = found.withColumn("__c", cloud)
    best = F.min(F.when(alone, F.struct(F.col("__c").alias("c"), "id")))
    dates = rows.groupBy("date").agg(best.alias("one"), F.sum(share).alias("all"), F.max("__c").alias("worst")).filter("one IS NOT NULL OR all >= 1")
    dates = dates.withColumn("worst", F.coalesce("one.c", "worst"))
    line = {"cloud_cover": [F.col("worst"), F.col("date")], "latest": [F.desc("date")], "earliest": [F.col("date")]}[order]
    # One row: its size does not grow.
    top = dates.orderBy(*line).limit(1).select(F.col("date").alias("__d"), F.col("one.id").alias("__one"))
    met = rows.join(F.broadcast(top), F.col("date") == F.col("__d"))
    return met.filter(F.col("__one").isNull() | (F.col("id") == F.col("__one"))).select(*found.columns)


def mask_clouds(cells: DataFrame, bands: Sequence[str], class_band: str = "scl", classes: Sequence[int] = CLOUD_CLASSES) -> DataFrame:
    """cells with null bands where the class band says cloud or shadow; a cell without a class keeps its values."""
    cloudy = F.coalesce(F.col(class_band).isin(*classes), F.lit(False))
    return cells.withColumns({b: F.when(~cloudy, F.col(b)) for b in bands})


def reflectance(cells: DataFrame, bands: Sequence[str], scale: float, offset: float = 0.0, nodata: float | None = None) -> DataFrame:
    """Stored numbers of bands as reflectance; nodata becomes null first."""
    value = lambda b: F.when(F.col(b) != nodata, F.col(b)) if nodata is not None else F.col(b)
    return cells.withColumns({b: value(b) * scale + offset for b in bands})


# --- regions ----------------------------------------------------------------------------------------------------


def box_region(spark: SparkSession, text: str) -> DataFrame:
    """A layer of one polygon from 'west,south,east,north' in degrees."""
    try:
        west, south, east, north = map(float, text.split(","))
    except ValueError:
        raise ValueError(f"a region is west,south,east,north, not {text!r}") from None
    if not (-180 <= west < east <= 180 and -90 <= south < north <= 90):
        raise ValueError(f"{text}: west must be less than east and south less than north, within the world")
    return spark.range(1).select(G.box(*map(F.lit, (west, south, east, north))).alias("geometry"))


def named_region(pages: DataFrame) -> DataFrame:
    """(url, name, geometry): the first hit of each geocoder answer that is an area; answers without one give no row."""
    hit = "struct<display_name: string, geojson: struct<type: string, coordinates: string>>"
    areas = F.filter(F.from_json("body", f"array<{hit}>"), lambda h: h["geojson"]["type"].isin("Polygon", "MultiPolygon"))
    rows = pages.select("url", F.get(areas, F.lit(0)).alias("h")).filter("h IS NOT NULL")
    return rows.select("url", F.col("h.display_name").alias("name"), _from_geojson(F.col("h.geojson.type"), F.col("h.geojson.coordinates")).alias("geometry"))


def snapshot(spark: SparkSession, path: str, make: Callable[[], DataFrame], *, refresh: bool = False) -> DataFrame:
    """What a service once gave, kept as Parquet: fetched if it is not there in full, or if refresh asks for it."""
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if refresh or not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
