"""Queries on distances and pieces of lines and areas, with SQL that works them out from the tables' numbers."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoloom.functions import crs
from geoloom.functions import geometry as G
from geoloom.operators import attributes as A
from geoloom.operators import clusters as CL
from geoloom.operators import nearest
from geoloom.operators import polygons as P
from geoloom.operators import raster as R
from geoloom.operators import spatial as S
from geoloom.sources import osm
from geoloom.plans.queries import _CELLS, _GRID, _cells, _place, _t, query

_CUSTOMERS = "SELECT c_custkey, c_custkey * 7919 % 10007 + 0.5 AS x, c_custkey * 104729 % 10009 + 0.5 AS y FROM customer"


def _probes(spark, sf_dir):
    c = F.col("c_custkey")
    return _t(spark, sf_dir, "customer").select("c_custkey", G.point(c * 7919 % 10007 + 0.5, c * 104729 % 10009 + 0.5).alias("geometry"))


@query(f"""WITH s AS (SELECT s_suppkey * 7919 % 10007 AS ax, s_suppkey * 104729 % 10009 AS ay, s_suppkey % 37 * 20 - 360 AS dx, s_suppkey % 11 * 30 + 10 AS dy FROM supplier),
d AS (SELECT c_custkey, x - ax AS px, y - ay AS py, dx, dy, greatest(0, least(1, ((x - ax) * dx + (y - ay) * dy) / (dx * dx + dy * dy))) AS t FROM ({_CUSTOMERS}), s)
SELECT c_custkey, round(min(sqrt(power(px - t * dx, 2) + power(py - t * dy, 2))), 6) AS distance FROM d GROUP BY 1""")
def nearest_line(spark, sf_dir):
    """How far every customer is from the nearest of the suppliers' lines."""
    k = F.col("s_suppkey")
    x, y = k * 7919 % 10007, k * 104729 % 10009
    lines = _t(spark, sf_dir, "supplier").select(G.line(G.xy(x, y), G.xy(x + k % 37 * 20 - 360, y + k % 11 * 30 + 10)).alias("geometry"))
    return nearest.nearest_distance(_probes(spark, sf_dir), lines, "c_custkey", 200.0).select("c_custkey", F.round("distance", 6).alias("distance"))


@query(f"""WITH s AS (SELECT s_suppkey * 7919 % 10007 AS x0, s_suppkey * 104729 % 10009 AS y0, s_suppkey % 7 * 40 + 20 AS side FROM supplier)
SELECT c_custkey, round(min(sqrt(power(greatest(0, x0 - x, x - x0 - side), 2) + power(greatest(0, y0 - y, y - y0 - side), 2))), 6) AS distance FROM ({_CUSTOMERS}), s GROUP BY 1""")
def nearest_area(spark, sf_dir):
    """How far every customer is from the nearest of the suppliers' squares; 0 in one."""
    k = F.col("s_suppkey")
    x, y, side = k * 7919 % 10007, k * 104729 % 10009, k % 7 * 40 + 20
    squares = _t(spark, sf_dir, "supplier").select(G.box(x, y, x + side, y + side).alias("geometry"))
    return nearest.nearest_distance(_probes(spark, sf_dir), squares, "c_custkey", 200.0).select("c_custkey", F.round("distance", 6).alias("distance"))


@query("""WITH z AS (SELECT z, z % 10 * 1000 AS x0, z // 10 * 1000 AS y0 FROM (SELECT DISTINCT c_custkey % 100 AS z FROM customer) WHERE z % 3 = 1),
e AS (SELECT user_id, event_id, event_id * 7919 % 10007 AS x, event_id * 104729 % 10009 AS y FROM events)
SELECT user_id, count(DISTINCT event_id) AS n FROM e JOIN z ON x BETWEEN x0 AND x0 + 1000 AND y BETWEEN y0 AND y0 + 1000 GROUP BY 1""")
def clip_multipoints(spark, sf_dir):
    """The places of each user's events as one geometry, and how many of them are in a mask of squares."""
    places = _place(_t(spark, sf_dir, "events"), "event_id")
    at = F.sort_array(F.collect_list(F.struct("event_id", F.col("geometry.parts")[0].alias("p"))))
    users = places.groupBy("user_id").agg(G.geometry("MultiPoint", F.transform(at, lambda s: s["p"])).alias("geometry"))
    z = F.col("zone")
    mask = _t(spark, sf_dir, "customer").select((F.col("c_custkey") % 100).alias("zone")).distinct().filter("zone % 3 = 1")
    mask = mask.select("zone", G.box(z % 10 * 1000, F.floor(z / 10) * 1000, z % 10 * 1000 + 1000, F.floor(z / 10) * 1000 + 1000).alias("geometry"))
    return P.clip(users, mask, "user_id").select("user_id", F.size(G.vertices(F.col("geometry"))).cast("long").alias("n"))


@query("""WITH g AS (SELECT s_nationkey, s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END AS dim, s_suppkey * 31 % 7 + 1 AS a, s_suppkey * 17 % 5 + 1 AS b FROM supplier),
m AS (SELECT *, CASE dim WHEN 2 THEN a * b ELSE 0 END AS area, CASE dim WHEN 2 THEN 2 * (a + b) WHEN 1 THEN 1000 * a ELSE 0 END AS outline FROM g)
SELECT s_nationkey, s_suppkey FROM m QUALIFY row_number() OVER (PARTITION BY s_nationkey ORDER BY dim DESC, area DESC, outline DESC, s_suppkey) = 1""")
def dedupe_largest(spark, sf_dir):
    """Of each nation's points, lines and areas the largest: small areas go before long lines."""
    k = F.col("s_suppkey")
    a, b, zero = k * 31 % 7 + 1, k * 17 % 5 + 1, F.lit(0)
    shape = F.when(k % 3 == 0, G.point(k, k)).when(k % 3 == 1, G.line(G.xy(zero, zero), G.xy(1000 * a, zero))).otherwise(G.box(zero, zero, a, b))
    rows = _t(spark, sf_dir, "supplier").select("s_nationkey", "s_suppkey", shape.alias("geometry"))
    return A.deduplicate(rows, ["s_nationkey"], ["s_suppkey"], "largest_geometry").select("s_nationkey", "s_suppkey")


@query(f"""WITH z AS (SELECT z AS zone, z % 10 * 1000 + 303 AS x0, z // 10 * 1000 + 207 AS y0 FROM (SELECT DISTINCT c_custkey % 100 AS z FROM customer)),
every AS (SELECT zone, count(*) AS n FROM z, range(-20, 220) r(r), range(0, 230) c(c) WHERE (c + 0.5) * 50 > x0 AND 10050 - (r + 0.5) * 50 > y0 AND (c + 0.5) * 50 - x0 + 10050 - (r + 0.5) * 50 - y0 < 1000 GROUP BY 1),
good AS (SELECT zone, sum(nir) AS s, count(*) AS n FROM z JOIN ({_CELLS}) ON nir IS NOT NULL AND (col + 0.5) * 50 > x0 AND 10050 - (row + 0.5) * 50 > y0 AND (col + 0.5) * 50 - x0 + 10050 - (row + 0.5) * 50 - y0 < 1000 GROUP BY 1)
SELECT zone, CASE WHEN coalesce(good.n, 0) / every.n >= 0.5 THEN good.s END AS sum_value, round(coalesce(good.n, 0) / every.n, 9) AS share FROM z LEFT JOIN every USING (zone) LEFT JOIN good USING (zone)""")
def zonal_valid_share(spark, sf_dir):
    """Sums in slanted zones, some of them partly beyond the raster, and which share of a zone's cells has a value."""
    z = F.col("zone")
    x, y = z % 10 * 1000 + 303, F.floor(z / 10) * 1000 + 207
    zones = _t(spark, sf_dir, "customer").select((F.col("c_custkey") % 100).alias("zone")).distinct()
    zones = zones.select("zone", G.polygon_of(F.array(G.xy(x, y), G.xy(x + 1000, y), G.xy(x, y + 1000), G.xy(x, y))).alias("geometry"))
    out = R.zonal_stats(zones, _cells(spark, sf_dir), _GRID, "zone", "nir", valid_share_field="share", min_valid_share=0.5)
    return out.select("zone", "sum_value", F.round("share", 9).alias("share"))


@query("""WITH s AS (SELECT s_suppkey AS id, s_suppkey % 13 + 6 AS a, s_suppkey % 4 + 1 AS b FROM supplier)
SELECT id, CAST(a * a - b * b + CASE WHEN id % 3 = 0 THEN 4 ELSE 0 END AS DOUBLE) AS area, CAST(CASE WHEN id % 5 = 0 THEN 1 ELSE 0 END AS BIGINT) AS lost FROM s""")
def relation_areas(spark, sf_dir):
    """Areas of relations made of lines in any direction: a square with a square hole, for some an island beside, or a stray line."""
    k = F.col("id")
    s = _t(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("id")).withColumns({"a": k % 13 + 6, "b": k % 4 + 1})
    a, b, o = F.col("a"), F.col("b"), F.lit(0)
    square = lambda x, y, side: [(x, y), (x + side, y), (x + side, y + side), (x, y + side)]
    lines = []
    for corners in (square(o, o, a), square(o + 1, o + 1, b), square(a + 5, o, F.lit(2))):
        p = [G.xy(*c) for c in corners]
        # One side by itself, one backwards, two in one line.
        lines += [G.line(p[0], p[1]), G.line(p[2], p[1]), G.line(p[2], p[3], p[0])]
    stray = G.line(G.xy(o, o), G.xy(o - 3, o - 3))
    all_ = F.array(*[F.struct(F.lit(i).alias("i"), g.alias("geometry")) for i, g in enumerate([*lines, stray])])
    ways = s.select("id", F.explode(all_).alias("w")).filter("(w.i < 6) OR (w.i < 9 AND id % 3 = 0) OR (w.i = 9 AND id % 5 = 0)")
    ways = ways.select("id", F.concat_ws("/", "id", "w.i").alias("ref"), "w.geometry")
    members = F.collect_list(F.struct(F.lit("way").alias("type"), "ref", F.lit("").alias("role"))).alias("members")
    relations = ways.groupBy("id").agg(members).withColumn("tags", F.create_map(F.lit("type"), F.lit("multipolygon")))
    out = osm.relation_areas(relations, ways.select(F.col("ref").alias("id"), "geometry"), {"type": "multipolygon"})
    return out.select("id", F.round(G.area(F.col("geometry")), 6).alias("area"), "lost")


_CROWD = "SELECT c_custkey AS k, c_nationkey * 1000 + c_custkey * 7919 % 97 AS x, c_custkey * 104729 % 89 AS y FROM customer"


@query(f"""WITH RECURSIVE p AS ({_CROWD}),
n AS (SELECT a.k, b.k AS k2, sqrt(CAST((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS DOUBLE)) AS d FROM p a JOIN p b ON (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 225),
core AS (SELECT k FROM n GROUP BY k HAVING count(*) >= 4),
e AS (SELECT k, k2 FROM n WHERE k IN (FROM core) AND k2 IN (FROM core)),
reach AS (SELECT k, k AS r FROM core UNION SELECT reach.k, e.k2 FROM reach JOIN e ON e.k = reach.r),
root AS (SELECT k, min(r) AS root FROM reach GROUP BY k),
lab AS (SELECT * FROM root UNION ALL SELECT n.k, arg_min(root.root, (n.d, n.k2)) FROM n JOIN root ON root.k = n.k2 WHERE n.k NOT IN (FROM core) GROUP BY n.k),
ids AS (SELECT root, row_number() OVER (ORDER BY min(k)) - 1 AS id, count(*) AS size FROM lab GROUP BY root)
SELECT p.k AS c_custkey, coalesce(ids.id, -1) AS cluster, coalesce(ids.size, 0) AS size FROM p LEFT JOIN lab ON lab.k = p.k LEFT JOIN ids ON ids.root = lab.root""")
def cluster_crowds(spark, sf_dir):
    """Customers crowded around their nations."""
    x, y = F.col("c_nationkey") * 1000 + F.col("c_custkey") * 7919 % 97, F.col("c_custkey") * 104729 % 89
    points = _t(spark, sf_dir, "customer").select("c_custkey", G.point(x, y).alias("geometry"))
    return CL.cluster(points, "c_custkey", 15.0, 4, size_field="size").drop("geometry")


_UNEVEN = "SELECT s_suppkey AS k, s_suppkey * 7919 % 10007 AS x, s_suppkey * 104729 % 10009 AS y, CASE WHEN s_suppkey % 10 = 0 THEN 5000 ELSE 50 END AS side FROM supplier"


@query(f"""SELECT z.k AS s_suppkey, count(c.x) AS count FROM ({_UNEVEN}) z LEFT JOIN (SELECT c_custkey * 7919 % 10007 AS x, c_custkey * 104729 % 10009 AS y FROM customer) c
ON c.x BETWEEN z.x AND z.x + z.side AND c.y BETWEEN z.y AND z.y + z.side GROUP BY z.k""")
def agg_uneven_zones(spark, sf_dir):
    """Customers in squares of 50 and of 5,000 metres, in cells of two sizes."""
    at, side = F.col("geometry"), F.when(F.col("s_suppkey") % 10 == 0, 5000).otherwise(50)
    x, y = G.px(at), G.py(at)
    zones = _place(_t(spark, sf_dir, "supplier"), "s_suppkey").select("s_suppkey", G.box(x, y, x + side, y + side).alias("geometry"))
    points = _place(_t(spark, sf_dir, "customer"), "c_custkey").select("geometry")
    return S.aggregate(zones, points, "s_suppkey", cell=(100.0, 6400.0)).drop("geometry")


@query("""WITH l AS (SELECT s_suppkey, s_suppkey % 300 - 150 AS x0, s_suppkey % 140 - 70 AS y0, s_suppkey * 7 % 20 AS dx, s_suppkey * 11 % 17 - 8 AS dy FROM supplier),
tried AS (SELECT s_suppkey, k, p.j, 6378137.0 * radians(x0 + dx * p.j / (4.0 * k)) AS x, 6378137.0 * ln(tan(pi() / 4 + radians(y0 + dy * p.j / (4.0 * k)) / 2)) AS y
  FROM l, (SELECT (2 ** i)::INT AS k FROM range(9) t(i)) g, LATERAL (SELECT unnest(range(4 * k + 1)) AS j) p),
off AS (SELECT a.s_suppkey, a.k, max(sqrt((b.x - a.x - (c.x - a.x) * (b.j - a.j) / 4.0) ** 2 + (b.y - a.y - (c.y - a.y) * (b.j - a.j) / 4.0) ** 2)) AS d
  FROM tried a JOIN tried b ON b.s_suppkey = a.s_suppkey AND b.k = a.k AND a.j % 4 = 0 AND b.j BETWEEN a.j AND a.j + 4 JOIN tried c ON c.s_suppkey = a.s_suppkey AND c.k = a.k AND c.j = a.j + 4 GROUP BY ALL)
SELECT s_suppkey, min(k) + 1 AS vertices FROM off WHERE d <= 100 GROUP BY s_suppkey""")
def densify_lines(spark, sf_dir):
    """Vertices of lines of up to 20 degrees, so that they stay within 100 metres on a Mercator map."""
    k = F.col("s_suppkey")
    x, y = k % 300 - 150, k % 140 - 70
    line = G.line(G.xy(x, y), G.xy(x + k * 7 % 20, y + (k * 11 % 17 - 8)))
    return _t(spark, sf_dir, "supplier").select("s_suppkey", F.size(G.vertices(crs.reproject(line, 3857, within=100.0))).cast("long").alias("vertices"))
