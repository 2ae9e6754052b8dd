"""A query for each operator on the driver's tables, and the same in DuckDB's SQL.

The tables have no coordinates, so places are made from keys by the same arithmetic on both sides: an event is at
x = event_id * 7919 % 10007, y = event_id * 104729 % 10009 (metres); a zone is one of 100 squares of 1 km, each with the customers
whose keys end in its number, and a core is a square in it, the larger the more orders they have. The 50 m cells of the
raster sum the quantities of order lines.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.functions import geometry as G
from geoloom.operators import attributes as A
from geoloom.operators import clusters as CL
from geoloom.operators import network as N
from geoloom.operators import polygons as P
from geoloom.operators import raster as R
from geoloom.operators import nearest
from geoloom.operators import spatial as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def keep(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _place(df: DataFrame, key: str) -> DataFrame:
    return df.withColumn("geometry", G.point(F.col(key) * 7919 % 10007, F.col(key) * 104729 % 10009))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _place(_t(spark, sf_dir, "events"), "event_id")


def _square(df: DataFrame, x: Column, y: Column, side: float) -> DataFrame:
    return df.withColumn("geometry", G.box(x, y, x + side, y + side))


def _zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = _t(spark, sf_dir, "customer").select((F.col("c_custkey") % 100).alias("zone")).distinct()
    return _square(z, F.col("zone") % 10 * 1000, F.floor(F.col("zone") / 10) * 1000, 1000.0)


_EV = "SELECT *, event_id * 7919 % 10007 AS x, event_id * 104729 % 10009 AS y FROM events"
_ZONES = "SELECT z AS zone, z % 10 * 1000 AS x0, z // 10 * 1000 AS y0 FROM (SELECT DISTINCT c_custkey % 100 AS z FROM customer)"
_IN_ZONE = "e.x BETWEEN z.x0 AND z.x0 + 1000 AND e.y BETWEEN z.y0 AND z.y0 + 1000"


# --- attributes -------------------------------------------------------------------------------------------------


@query("SELECT p_name, p_partkey, p_retailprice FROM part")
def select_columns(spark, sf_dir):
    return A.select_columns(_t(spark, sf_dir, "part"), keep=["p_name", "p_partkey", "p_retailprice"])


@query("SELECT * FROM lineitem WHERE l_quantity > 45 AND l_returnflag = 'R' AND l_discount >= 0.05")
def filter_exclude(spark, sf_dir):
    return A.filter_rows(_t(spark, sf_dir, "lineitem"), "l_quantity > 45 AND l_returnflag = 'R' AND l_discount >= 0.05", ["l_quantity", "l_returnflag", "l_discount"])


@query("SELECT o_orderkey, o_custkey, CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE o_totalprice END AS price FROM orders WHERE o_custkey % 3 = 0 OR o_totalprice > 300000")
def filter_include(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.when(F.col("o_custkey") % 3 != 0, F.col("o_totalprice")).alias("price"))
    return A.filter_rows(o, "price > 300000", ["price"], on_missing="include")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) >= 50")
def filter_typed(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))
    return A.filter_rows(e, "k >= 50", ["k"], types={"k": "integer"})


@query("SELECT l_orderkey, l_linenumber, round_even(CASE WHEN l_tax = 0 THEN NULL ELSE l_discount / l_tax END, 3) AS ratio FROM lineitem")
def calc_ratio(spark, sf_dir):
    rows = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_discount", "l_tax")
    return A.calculate_field(rows, F.try_divide("l_discount", "l_tax"), "ratio", 3).drop("l_discount", "l_tax")


@query("SELECT s_suppkey, CASE WHEN s_acctbal > 0 THEN sqrt(s_acctbal) ELSE abs(s_acctbal) END AS v FROM supplier")
def calc_where(spark, sf_dir):
    rows = _t(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal")
    return A.calculate_field(rows, F.when(F.col("s_acctbal") > 0, F.sqrt("s_acctbal")).otherwise(F.abs("s_acctbal")), "v", compared=["s_acctbal"]).drop("s_acctbal")


@query("SELECT p_partkey, CAST(least(greatest(p_size, 10), 40) AS DOUBLE) AS clipped FROM part")
def calc_clip(spark, sf_dir):
    rows = _t(spark, sf_dir, "part").select("p_partkey", "p_size")
    return A.calculate_field(rows, A.clip_value(F.col("p_size"), F.lit(10), F.lit(40)), "clipped").drop("p_size")


@query("SELECT p_partkey, CASE WHEN p_retailprice < 1000 THEN 'low' WHEN p_retailprice < 1500 THEN 'mid' ELSE 'high' END AS class FROM part")
def classify_price(spark, sf_dir):
    return A.classify(_t(spark, sf_dir, "part"), "p_retailprice", [1000, 1500], ["low", "mid", "high"]).select("p_partkey", "class")


@query("""SELECT c_custkey, round(0.7 * (c_acctbal - min(c_acctbal) OVER ()) / (max(c_acctbal) OVER () - min(c_acctbal) OVER ())
 + 0.3 * (1 - CAST(c_nationkey - min(c_nationkey) OVER () AS DOUBLE) / (max(c_nationkey) OVER () - min(c_nationkey) OVER ())), 9) AS score FROM customer""")
def rank_customers(spark, sf_dir):
    out = A.ranking(_t(spark, sf_dir, "customer"), ["c_acctbal", "c_nationkey"], [0.7, 0.3], [False, True])
    return out.select("c_custkey", F.round("score", 9).alias("score"))


@query("SELECT s_suppkey, s_acctbal, row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) AS rank FROM supplier QUALIFY rank <= 25")
def top_suppliers(spark, sf_dir):
    return A.top_n(_t(spark, sf_dir, "supplier"), "s_acctbal", 25, ties=["s_suppkey"], rank_field="rank").select("s_suppkey", "s_acctbal", "rank")


@query("SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1")
def dedupe_first(spark, sf_dir):
    return A.deduplicate(_t(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"])


@query("SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_totalprice DESC, o_orderkey DESC) = 1")
def dedupe_last(spark, sf_dir):
    return A.deduplicate(_t(spark, sf_dir, "orders"), ["o_custkey", "o_orderpriority"], ["o_totalprice", "o_orderkey"], keep="last")


@query("""SELECT s.s_suppkey, s.s_name, n.n_name, n.n_regionkey FROM supplier s LEFT JOIN nation n
 ON lpad(CAST(s.s_nationkey AS VARCHAR), 4, '0') = lpad(CAST(n.n_nationkey AS VARCHAR), 4, '0')""")
def attr_join(spark, sf_dir):
    left = _t(spark, sf_dir, "supplier").withColumn("code", F.lpad(F.col("s_nationkey").cast("string"), 4, "0"))
    return A.attribute_join(left, _t(spark, sf_dir, "nation"), "code", "n_nationkey", ["n_name", "n_regionkey"]).select("s_suppkey", "s_name", "n_name", "n_regionkey")


@query("SELECT c_custkey AS key, c_name AS name, c_mktsegment AS segment FROM customer UNION ALL BY NAME SELECT s_suppkey AS key, s_name AS name FROM supplier")
def union_by_name(spark, sf_dir):
    c = _t(spark, sf_dir, "customer").selectExpr("c_custkey AS key", "c_name AS name", "c_mktsegment AS segment")
    return A.vector_union(c, _t(spark, sf_dir, "supplier").selectExpr("s_suppkey AS key", "s_name AS name"))


@query("SELECT c_nationkey AS nation, c_acctbal AS bal, 'customers' AS source FROM customer UNION ALL SELECT s_nationkey, s_acctbal, 'suppliers' FROM supplier")
def collect_source(spark, sf_dir):
    return A.collect({
        "customers": _t(spark, sf_dir, "customer").selectExpr("c_nationkey AS nation", "c_acctbal AS bal"),
        "suppliers": _t(spark, sf_dir, "supplier").selectExpr("s_nationkey AS nation", "s_acctbal AS bal"),
    })


@query("SELECT * FROM nation")
def gate_open(spark, sf_dir):
    return A.gate(_t(spark, sf_dir, "nation"), min_rows=5, max_rows=100, require_fields=["n_name"])


@query("SELECT * FROM nation WHERE false")
def gate_closed(spark, sf_dir):
    return A.gate(_t(spark, sf_dir, "nation"), max_rows=5)


@query("SELECT l_orderkey, l_linenumber, l_discount FROM lineitem WHERE l_discount BETWEEN 0.02 AND 0.07 AND l_shipdate IS NOT NULL")
def validate_drop(spark, sf_dir):
    df, _ = A.validate(_t(spark, sf_dir, "lineitem"), required=["l_shipdate"], ranges={"l_discount": (0.02, 0.07)}, policy="drop")
    return df.select("l_orderkey", "l_linenumber", "l_discount")


@query("""WITH o AS (SELECT o_custkey, o_totalprice, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey DESC) = 1)
SELECT o.o_custkey, o.o_totalprice, c.c_name, row_number() OVER (ORDER BY o.o_totalprice DESC, o.o_custkey) AS rank FROM o LEFT JOIN customer c ON c.c_custkey = o.o_custkey QUALIFY rank <= 20""")
def best_orders(spark, sf_dir):
    """deduplicate, attribute_join, top_n: the smallest whole scenario."""
    one = A.deduplicate(_t(spark, sf_dir, "orders").select("o_custkey", "o_totalprice", "o_orderkey"), ["o_custkey"], ["o_totalprice", "o_orderkey"], keep="last")
    named = A.attribute_join(one, _t(spark, sf_dir, "customer"), "o_custkey", "c_custkey", ["c_name"], normalize=False)
    return A.top_n(named, "o_totalprice", 20, ties=["o_custkey"], rank_field="rank").select("o_custkey", "o_totalprice", "c_name", "rank")


# --- geometry and spatial joins ---------------------------------------------------------------------------------


@query("SELECT p_partkey, CAST(p_size * p_size AS DOUBLE) / 10000 AS area_ha FROM part")
def area_boxes(spark, sf_dir):
    p = _t(spark, sf_dir, "part")
    at = F.col("p_partkey") * 10.0
    boxes = p.select("p_partkey", G.box(at, at, at + F.col("p_size"), at + F.col("p_size")).alias("geometry"))
    return S.area(boxes, "ha").drop("geometry")


@query("SELECT p_partkey, round(sqrt(p_size * p_size * 9.0 + p_size * p_size * 16.0) / 1000, 6) AS length_km FROM part")
def length_lines(spark, sf_dir):
    lines = _t(spark, sf_dir, "part").select("p_partkey", G.line(G.xy(F.lit(0), F.lit(0)), G.xy(F.col("p_size") * 3, F.col("p_size") * 4)).alias("geometry"))
    return S.length(lines, "km", decimals=6).drop("geometry")


@query(f"SELECT s_suppkey, round({32 * math.sin(2 * math.pi / 64)!r}::DOUBLE * 250000, 3) AS area FROM supplier")
def buffer_area(spark, sf_dir):
    out = S.buffer_points(_place(_t(spark, sf_dir, "supplier"), "s_suppkey"), 0.5)
    return out.select("s_suppkey", F.round(G.area(F.col("geometry")), 3).alias("area"))


@query("SELECT s_suppkey AS id, 1 AS dim FROM supplier")
def homogenize(spark, sf_dir):
    points = _place(_t(spark, sf_dir, "customer"), "c_custkey").select(F.col("c_custkey").alias("id"), "geometry")
    lines = _t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), G.line(G.xy(F.lit(0), F.lit(0)), G.xy(F.col("s_suppkey"), F.lit(1))).alias("geometry"))
    return S.homogenize_geometry(points.union(lines)).select("id", F.col("geometry.dim").alias("dim"))


@query(f"SELECT e.event_id, z.zone FROM ({_EV}) e LEFT JOIN ({_ZONES}) z ON {_IN_ZONE}")
def spatial_join(spark, sf_dir):
    return S.spatial_join(_events(spark, sf_dir).select("event_id", "geometry"), _zones(spark, sf_dir), "event_id").select("event_id", "zone")


@query(f"SELECT z.zone, count(e.event_id) AS count FROM ({_ZONES}) z LEFT JOIN ({_EV}) e ON {_IN_ZONE} GROUP BY z.zone")
def agg_count(spark, sf_dir):
    return S.aggregate(_zones(spark, sf_dir), _events(spark, sf_dir), "zone").select("zone", "count")


@query(f"SELECT z.zone, round(coalesce(sum(e.value), 0.0), 2) AS sum FROM ({_ZONES}) z LEFT JOIN ({_EV}) e ON {_IN_ZONE} GROUP BY z.zone")
def agg_sum(spark, sf_dir):
    return S.aggregate(_zones(spark, sf_dir), _events(spark, sf_dir), "zone", "sum", "value").select("zone", F.round("sum", 2).alias("sum"))


@query(f"SELECT z.zone, round(avg(e.value), 6) AS mean FROM ({_ZONES}) z LEFT JOIN ({_EV}) e ON {_IN_ZONE} GROUP BY z.zone")
def agg_mean(spark, sf_dir):
    return S.aggregate(_zones(spark, sf_dir), _events(spark, sf_dir), "zone", "mean", "value").select("zone", F.round("mean", 6).alias("mean"))


@query(
    "SELECT z.zone, " + ", ".join(f"count(*) FILTER (e.event_type = '{k}') AS count_{k}" for k in ("click", "error", "purchase", "signup", "view")) + f" FROM ({_ZONES}) z LEFT JOIN ({_EV}) e ON {_IN_ZONE} GROUP BY z.zone"
)
def agg_group(spark, sf_dir):
    return S.aggregate(_zones(spark, sf_dir), _events(spark, sf_dir), "zone", group_by="event_type").drop("geometry")


@query("""WITH p AS (SELECT c_custkey AS k, c_custkey * 7919 % 10007 AS x, c_custkey * 104729 % 10009 AS y FROM customer),
t AS (SELECT DISTINCT s_suppkey * 7919 % 10007 AS x, s_suppkey * 104729 % 10009 AS y FROM supplier)
SELECT p.k AS c_custkey, round(min(sqrt(CAST((p.x - t.x) * (p.x - t.x) + (p.y - t.y) * (p.y - t.y) AS DOUBLE))), 6) AS distance
FROM p LEFT JOIN t ON p.x <> t.x OR p.y <> t.y GROUP BY p.k""")
def nearest_distance(spark, sf_dir):
    probes = _place(_t(spark, sf_dir, "customer"), "c_custkey").select("c_custkey", "geometry")
    out = nearest.nearest_distance(probes, _place(_t(spark, sf_dir, "supplier"), "s_suppkey"), "c_custkey", 500.0)
    return out.select("c_custkey", F.round("distance", 6).alias("distance"))


_RAD = 500 / math.sqrt(3)
_HEX = f"""WITH c AS (SELECT ({math.sqrt(3) / 3!r} * CAST(x AS DOUBLE) - CAST(y AS DOUBLE) / 3) / {_RAD!r} AS q, ({2.0 / 3!r} * CAST(y AS DOUBLE)) / {_RAD!r} AS r FROM ({_EV})),
d AS (SELECT q, r, round_even(q, 0) AS rq, round_even(r, 0) AS rr, round_even(-q - r, 0) AS rs FROM c),
f AS (SELECT *, abs(rq - q) AS dq, abs(rr - r) AS dr, abs(rs - (-q - r)) AS ds FROM d)
SELECT CAST(CASE WHEN dq > dr AND dq > ds THEN -rr - rs ELSE rq END AS BIGINT) AS q, CAST(CASE WHEN NOT (dq > dr AND dq > ds) AND dr > ds THEN -rq - rs ELSE rr END AS BIGINT) AS r, count(*) AS count FROM f GROUP BY 1, 2"""


@query(_HEX)
def hexbin(spark, sf_dir):
    return S.hexbin(_events(spark, sf_dir), 0.5).drop("geometry")


@query(f"""SELECT q, r FROM range(-30, 40) a(q), range(-2, 30) b(r)
JOIN (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM ({_EV})) e ON {_RAD!r} * {math.sqrt(3)!r} * (q + r / 2.0) BETWEEN x0 AND x1 AND {1.5 * _RAD!r} * r BETWEEN y0 AND y1""")
def hex_grid(spark, sf_dir):
    """Hexagons over the extent of the events."""
    x, y = G.px(F.col("geometry")), G.py(F.col("geometry"))
    ends = _events(spark, sf_dir).agg(F.min(x).alias("x0"), F.min(y).alias("y0"), F.max(x).alias("x1"), F.max(y).alias("y1"))
    region = ends.select(G.box(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")).alias("geometry"))
    return S.hex_grid(region, 0.5).select("q", "r")


_CL = "SELECT s_suppkey AS k, s_suppkey * 7919 % 10007 AS x, s_suppkey * 104729 % 10009 AS y FROM supplier"


@query(f"""WITH RECURSIVE p AS ({_CL}),
n AS (SELECT a.k, b.k AS k2, sqrt(CAST((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS DOUBLE)) AS d FROM p a JOIN p b ON (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 810000),
core AS (SELECT k FROM n GROUP BY k HAVING count(*) >= 4),
e AS (SELECT k, k2 FROM n WHERE k IN (FROM core) AND k2 IN (FROM core)),
reach AS (SELECT k, k AS r FROM core UNION SELECT reach.k, e.k2 FROM reach JOIN e ON e.k = reach.r),
root AS (SELECT k, min(r) AS root FROM reach GROUP BY k),
lab AS (SELECT * FROM root UNION ALL SELECT n.k, arg_min(root.root, (n.d, n.k2)) FROM n JOIN root ON root.k = n.k2 WHERE n.k NOT IN (FROM core) GROUP BY n.k),
ids AS (SELECT root, row_number() OVER (ORDER BY min(k)) - 1 AS id, count(*) AS size FROM lab GROUP BY root)
SELECT p.k AS s_suppkey, coalesce(ids.id, -1) AS cluster, coalesce(ids.size, 0) AS size FROM p LEFT JOIN lab ON lab.k = p.k LEFT JOIN ids ON ids.root = lab.root""")
def cluster(spark, sf_dir):
    points = _place(_t(spark, sf_dir, "supplier"), "s_suppkey").select("s_suppkey", "geometry")
    return CL.cluster(points, "s_suppkey", 900.0, 4, size_field="size").drop("geometry")


# --- polygons ---------------------------------------------------------------------------------------------------


def _sites(spark, sf_dir):
    s = _t(spark, sf_dir, "supplier").select("s_suppkey")
    return _square(s, F.col("s_suppkey") * 7919 % 10007, F.col("s_suppkey") * 104729 % 10009, 400.0)


_SITES = "SELECT s_suppkey, s_suppkey * 7919 % 10007 AS sx, s_suppkey * 104729 % 10009 AS sy FROM supplier"
_OVER = "greatest(0, least(s.sx + 400, z.x0 + 1000) - greatest(s.sx, z.x0)) * greatest(0, least(s.sy + 400, z.y0 + 1000) - greatest(s.sy, z.y0))"


@query(f"SELECT zone AS zone_1, s_suppkey AS s_suppkey_2, CAST(a AS DOUBLE) AS area FROM (SELECT z.zone, s.s_suppkey, {_OVER} AS a FROM ({_ZONES}) z, ({_SITES}) s) WHERE a > 0")
def overlay_intersection(spark, sf_dir):
    return P.overlay(_zones(spark, sf_dir), _sites(spark, sf_dir), "zone", "s_suppkey").select("zone_1", "s_suppkey_2", F.round("area", 3).alias("area"))


@query(f"SELECT zone, round(sum({_OVER}) / 1e6, 4) AS share FROM ({_ZONES}) z, ({_SITES}) s GROUP BY zone")
def area_share(spark, sf_dir):
    return P.area_share(_zones(spark, sf_dir), _sites(spark, sf_dir), "zone", dissolve=False, decimals=4).select("zone", "share")


@query(f"SELECT e.event_id FROM ({_EV}) e WHERE EXISTS (SELECT 1 FROM ({_ZONES}) z WHERE z.zone % 7 = 0 AND {_IN_ZONE})")
def clip_points(spark, sf_dir):
    return P.clip(_events(spark, sf_dir).select("event_id", "geometry"), _zones(spark, sf_dir).filter("zone % 7 = 0"), "event_id").select("event_id")


_WAYS = "SELECT s_suppkey, s_suppkey * 7919 % 10007 AS x, s_suppkey * 104729 % 10009 AS y FROM supplier"


@query(f"""WITH t AS (SELECT s.s_suppkey, greatest(0.0, (z.x0 - s.x) / 900.0, (z.y0 - s.y) / 1200.0) AS t0, least(1.0, (z.x0 + 1000 - s.x) / 900.0, (z.y0 + 1000 - s.y) / 1200.0) AS t1
 FROM ({_WAYS}) s, ({_ZONES}) z WHERE z.zone % 7 = 0)
SELECT s_suppkey, round(sum(1500.0::DOUBLE * (t1 - t0)), 3) AS length FROM t WHERE t1 > t0 GROUP BY s_suppkey""")
def clip_lines(spark, sf_dir):
    """Slanted lines, cut at the borders of a mask of squares."""
    x, y = F.col("s_suppkey") * 7919 % 10007, F.col("s_suppkey") * 104729 % 10009
    lines = _t(spark, sf_dir, "supplier").select("s_suppkey", G.line(G.xy(x, y), G.xy(x + 900, y + 1200)).alias("geometry"))
    out = P.clip(lines, _zones(spark, sf_dir).filter("zone % 7 = 0"), "s_suppkey")
    return out.select("s_suppkey", F.round(G.length(F.col("geometry")), 3).alias("length"))


_CORES = "SELECT core, core % 10 * 1000 + 50 AS x0, core // 10 * 1000 + 50 AS y0, 100 + n % 800 AS side FROM (SELECT o_custkey % 100 AS core, count(*) AS n FROM orders GROUP BY 1) WHERE core % 3 = 0"


def _cores(spark, sf_dir):
    """A square in every third zone, whose side follows the number of its orders."""
    n = _t(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 100).alias("core")).agg(F.count("*").alias("n")).filter("core % 3 = 0")
    side = 100 + F.col("n") % 800
    return _square(n, F.col("core") % 10 * 1000 + 50, F.floor(F.col("core") / 10) * 1000 + 50, side).drop("n")


@query(f"SELECT core // 10 AS strip, sum(side * side)::DOUBLE AS area FROM ({_CORES}) GROUP BY 1")
def dissolve_strips(spark, sf_dir):
    cores = _cores(spark, sf_dir).withColumn("strip", F.floor(F.col("core") / 10).cast("long"))
    return P.dissolve(cores, by="strip").select("strip", F.round("area", 3).alias("area"))


# --- rasters ----------------------------------------------------------------------------------------------------

_GRID = R.Grid(0.0, 10050.0, 50.0, 201, 202)
_LINE_CELL = "(l_orderkey * 7919 + l_linenumber * 104729) % 40602"
_CELLS = f"""SELECT id // 202 AS row, id % 202 AS col, coalesce(red, 0.0::DOUBLE) AS red, nir FROM range(40602) t(id)
LEFT JOIN (SELECT {_LINE_CELL} AS id, sum(l_quantity) AS red, sum(l_quantity) FILTER (l_returnflag = 'A') AS nir FROM lineitem GROUP BY 1) USING (id)"""


def _cells(spark, sf_dir):
    """Every cell with the quantities of its order lines, and those of returned ones, null where there are none."""
    lines = _t(spark, sf_dir, "lineitem").withColumn("id", F.expr(_LINE_CELL))
    sums = lines.groupBy("id").agg(F.sum("l_quantity").alias("red"), F.sum(F.when(F.col("l_returnflag") == "A", F.col("l_quantity"))).alias("nir"))
    ids = _GRID.cells(spark).withColumn("id", F.col("row") * 202 + F.col("col"))
    return ids.join(sums, "id", "left").select("row", "col", F.coalesce("red", F.lit(0.0)).alias("red"), "nir")


@query(f"SELECT row, col, round(CASE WHEN nir + red = 0 THEN NULL ELSE (nir - red) / (nir + red) END, 9) AS ndvi FROM ({_CELLS})")
def raster_calc(spark, sf_dir):
    out = R.raster_calc(_cells(spark, sf_dir), "try_divide(nir - red, nir + red)", ["red", "nir"], "ndvi")
    return out.select("row", "col", F.round("ndvi", 9).alias("ndvi"))


@query(f"SELECT row, col, CASE WHEN nir IS NULL THEN NULL WHEN nir < 20 THEN 1.0::DOUBLE WHEN nir < 60 THEN 2.0::DOUBLE ELSE 3.0::DOUBLE END AS class FROM ({_CELLS})")
def raster_classify(spark, sf_dir):
    return R.raster_classify(_cells(spark, sf_dir), "nir", [20, 60], [1, 2, 3])


@query(f"SELECT row // 10 AS row, col // 10 AS col, sum(nir) AS nir FROM ({_CELLS}) GROUP BY 1, 2")
def raster_blocks(spark, sf_dir):
    return R.block_aggregate(_cells(spark, sf_dir), "nir", 10, 10)


@query(f"SELECT a.row, a.col, b.nir FROM (SELECT id // 100 AS row, id % 100 AS col FROM range(10000) t(id)) a LEFT JOIN ({_CELLS}) b ON b.row = CAST(floor(a.row * 2 + 1 - 0.5 + 0.5) AS BIGINT) AND b.col = CAST(floor(a.col * 2 + 1 - 0.5 + 0.5) AS BIGINT)")
def raster_warp(spark, sf_dir):
    return R.warp(_cells(spark, sf_dir), "nir", _GRID, R.Grid(0.0, 10050.0, 100.0, 100, 100), F.col("x"), F.col("y"))


@query(f"""SELECT g.row, g.col, e.v AS value FROM ({_CELLS}) g LEFT JOIN (SELECT CAST(floor((10050 - y) / 50.0) AS BIGINT) AS row, CAST(floor(x / 50.0) AS BIGINT) AS col, arg_max(value, event_id) AS v FROM ({_EV}) GROUP BY 1, 2) e ON e.row = g.row AND e.col = g.col""")
def rasterize_events(spark, sf_dir):
    return R.rasterize(_events(spark, sf_dir), _GRID, ["event_id"], "value")


@query(f"""WITH s AS (SELECT s_suppkey, CAST(floor((10050 - y) / 50.0) AS BIGINT) AS r0, CAST(floor(x / 50.0) AS BIGINT) AS c0, CAST(floor((10050 - y - 1200) / 50.0) AS BIGINT) AS r1, CAST(floor((x + 900) / 50.0) AS BIGINT) AS c1 FROM ({_WAYS})),
t AS (SELECT s_suppkey, r0 - i AS row, c0 + greatest(0, CAST(ceil((i * (c1 - c0) - (r0 - r1) // 2) / (r0 - r1)::DOUBLE) AS BIGINT)) AS col FROM s, range(25) g(i) WHERE i <= r0 - r1)
SELECT row, col, max(s_suppkey)::DOUBLE AS value FROM t WHERE row BETWEEN 0 AND 200 AND col BETWEEN 0 AND 201 GROUP BY 1, 2""")
def rasterize_lines(spark, sf_dir):
    x, y = F.col("s_suppkey") * 7919 % 10007, F.col("s_suppkey") * 104729 % 10009
    lines = _t(spark, sf_dir, "supplier").select("s_suppkey", G.line(G.xy(x, y), G.xy(x + 900, y + 1200)).alias("geometry"))
    return R.rasterize(lines, _GRID, ["s_suppkey"], "s_suppkey").filter("value IS NOT NULL")


_ZONAL = f"({_ZONES}) z LEFT JOIN ({_CELLS}) c ON (c.col + 0.5) * 50 BETWEEN z.x0 AND z.x0 + 1000 AND 10050 - (c.row + 0.5) * 50 BETWEEN z.y0 AND z.y0 + 1000 AND c.nir IS NOT NULL GROUP BY z.zone"


@query(f"SELECT z.zone, sum(c.nir) AS sum_value FROM {_ZONAL}")
def zonal_sum(spark, sf_dir):
    return R.zonal_stats(_zones(spark, sf_dir), _cells(spark, sf_dir), _GRID, "zone", "nir").drop("geometry")


@query(f"SELECT z.zone, round(stddev_pop(c.nir), 6) AS std_value FROM {_ZONAL}")
def zonal_std(spark, sf_dir):
    return R.zonal_stats(_zones(spark, sf_dir), _cells(spark, sf_dir), _GRID, "zone", "nir", "std", 6).drop("geometry")


# --- networks ---------------------------------------------------------------------------------------------------


@query("SELECT DISTINCT event_type AS from_id, nxt AS to_id FROM (SELECT event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS nxt FROM events) WHERE nxt IS NOT NULL AND nxt <> event_type")
def gtfs_edges(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    times = e.select(F.col("user_id").alias("trip_id"), F.col("event_type").alias("stop_id"), F.col("event_id").alias("stop_sequence"))
    trips = e.select(F.col("user_id").alias("trip_id"), F.lit("r").alias("route_id")).distinct()
    routes = spark.range(1).select(F.lit("r").alias("route_id"), F.lit(3).alias("route_type"))
    stops = e.select(F.col("event_type").alias("stop_id")).distinct().select("stop_id", F.length("stop_id").alias("stop_lon"), F.lit(0).alias("stop_lat"))
    return N.gtfs_edges(times, trips, routes, stops, [3])[1].select("from_id", "to_id")


def _places(spark, sf_dir):
    n = _t(spark, sf_dir, "nation")
    return n.select(F.col("n_nationkey").cast("long").alias("id"), (F.col("n_nationkey") * 7919 % 10007).cast("double").alias("x"), (F.col("n_nationkey") * 104729 % 10009).cast("double").alias("y"))


def _links(spark, sf_dir):
    s = _t(spark, sf_dir, "supplier")
    return s.select(F.col("s_nationkey").cast("long").alias("a"), (F.col("s_suppkey") * 5 % 25).alias("b"), (F.col("s_suppkey") % 97 + 1).cast("string").alias("km"))


_LINKS = "SELECT least(s_nationkey, s_suppkey * 5 % 25) AS u, greatest(s_nationkey, s_suppkey * 5 % 25) AS v, (s_suppkey % 97 + 1) * 1000.0 AS length FROM supplier"


@query(f"SELECT CAST(u AS BIGINT) AS u, CAST(v AS BIGINT) AS v, CAST(min(length) AS DOUBLE) AS length, count(*) AS parallel_edges FROM ({_LINKS}) WHERE u <> v GROUP BY 1, 2")
def edge_list_network(spark, sf_dir):
    return N.edge_list_network(_places(spark, sf_dir), _links(spark, sf_dir), "id", "a", "b", "km", 1000.0)[1]


@query(f"""WITH RECURSIVE e AS (SELECT u, v FROM ({_LINKS}) WHERE u <> v UNION SELECT v, u FROM ({_LINKS}) WHERE u <> v),
r AS (SELECT n_nationkey AS k, n_nationkey AS t FROM nation UNION SELECT r.k, e.v FROM r JOIN e ON e.u = r.t)
SELECT CAST(k AS BIGINT) AS id, CAST(min(t) AS BIGINT) AS component FROM r GROUP BY k""")
def components(spark, sf_dir):
    nodes, edges = N.edge_list_network(_places(spark, sf_dir), _links(spark, sf_dir), "id", "a", "b", "km", 1000.0)
    return N.connected_components(nodes, edges).select("id", "component")


@query(f"""WITH RECURSIVE e AS (SELECT u, v, min(length) AS w FROM (SELECT u, v, length FROM ({_LINKS}) WHERE u <> v UNION ALL SELECT v, u, length FROM ({_LINKS}) WHERE u <> v) GROUP BY 1, 2),
r(n, d) USING KEY (n) AS (SELECT CAST(0 AS BIGINT), CAST(0 AS DOUBLE) UNION
  SELECT e.v, min(r.d + e.w) FROM r JOIN e ON e.u = r.n LEFT JOIN recurring.r k ON k.n = e.v WHERE k.d IS NULL OR r.d + e.w < k.d GROUP BY 1)
SELECT CAST(n AS BIGINT) AS node, d FROM r""")
def network_distances(spark, sf_dir):
    _, edges = N.edge_list_network(_places(spark, sf_dir), _links(spark, sf_dir), "id", "a", "b", "km", 1000.0)
    return N.distances(edges, spark.range(1).select(F.lit(0).alias("source"), F.lit(0).cast("long").alias("node"))).select("node", "d")


# All shortest distances d(s, t) of the graph: paths of up to 1, 2, 4, ... 32 edges, more than 25 nodes have.
_ALL_PAIRS = f"""e AS (SELECT u, v, min(length) AS w FROM (SELECT u, v, length FROM ({_LINKS}) WHERE u <> v UNION ALL SELECT v, u, length FROM ({_LINKS}) WHERE u <> v) GROUP BY 1, 2),
d0 AS (SELECT u AS s, v AS t, w AS d FROM e UNION ALL SELECT n_nationkey, n_nationkey, 0 FROM nation),
{", ".join(f"d{i + 1} AS MATERIALIZED (SELECT a.s, b.t, min(a.d + b.d) AS d FROM d{i} a JOIN d{i} b ON a.t = b.s GROUP BY 1, 2)" for i in range(5))}"""


@query(f"""WITH RECURSIVE {_ALL_PAIRS},
ways AS (SELECT n_nationkey AS s, n_nationkey AS t FROM nation UNION ALL
  SELECT ways.s, e.v FROM ways JOIN e ON e.u = ways.t JOIN d5 a ON a.s = ways.s AND a.t = ways.t JOIN d5 b ON b.s = ways.s AND b.t = e.v WHERE a.d + e.w = b.d),
sigma AS MATERIALIZED (SELECT ways.s, ways.t, count(*) AS n, any_value(d) AS d FROM ways JOIN d5 ON d5.s = ways.s AND d5.t = ways.t GROUP BY 1, 2),
share AS (SELECT a.t AS id, sum(a.n * b.n / c.n) AS x FROM sigma a JOIN sigma b ON b.s = a.t JOIN sigma c ON c.s = a.s AND c.t = b.t WHERE a.d + b.d = c.d AND a.t <> a.s AND a.t <> b.t GROUP BY 1),
apart AS (SELECT c.n_nationkey AS cut, s.n_nationkey AS s, s.n_nationkey AS t FROM nation c, nation s WHERE c.n_nationkey <> s.n_nationkey UNION
  SELECT apart.cut, apart.s, e.v FROM apart JOIN e ON e.u = apart.t WHERE e.v <> apart.cut),
points AS (SELECT DISTINCT a.u AS id FROM e a JOIN e b ON a.u = b.u LEFT JOIN apart r ON r.cut = a.u AND r.s = a.v AND r.t = b.v WHERE r.cut IS NULL)
SELECT CAST(n_nationkey AS BIGINT) AS id, round(coalesce(x, 0) / (SELECT (count(*) - 1) * (count(*) - 2) FROM nation), 9) AS betweenness, points.id IS NOT NULL AS is_articulation_point,
  CAST((SELECT min(t) FROM d5 WHERE s = n_nationkey) AS BIGINT) AS component
FROM nation LEFT JOIN share ON share.id = n_nationkey LEFT JOIN points ON points.id = n_nationkey""")
def centrality(spark, sf_dir):
    nodes, edges = N.edge_list_network(_places(spark, sf_dir), _links(spark, sf_dir), "id", "a", "b", "km", 1000.0)
    return N.centrality(nodes, edges)[0].select("id", F.round("betweenness", 9).alias("betweenness"), "is_articulation_point", "component")


@query(f"""WITH {_ALL_PAIRS},
p AS (SELECT n_nationkey AS k, n_nationkey * 7919 % 10007 AS x, n_nationkey * 104729 % 10009 AS y FROM nation),
r AS (SELECT o.k, sqrt(power(o.x - g.x, 2) + power(o.y - g.y, 2)) AS straight, CAST(d AS DOUBLE) AS d FROM p o JOIN p g ON g.k = (o.k + 24) % 25 LEFT JOIN d5 ON d5.s = o.k AND d5.t = g.k)
SELECT CAST(k AS BIGINT) AS origin, CAST(k AS BIGINT) AS destination, d AS length_m, round(straight, 6) AS straight_line_m, round(d / straight, 9) AS detour_factor, CAST(0 AS DOUBLE) AS origin_snap_m, CAST(0 AS DOUBLE) AS destination_snap_m FROM r""")
def route_pairs(spark, sf_dir):
    nodes, edges = N.edge_list_network(_places(spark, sf_dir), _links(spark, sf_dir), "id", "a", "b", "km", 1000.0)
    points = nodes.select("id", G.point(F.col("x"), F.col("y")).alias("geometry"))
    ways = N.route(nodes, edges, points, points.withColumn("id", (F.col("id") + 1) % 25), "id", 1.0, snap_to="any_node")
    return ways.drop("path", "geometry").withColumns({"straight_line_m": F.round("straight_line_m", 6), "detour_factor": F.round("detour_factor", 9)})


@query("SELECT DISTINCT CAST(k AS DOUBLE) AS x, CAST(k % 7 AS DOUBLE) AS y FROM (SELECT s_suppkey AS k FROM supplier UNION ALL SELECT s_suppkey + 1 FROM supplier)")
def network_nodes(spark, sf_dir):
    k = F.col("s_suppkey")
    lines = _t(spark, sf_dir, "supplier").select(G.line(G.xy(k, k % 7), G.xy(k + 1, (k + 1) % 7)).alias("geometry"))
    return N.network_nodes(lines).select("x", "y")


@query("SELECT format('{:.6f}/{:.6f}', CAST(s_suppkey AS DOUBLE), 0.0::DOUBLE) AS a, CAST(1 AS DOUBLE) AS length FROM supplier")
def line_network(spark, sf_dir):
    k = F.col("s_suppkey")
    lines = _t(spark, sf_dir, "supplier").select(G.line(G.xy(k, F.lit(0)), G.xy(k + 1, F.lit(0))).alias("geometry"))
    edges = N.line_network(lines)[1]
    left = F.when(F.split("u", "/")[0].cast("double") < F.split("v", "/")[0].cast("double"), F.col("u")).otherwise(F.col("v"))
    return edges.select(left.alias("a"), "length")


# --- more of each family ----------------------------------------------------------------------------------------


_APART = f"SELECT zone AS zone_1, NULL::BIGINT AS core_2, (1000000 - coalesce(side * side, 0))::DOUBLE AS area FROM ({_ZONES}) LEFT JOIN ({_CORES}) ON core = zone"


@query(_APART)
def overlay_difference(spark, sf_dir):
    return P.overlay(_zones(spark, sf_dir), _cores(spark, sf_dir), "zone", "core", "difference").select("zone_1", "core_2", F.round("area", 3).alias("area"))


@query(f"{_APART} UNION ALL SELECT zone, core, (side * side)::DOUBLE FROM ({_ZONES}) JOIN ({_CORES}) ON core = zone")
def overlay_union(spark, sf_dir):
    return P.overlay(_zones(spark, sf_dir), _cores(spark, sf_dir), "zone", "core", "union").select("zone_1", "core_2", F.round("area", 3).alias("area"))


@query("SELECT 0::BIGINT AS id, 2e7 AS area UNION ALL SELECT 4, 1e7")
def dissolve_parts(spark, sf_dir):
    return P.dissolve(_zones(spark, sf_dir).filter("zone % 10 IN (0, 1, 4)"), key="zone").select("id", F.round("area", 3).alias("area"))


@query(f"SELECT zone, coalesce(side * side, 0) / 1e6 AS share FROM ({_ZONES}) LEFT JOIN ({_CORES}) ON core = zone")
def area_share_dissolved(spark, sf_dir):
    twice = _cores(spark, sf_dir).union(_cores(spark, sf_dir))
    return P.area_share(_zones(spark, sf_dir), twice, "zone", decimals=6).select("zone", "share")


@query(f"SELECT s_suppkey, (sx + 200)::DOUBLE AS x, (sy + 200)::DOUBLE AS y FROM ({_SITES})")
def to_points(spark, sf_dir):
    g = F.col("geometry")
    return P.to_points(_sites(spark, sf_dir)).select("s_suppkey", G.px(g).alias("x"), G.py(g).alias("y"))


@query("SELECT p_partkey, round(p_size * p_size / 2.0, 3)::DOUBLE AS area FROM part WHERE p_size > 0")
def repair_bow_ties(spark, sf_dir):
    n = F.col("p_size")
    ring = F.array(G.xy(F.lit(0), F.lit(0)), G.xy(n, n), G.xy(n, F.lit(0)), G.xy(F.lit(0), n), G.xy(F.lit(0), F.lit(0)))
    out = P.repair_geometry(_t(spark, sf_dir, "part").select("p_partkey", G.polygon_of(ring).alias("geometry")), "p_partkey")
    return out.select("p_partkey", F.round(G.area(F.col("geometry")), 3).alias("area"))


@query("SELECT c_custkey, round(6378137.0 * radians(c_custkey % 360 - 180), 3) + 0.0::DOUBLE AS x, round(6378137.0 * ln(tan(pi() / 4 + radians(c_custkey % 160 - 80) / 2)), 3) + 0.0::DOUBLE AS y FROM customer")
def reproject_mercator(spark, sf_dir):
    from geoloom.functions import crs

    at = G.point(F.col("c_custkey") % 360 - 180, F.col("c_custkey") % 160 - 80)
    g = crs.reproject(at, 3857)
    return _t(spark, sf_dir, "customer").select("c_custkey", (F.round(G.px(g), 3) + 0.0).alias("x"), (F.round(G.py(g), 3) + 0.0).alias("y"))


@query("SELECT s_suppkey, concat('POINT (', (s_suppkey * 7919 % 10007)::DOUBLE, ' ', (s_suppkey * 104729 % 10009)::DOUBLE, ')') AS wkt FROM supplier")
def wkt_points(spark, sf_dir):
    text = G.wkt(G.from_wkt(G.wkt(F.col("geometry"))))
    return _place(_t(spark, sf_dir, "supplier"), "s_suppkey").select("s_suppkey", text.alias("wkt"))


@query(f"SELECT event_id FROM ({_EV}) WHERE x BETWEEN 2000 AND 4500 AND y BETWEEN 1000 AND 7000")
def region_filter(spark, sf_dir):
    from geoloom.sources.files import region_filter as keep

    region = spark.range(1).select(G.box(F.lit(2000), F.lit(1000), F.lit(4500), F.lit(7000)).alias("geometry"))
    return keep(_events(spark, sf_dir), region).select("event_id")


@query("SELECT event_id FROM events WHERE event_type = 'click' OR (event_type = 'error' AND user_id % 2 = 0)")
def tag_filter(spark, sf_dir):
    from geoloom.sources.files import tag_filter as wanted

    tags = F.create_map(F.lit("type"), F.col("event_type"), F.concat(F.lit("even"), (F.col("user_id") % 2).cast("string")), F.lit("1"))
    return _t(spark, sf_dir, "events").filter(wanted(tags, [{"type": "click"}, {"type": "error", "even0": "*"}])).select("event_id")


@query("SELECT n_nationkey, lower(regexp_replace(n_name, '[^A-Za-z0-9]', '', 'g')) AS key FROM nation")
def normalized_keys(spark, sf_dir):
    from geoloom.functions.keys import normalize_key

    return _t(spark, sf_dir, "nation").select("n_nationkey", normalize_key(F.concat(F.lit("-"), "n_name", F.lit(". "))).alias("key"))


@query("SELECT p_partkey, greatest(p_size, p_size * 2 % 37)::DOUBLE AS v FROM part")
def highest_voltage(spark, sf_dir):
    text = F.concat_ws(";", F.col("p_size").cast("string"), F.lit("no"), (F.col("p_size") * 2 % 37).cast("string"))
    return _t(spark, sf_dir, "part").select("p_partkey", N.voltage(text).alias("v"))


@query(f"SELECT count(*) AS rows, min(x)::DOUBLE AS xmin, min(y)::DOUBLE AS ymin, max(x)::DOUBLE AS xmax, max(y)::DOUBLE AS ymax, min(value) AS value_min, max(value) AS value_max, round(avg(value), 6) AS value_mean FROM ({_EV})")
def layer_summary(spark, sf_dir):
    from geoloom.outputs.writers import summary

    return summary(_events(spark, sf_dir), ["value"]).withColumn("value_mean", F.round("value_mean", 6)).drop("kinds")


@query(f"SELECT z.zone, round(avg(c.nir), 9) AS mean_value FROM {_ZONAL}")
def zonal_mean(spark, sf_dir):
    return R.zonal_stats(_zones(spark, sf_dir), _cells(spark, sf_dir), _GRID, "zone", "nir", "mean", 9).select("zone", F.round("mean_value", 9).alias("mean_value"))


@query(f"SELECT z.zone, round(avg((c.nir = 13)::INT), 9)::DOUBLE AS share_value FROM {_ZONAL}")
def zonal_share(spark, sf_dir):
    return R.zonal_stats(_zones(spark, sf_dir), _cells(spark, sf_dir), _GRID, "zone", "nir", "share", 9, class_value=13.0).drop("geometry")


@query(f"SELECT row // 7 AS row, col // 9 AS col, round(avg(nir), 9) AS nir FROM ({_CELLS}) GROUP BY 1, 2")
def raster_block_mean(spark, sf_dir):
    out = R.block_aggregate(_cells(spark, sf_dir), "nir", 7, 9, "mean")
    return out.withColumn("nir", F.round("nir", 9))


@query(f"SELECT row // 2 AS row, col // 2 AS col, round(avg(red), 6) AS red FROM ({_CELLS}) WHERE row < 200 AND col < 200 GROUP BY 1, 2")
def raster_warp_area(spark, sf_dir):
    out = R.warp_area(_cells(spark, sf_dir), "red", _GRID, R.Grid(0.0, 10050.0, 100.0, 100, 100))
    return out.withColumn("red", F.round("red", 6))


@query(f"""SELECT a.row, a.col, round((a.red + b.red + c.red + d.red) / 4, 6) AS red FROM ({_CELLS}) a JOIN ({_CELLS}) b ON b.row = a.row AND b.col = a.col + 1
JOIN ({_CELLS}) c ON c.row = a.row + 1 AND c.col = a.col JOIN ({_CELLS}) d ON d.row = a.row + 1 AND d.col = a.col + 1""")
def raster_warp_bilinear(spark, sf_dir):
    out = R.warp(_cells(spark, sf_dir), "red", _GRID, R.Grid(25.0, 10025.0, 50.0, 200, 201), F.col("x"), F.col("y"), "bilinear")
    return out.withColumn("red", F.round("red", 6))


@query(f"SELECT row, col, 1.0::DOUBLE AS value FROM ({_CELLS}) WHERE (col + 0.5) * 50 <= 10000 AND 10050 - (row + 0.5) * 50 <= 10000 AND CAST(floor((col + 0.5) * 50 / 1000) + 10 * floor((10050 - (row + 0.5) * 50) / 1000) AS BIGINT) % 4 = 0")
def rasterize_zones(spark, sf_dir):
    return R.rasterize(_zones(spark, sf_dir).filter("zone % 4 = 0"), _GRID, ["zone"]).filter("value IS NOT NULL")


@query("""SELECT CAST(least(a, b) AS BIGINT) AS u, CAST(greatest(a, b) AS BIGINT) AS v, round(min(d), 6) AS length, count(*) AS parallel_edges FROM (
SELECT s_nationkey AS a, s_suppkey * 5 % 25 AS b, sqrt(power(s_nationkey * 7919 % 10007 - s_suppkey * 5 % 25 * 7919 % 10007, 2) + power(s_nationkey * 104729 % 10009 - s_suppkey * 5 % 25 * 104729 % 10009, 2)) AS d FROM supplier
) WHERE a <> b GROUP BY 1, 2""")
def build_network(spark, sf_dir):
    nodes = _places(spark, sf_dir)
    end = lambda n: nodes.select(F.col("id").alias(n), F.struct((F.col("x") + 1).alias("x"), "y").alias(f"p{n}"))
    lines = _links(spark, sf_dir).filter("a <> b").join(end("a"), "a").join(end("b"), "b").select(G.line(F.col("pa"), F.col("pb")).alias("geometry"))
    edges = N.build_network(lines, nodes.withColumn("geometry", G.point(F.col("x"), F.col("y"))), 5.0)[1]
    return edges.withColumn("length", F.round("length", 6))


@query(f"""WITH RECURSIVE e AS (SELECT u, v, min(length) AS w FROM (SELECT u, v, length FROM ({_LINKS}) WHERE u <> v UNION ALL SELECT v, u, length FROM ({_LINKS}) WHERE u <> v) GROUP BY 1, 2),
r(n, d) USING KEY (n) AS (SELECT n::BIGINT, CAST(0 AS DOUBLE) FROM (VALUES (0), (7)) t(n) UNION
  SELECT e.v, min(r.d + e.w) FROM r JOIN e ON e.u = r.n LEFT JOIN recurring.r k ON k.n = e.v WHERE k.d IS NULL OR r.d + e.w < k.d GROUP BY 1)
SELECT n_nationkey::BIGINT AS id, d AS network_distance FROM nation LEFT JOIN r ON r.n = n_nationkey""")
def shortest_path(spark, sf_dir):
    nodes, edges = N.edge_list_network(_places(spark, sf_dir), _links(spark, sf_dir), "id", "a", "b", "km", 1000.0)
    origins = nodes.select("id", G.point(F.col("x") + 1, F.col("y")).alias("geometry"))
    return N.shortest_path(nodes, edges, origins, origins.filter("id IN (0, 7)"), "id", 5.0).select("id", "network_distance")


@query(f"""SELECT CAST(u AS BIGINT) AS node_u, CAST(v AS BIGINT) AS node_v, round(sqrt(power(u * 7919 % 10007 - v * 7919 % 10007, 2) + power(u * 104729 % 10009 - v * 104729 % 10009, 2)), 6) AS straight
FROM (SELECT DISTINCT u, v FROM ({_LINKS}) WHERE u <> v)""")
def graph_to_vector(spark, sf_dir):
    nodes, edges = N.edge_list_network(_places(spark, sf_dir), _links(spark, sf_dir), "id", "a", "b", "km", 1000.0)
    return N.graph_to_vector(nodes, edges).select("node_u", "node_v", F.round(G.length(F.col("geometry")), 6).alias("straight"))


@query()
def isochrone(spark, sf_dir):
    nodes, edges = N.edge_list_network(_places(spark, sf_dir), _links(spark, sf_dir), "id", "a", "b", "km", 1000.0)
    near = N.reached(nodes, edges, nodes.filter("id = 0").select("id", G.point(F.col("x"), F.col("y")).alias("geometry")), "id", 1.0, 20000.0)
    return P.isochrone(near, edges, [5000, 20000]).select("limit_m", F.round("area", 1).alias("area"))


@query("""SELECT (user_id % 50) AS row, (user_id // 50) AS col, arg_min(value, (event_id)) AS value FROM events WHERE event_type <> 'error' GROUP BY 1, 2""")
def mosaic_first(spark, sf_dir):
    from geoloom.sources.web import mosaic_first as first

    cells = _t(spark, sf_dir, "events").select((F.col("user_id") % 50).alias("row"), F.floor(F.col("user_id") / 50).alias("col"), "event_id", "value", "event_type")
    return first(cells, "event_id", ["value"], F.col("event_type") != "error")


@query("SELECT event_id, ts, value FROM events WHERE CAST(ts AS DATE) = (SELECT CAST(ts AS DATE) FROM events GROUP BY 1 ORDER BY sum(value) DESC, 1 DESC LIMIT 1)")
def best_day(spark, sf_dir):
    from geoloom.sources.web import best_date

    e = _t(spark, sf_dir, "events").select("event_id", "ts", "value", F.to_date("ts").alias("date"))
    scenes = e.withColumns({"covered": F.col("value") / 1e9, "cloud": F.lit(0.0)})
    return best_date(scenes).select("event_id", "ts", "value")
