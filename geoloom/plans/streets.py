"""Queries on a network that grows with the tables: customers stand on a grid of 100 m, 100 in a row, and an order of
customer k is a street to customer k + 1 or k + 100, 50 to 150 m long. Customers without orders leave gaps.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from geoloom.functions import geometry as G
from geoloom.operators import network as N
from geoloom.plans.queries import _t, query


def _streets(spark, sf_dir):
    """(nodes, edges)."""
    c = _t(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("id"))
    c = c.select("id", (F.col("id") % 100 * 100.0).alias("x"), (F.floor(F.col("id") / 100) * 100.0).alias("y"))
    k = F.col("o_custkey").cast("long")
    o = _t(spark, sf_dir, "orders").select(k.alias("a"), (k + F.when(F.col("o_orderkey") % 2 == 0, 1).otherwise(100)).alias("b"), (50.0 + F.col("o_orderkey") % 101).alias("m"))
    return N.edge_list_network(c, o, "id", "a", "b", "m", 1.0, unknown_nodes="drop")


def _customers(nodes, where):
    return nodes.filter(where).select("id", G.point(F.col("x"), F.col("y")).alias("geometry"))


_ARCS = """streets AS MATERIALIZED (SELECT u, v, min(w) AS w FROM (SELECT o_custkey AS u, o_custkey + CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 100 END AS v, 50.0::DOUBLE + o_orderkey % 101 AS w FROM orders)
  WHERE u IN (SELECT c_custkey FROM customer) AND v IN (SELECT c_custkey FROM customer) GROUP BY 1, 2),
arcs AS MATERIALIZED (SELECT u, v, w FROM streets UNION ALL SELECT v, u, w FROM streets)"""


def _from(sources: str, limit: str = "true") -> str:
    """r(s, n, d, hops): least distances, and of these the fewest hops, from sources (s, n); no hop limit."""
    return f"""r(s, n, d, hops) USING KEY (s, n) AS (SELECT s, n, 0.0::DOUBLE, 0 FROM ({sources}) UNION
  SELECT s, n, b.d, b.hops FROM (SELECT r.s, a.v AS n, min({{'d': r.d + a.w, 'hops': r.hops + 1}}) AS b FROM r JOIN arcs a ON a.u = r.n WHERE {limit} GROUP BY 1, 2) c
  LEFT JOIN recurring.r k USING (s, n) WHERE k.d IS NULL OR c.b < {{'d': k.d, 'hops': k.hops}})"""


@query(f"""WITH RECURSIVE {_ARCS}, {_from("SELECT c_custkey AS s, c_custkey AS n FROM customer WHERE c_custkey % 100 = 1", "r.d + a.w <= 1500")}
SELECT s::BIGINT AS source, n::BIGINT AS node, d FROM r""")
def street_reach(spark, sf_dir):
    """All customers within 1500 m along the streets of every hundredth one."""
    nodes, edges = _streets(spark, sf_dir)
    sources = nodes.filter("id % 100 = 1").select(F.col("id").alias("source"), F.col("id").alias("node"))
    return N.distances(edges, sources, limit=1500.0, nodes=nodes)


@query(f"""WITH RECURSIVE {_ARCS}, {_from("SELECT 0 AS s, c_custkey AS n FROM customer WHERE c_custkey % 97 = 5 AND c_custkey IN (SELECT u FROM arcs)")}
SELECT c_custkey::BIGINT AS id, d AS network_distance FROM customer LEFT JOIN r ON n = c_custkey""")
def street_nearest(spark, sf_dir):
    """How far every customer is from the nearest of some, along the streets."""
    nodes, edges = _streets(spark, sf_dir)
    return N.shortest_path(nodes, edges, _customers(nodes, "true"), _customers(nodes, "id % 97 = 5"), "id", 1.0).select("id", "network_distance")


@query(f"""WITH RECURSIVE {_ARCS}, {_from("SELECT c_custkey AS s, c_custkey AS n FROM customer WHERE c_custkey % 150 = 2")}
SELECT o.c_custkey::BIGINT AS origin, r.d AS length_m, (r.hops + 1)::BIGINT AS n_nodes, hops > 0 AS is_line
FROM customer o JOIN customer g ON g.c_custkey = o.c_custkey + 304 LEFT JOIN r ON r.s = o.c_custkey AND r.n = g.c_custkey WHERE o.c_custkey % 150 = 2""")
def street_routes(spark, sf_dir):
    """Routes over three rows of the grid: their lengths and how many nodes they pass (of equally short ones the fewest)."""
    nodes, edges = _streets(spark, sf_dir)
    origins = _customers(nodes, "id % 150 = 2")
    goals = _customers(nodes, "(id - 304) % 150 = 2 AND id > 304").withColumn("id", F.col("id") - 304)
    out = N.route(nodes, edges, origins, goals, "id", 1.0, snap_to="any_node")
    return out.select("origin", "length_m", F.size("path").cast("long").alias("n_nodes"), (G.length(F.col("geometry")) > 0).alias("is_line"))
