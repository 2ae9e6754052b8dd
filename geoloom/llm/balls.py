"""Ball k-means on vectors of whole numbers, with the results of the plain rounds.

A cluster is a ball: its centroid and a radius that reaches all its members. Another cluster is its neighbour if half the
way to that cluster's centroid lies within the radius; all others can't be nearer to any member. A member within half the
way to the nearest neighbour is in the stable core and stays. The rest lies in annuli: beyond half the way to m
neighbours, it is compared with these m only. Equal distances go to the smaller number, so a member exactly half way is
compared too. All this is arithmetic on whole numbers, without rounding.

A round assigns all vectors, written as they are with their cluster; from these, sums and counts of each cluster are made
in tasks and added up, and the new centroids and radii (k rows) go to the driver and on to the next round. The radius
around a new centroid is the old one and how far the centroid moved, which reaches all members without another pass. The
written rounds before the last are deleted.

Defined results: vectors that are null, of another dimension, or with null, non-finite or too large components take no
part (LIMIT: beyond it a squared distance doesn't fit a long), nor do they start a centroid. Rows without an id come last
in the order of starts. Repeated rows each count. With fewer vectors than k there are as many centroids as vectors; without any the
result is empty. An inertia that doesn't fit a long is null. Columns other than vec_id and embedding play no role.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.llm._common import drop_path, slices
from geoloom.plans.stages import written

K, ROUNDS, DIMENSIONS, SCALE = 16, 3, 64, 64
#: Largest absolute component after scaling.
LIMIT = 2**27


def whole_vectors(rows: DataFrame, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): the vectors that take part, each component x as floor(scale * x)."""
    e = F.col("embedding").cast("array<double>")
    fits = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) <= F.lit(LIMIT / scale)))
    rows = rows.filter((F.size("embedding") == dimensions) & F.coalesce(fits, F.lit(False)))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(e, lambda x: F.floor(x * scale).cast("int")).alias("v"))


def starts(vectors: DataFrame, k: int = K, salt: str = "1") -> np.ndarray:
    """The k vectors whose ids have the smallest hashes, in order of these (ties: the smaller vector)."""
    order = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")), 256)
    found = vectors.select(order.alias("h"), "v").orderBy(F.asc_nulls_last("h"), "v").limit(k).collect()
    return np.array([r.v for r in found], np.int64)


@dataclass
class Balls:
    """Centroids (k, dimensions) and for each the others that may be nearer to a member, nearest first, with the squares
    of their distances.
    """

    centroids: np.ndarray
    neighbours: list[np.ndarray]
    squares: list[np.ndarray]

    @classmethod
    def of(cls, centroids: np.ndarray, radii: np.ndarray) -> Balls:
        """radii may be infinite."""
        near, squares = [], []
        for i, c in enumerate(centroids):
            apart = ((centroids - c) ** 2).sum(1)
            order = np.lexsort((np.arange(len(apart)), apart))
            # The radius is a double; a hair more makes up for its rounding.
            order = order[(order != i) & (np.sqrt(apart[order].astype(np.float64)) <= 2 * radii[i] * (1 + 1e-9) + 1e-6)]
            near.append(order)
            squares.append(apart[order])
        return cls(centroids, near, squares)

    def assign(self, x: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cluster, squared distance) of the vectors x, which are members of own."""
        cluster, best = own.copy(), ((x - self.centroids[own]) ** 2).sum(1)
        for i in np.unique(own).tolist():
            members = np.flatnonzero(own == i)
            # Annuli: the neighbours that are within twice a member's distance, as many as their order says.
            reach = np.searchsorted(self.squares[i], 4 * best[members], side="right")
            for m, j in enumerate(self.neighbours[i][: int(reach.max(initial=0))].tolist()):
                here = members[reach > m]
                d = ((x[here] - self.centroids[j]) ** 2).sum(1)
                nearer = (d < best[here]) | ((d == best[here]) & (j < cluster[here]))
                cluster[here[nearer]], best[here[nearer]] = j, d[nearer]
        return cluster, best


def _vectors(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i4").reshape(len(column), -1).astype(np.int64)


def assigned(members: DataFrame, balls: Balls) -> DataFrame:
    """members (vec_id, v, cluster) in their nearest clusters, with distance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 8192):
            if b.num_rows:
                cluster, distance = balls.assign(_vectors(b.column("v")), b.column("cluster").to_numpy().astype(np.int64))
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), pa.array(cluster.astype(np.int32)), pa.array(distance)], ["vec_id", "v", "cluster", "distance"])

    return members.mapInArrow(run, "vec_id long, v binary, cluster int, distance long")


def moved(members: DataFrame, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The centroids of the members' clusters, floor(sum / count) in each component, and radii that reach all members."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 8192):
            if b.num_rows:
                x, of, distance = _vectors(b.column("v")), b.column("cluster").to_numpy(), b.column("distance").to_numpy()
                for i in np.unique(of):
                    own = of == i
                    yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([own.sum()]), pa.array([x[own].sum(0).tolist()], pa.list_(pa.int64())), pa.array([distance[own].max()])], ["cluster", "n", "sums", "far"])

    parts = members.select("v", "cluster", "distance").mapInArrow(run, "cluster int, n long, sums array<long>, far long")
    sums = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[j]) for j in range(centroids.shape[1])]).alias("sums"), F.max("far").alias("far"))
    new, radii = centroids.copy(), np.zeros(len(centroids))
    for r in sums.collect():  # a row for each cluster
        new[r.cluster] = [s // r.n for s in r.sums]
        radii[r.cluster] = np.sqrt(float(r.far)) + np.sqrt(float(((new[r.cluster] - centroids[r.cluster]) ** 2).sum()))
    return new, radii


def packed(vectors: DataFrame) -> DataFrame:
    """vectors with v as the bytes of its numbers, all members of cluster 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 8192):
            v = b.column("v")
            x = v.flatten().to_numpy().astype("<i4").reshape(len(v), -1)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array([r.tobytes() for r in x], pa.binary()), pa.array(np.zeros(len(x), np.int32))], ["vec_id", "v", "cluster"])

    return vectors.mapInArrow(run, "vec_id long, v binary, cluster int")


def ball_kmeans(rows: DataFrame, k: int = K, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE, salt: str = "1") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of the vectors of rows (vec_id, embedding)."""
    spark, vectors = rows.sparkSession, whole_vectors(rows, dimensions, scale)
    centroids = starts(vectors, k, salt)
    if not len(centroids):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    members, path = packed(vectors), None
    radii = np.full(len(centroids), np.inf)  # at first all vectors are in cluster 0, however far
    for turn in range(rounds + 1):
        was, (members, path) = path, written(assigned(members, Balls.of(centroids, radii)), "members")
        if was:
            drop_path(spark, was)
        if turn < rounds:
            centroids, radii = moved(members, centroids)
    own = {r[0]: int(r[1]) for r in members.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)"))).collect()}  # a row for each cluster
    fits = lambda n: n if n < 2**63 else None
    facts = [(i, fits(own[i]), fits(sum(own.values())), hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids.tolist()) if i in own]
    of = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return members.join(F.broadcast(of), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _round(n: int) -> str:
    """The nearest centroids of round n, and the centroids that follow from them."""
    return f"""
a{n} AS MATERIALIZED (SELECT row, vec_id, v, min(t).k AS k, min(t).d AS d FROM (
  SELECT row, vec_id, v, {{'d': list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT, 'k': k}} AS t FROM kept, c{n}) GROUP BY row, vec_id, v),
m{n} AS (SELECT k, i, sum(x) AS s, count(*) AS n FROM (SELECT k, unnest(v) AS x, unnest(range({DIMENSIONS})) AS i FROM a{n}) GROUP BY k, i),
c{n + 1} AS MATERIALIZED (SELECT k, coalesce(w, c) AS c FROM c{n} LEFT JOIN (SELECT k, list(((s - ((s % n) + n) % n) / n)::BIGINT ORDER BY i) AS w FROM m{n} GROUP BY k) USING (k))"""


#: The plain rounds over all centroids; their results are those of the balls.
ORACLE_SQL = f"""WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIMENSIONS}),
c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY h, v) - 1)::INTEGER AS k, v AS c FROM (SELECT sha256('1:' || vec_id) AS h, v FROM kept ORDER BY h, v LIMIT {K})),
{",".join(map(_round, range(ROUNDS)))},{_round(ROUNDS).split("m3 AS")[0].rstrip().rstrip(",")}
SELECT vec_id, k AS cluster, d AS distance, sum(d) OVER (PARTITION BY k)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{ROUNDS} JOIN c{ROUNDS} USING (k)"""
