"""Nearest neighbours with score-aware (anisotropic) product quantisation, four-bit table scans and exact reranking.

Vectors are taken relative to the nearest of a few coarse centroids m, as a length r and a direction u. Directions are cut
into pairs of dimensions, each coded by one of 16 centroids (4 bits). The loss of a code is the squared error plus
(eta - 1) times the squared error parallel to the direction, since that part moves the scores of the queries that matter;
codes are chosen by coordinate descent over the pairs, and centroids solve the weighted normal equations. So a code's error
is relative to how far a vector is from its centroid, wherever the vectors lie and however uneven their lengths are.

The squared distance of q from m + r u is |q - m|^2 + r^2 + 2 r m.u - 2 r q.u. The last product comes from byte tables (two
4-bit codes at once), one set of tables for each query; the other terms are doubles of the row or of query and centroid.

Queries and codes meet in tiles of a block of each; no candidate's doubles go there, only its packed codes, these terms, a
hash of the vector and its id. A tile names the RERANK best of each query. Of all tiles' names the RERANK best of each
query remain, and only for these the vectors are joined and the true distances computed. Equal vectors of a tile are scored
once and stand for their k + 1 smallest ids, so copies neither hide other neighbours nor meet pairwise. Every query scans
every code: no candidate is skipped for being in another part of the space. With rerank as large as the table the search is
exact.

The codebook is fitted on a bounded sample (TRAIN_FLOATS numbers at most, the rows with the smallest hashes); every row
is indexed. Defined results: vectors that are null, zero, of another dimension than most, or with null or non-finite
components take no part, nor do rows without an id. Rows with the query's id count as the query's own; of different
vectors with a query's id one, the smallest as bytes, is the query. With fewer than k candidates all are
returned; without a query the result is empty. Other columns, whatever their names, play no role.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from geoloom.llm._common import materialize, slices

#: Numbers of the training sample, and rows at most.
TRAIN_FLOATS, TRAIN_ROWS = 2_000_000, 20_000
RERANK = 256
#: Candidates and queries of a tile, about: 80 bytes each for 64 dimensions (codes and terms), and 512 (doubles).
BLOCK, QUERY_BLOCK = 131_072, 4096
THRESHOLD = 0.2
ROUNDS = 8
#: Coarse centroids, rows of the sample for each at least, and rounds that fit them.
COARSE, COARSE_ROWS, COARSE_ROUNDS = 64, 40, 6


class Quantizer:
    """Centroids (pairs, 16, 2) of directions and the weight of parallel errors."""

    def __init__(self, centroids: np.ndarray, eta: float) -> None:
        self.centroids, self.eta = centroids, eta

    @staticmethod
    def cut(x: np.ndarray) -> np.ndarray:
        """(rows, pairs, 2), with a zero for an odd dimension, and an even number of pairs."""
        d = x.shape[1] + -x.shape[1] % 4
        return np.pad(x, ((0, 0), (0, d - x.shape[1]))).reshape(len(x), d // 2, 2)

    @classmethod
    def fit(cls, x: np.ndarray) -> Quantizer:
        """x: (rows, dimensions), at least one row."""
        eta = max(1.0, (x.shape[1] - 1) * THRESHOLD**2 / (1 - THRESHOLD**2))
        parts = cls.cut(x)
        rng = np.random.default_rng(0)
        start = rng.integers(0, len(x), (parts.shape[1], 16))
        own = cls(parts[start, np.arange(parts.shape[1])[:, None]] + rng.normal(0, 1e-4, (parts.shape[1], 16, 2)), eta)
        u = parts / np.maximum(np.linalg.norm(x, axis=1), 1e-300)[:, None, None]
        codes = None
        for _ in range(ROUNDS):
            codes = own.encode(x, codes)
            error = parts - own.centroids[np.arange(parts.shape[1]), codes]
            along = (error * u).sum(2)
            whole = along.sum(1)
            for m in range(parts.shape[1]):
                rest = whole - along[:, m]
                one = np.eye(16)[codes[:, m]]
                a = np.einsum("nk,ni,nj->kij", one, u[:, m], u[:, m]) * (eta - 1) + one.sum(0)[:, None, None] * np.eye(2)
                b = one.T @ (parts[:, m] + (eta - 1) * u[:, m] * (rest + (parts[:, m] * u[:, m]).sum(1))[:, None])
                used = one.sum(0) > 0
                own.centroids[m, used] = np.linalg.solve(a[used], b[used][:, :, None])[:, :, 0]
        return own

    def encode(self, x: np.ndarray, codes: np.ndarray | None = None, passes: int = 2) -> np.ndarray:
        """Codes (rows, pairs) by coordinate descent on the anisotropic loss."""
        parts = self.cut(x)
        u = parts / np.maximum(np.linalg.norm(x, axis=1), 1e-300)[:, None, None]
        m = np.arange(parts.shape[1])
        if codes is None:
            codes = ((parts[:, :, None, :] - self.centroids[None]) ** 2).sum(3).argmin(2)
        codes = codes.copy()
        along = ((parts - self.centroids[m, codes]) * u).sum(2)
        whole = along.sum(1)
        for _ in range(passes):
            for j in m:
                error = parts[:, j, None, :] - self.centroids[j][None]
                parallel = (error * u[:, j, None, :]).sum(2)
                rest = whole - along[:, j]
                codes[:, j] = ((error**2).sum(2) + (self.eta - 1) * (rest[:, None] + parallel) ** 2).argmin(1)
                along[:, j] = parallel[np.arange(len(x)), codes[:, j]]
                whole = rest + along[:, j]
        return codes

    def pack(self, codes: np.ndarray) -> np.ndarray:
        """Two codes in a byte."""
        return (codes[:, ::2] << 4 | codes[:, 1::2]).astype(np.uint8)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """(queries, bytes, 256): the part of q·x that each byte of a code gives."""
        t = np.einsum("nmi,mki->nmk", self.cut(q), self.centroids)
        return (t[:, ::2, :, None] + t[:, 1::2, None, :]).reshape(len(q), -1, 256)


class Index:
    """A power of two that brings components to 1 or less, coarse centroids of the scaled vectors, and the codes of directions."""

    def __init__(self, scale: float, coarse: np.ndarray, quantizer: Quantizer) -> None:
        self.scale, self.coarse, self.quantizer = scale, coarse, quantizer

    @classmethod
    def fit(cls, x: np.ndarray, scale: float) -> Index:
        """x: (rows, dimensions) of the sample, not scaled, at least one row."""
        x = x * scale
        coarse = cls.centroids(x)
        rest = x - coarse[cls.near(x, coarse)]
        length = np.linalg.norm(rest, axis=1)
        kept = rest[length > 0] / length[length > 0, None]
        return cls(scale, coarse, Quantizer.fit(kept if len(kept) else np.eye(1, x.shape[1])))

    @staticmethod
    def near(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
        out = np.empty(len(x), np.int64)
        for i in range(0, len(x), 512):
            out[i : i + 512] = ((x[i : i + 512, None] - centroids) ** 2).sum(2).argmin(1)
        return out

    @classmethod
    def centroids(cls, x: np.ndarray) -> np.ndarray:
        """Coarse centroids by a few rounds; each start is drawn with a chance by its distance from those before it."""
        rng = np.random.default_rng(0)
        out, left = [x[rng.integers(len(x))]], None
        while len(out) < max(1, min(COARSE, len(x) // COARSE_ROWS)):
            d = ((x - out[-1]) ** 2).sum(1)
            left = d if left is None else np.minimum(left, d)
            if not left.max() > 0:
                break
            out.append(x[np.searchsorted(np.cumsum(left / left.sum()), rng.random()).clip(0, len(x) - 1)])
        c = np.array(out)
        for _ in range(COARSE_ROUNDS):
            of = cls.near(x, c)
            n = np.bincount(of, minlength=len(c))
            sums = np.zeros_like(c)
            np.add.at(sums, of, x)
            c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
        return c

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(packed codes, coarse centroid, r, r^2 + 2 r m.u) of vectors that are not scaled."""
        x = x * self.scale
        of = self.near(x, self.coarse)
        rest = x - self.coarse[of]
        r = np.linalg.norm(rest, axis=1)
        codes = self.quantizer.encode(rest / np.maximum(r, 1e-300)[:, None])
        u = self.quantizer.centroids[np.arange(codes.shape[1]), codes].reshape(len(x), -1)[:, : x.shape[1]]
        return self.quantizer.pack(codes), of, r, r**2 + 2 * r * (self.coarse[of] * u).sum(1)

    def ahead(self, q: np.ndarray) -> np.ndarray:
        """(queries, centroids): |q - m|^2 of scaled queries."""
        return ((q[:, None] - self.coarse) ** 2).sum(2)


def usable(rows: DataFrame) -> DataFrame:
    """(vec_id, embedding) of the rows that take part."""
    e = F.col("embedding").cast("array<double>")
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("embedding"))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull())
    rows = rows.filter(F.coalesce(finite, F.lit(False)) & F.coalesce(F.exists("embedding", lambda x: x != 0), F.lit(False)))
    size = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.filter(F.size("embedding") == (size[0] if size else 0))


def _stack(column: pa.Array) -> np.ndarray:
    return np.stack([x.values.to_numpy() for x in column]) if len(column) else np.empty((0, 1))


def train(rows: DataFrame) -> Index | None:
    """The index of a bounded sample, its scale of all rows; None without rows."""
    one = rows.agg(F.max(F.array_max(F.transform("embedding", F.abs))), F.max(F.size("embedding"))).first()
    if one[0] is None:
        return None
    n = max(256, min(TRAIN_ROWS, TRAIN_FLOATS // one[1]))
    sample = rows.orderBy(F.xxhash64("vec_id", "embedding")).limit(n).toArrow()
    return Index.fit(_stack(sample.column("embedding").combine_chunks()), float(2.0 ** -np.frexp(one[0])[1]))


def index(rows: DataFrame, fitted: Index) -> DataFrame:
    """(vec_id, vec, codes, coarse, r, term, vh): the vector's doubles, Index.encode() of it and a hash of the vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 4096):
            x = _stack(b.column("embedding"))
            codes, of, r, term = fitted.encode(x)
            packed = [pa.array([r.tobytes() for r in m], pa.binary()) for m in (x, codes)]
            vh = np.array([xxhash.xxh3_64_intdigest(r.tobytes()) for r in x + 0.0], np.uint64).view(np.int64)  # -0.0 is 0.0
            columns = [b.column("vec_id"), *packed, pa.array(of.astype(np.int32)), pa.array(r), pa.array(term), pa.array(vh)]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "vec", "codes", "coarse", "r", "term", "vh"])

    return rows.mapInArrow(run, "vec_id long, vec binary, codes binary, coarse int, r double, term double, vh long")


def scan(rows: pd.DataFrame, query_ids: np.ndarray, q: np.ndarray, fitted: Index, k: int, rerank: int) -> pd.DataFrame:
    """The rerank best of rows (rid, vec_id, codes, coarse, r, term, vh) for each query: query_id, rid, vec_id, vh and near,
    the scaled squared distance as the codes say.
    """
    rows = rows.sort_values(["vh", "vec_id"], kind="stable", ignore_index=True)
    vh, ids, rid = (rows[c].to_numpy() for c in ("vh", "vec_id", "rid"))
    first = np.flatnonzero(np.r_[True, vh[1:] != vh[:-1]])
    last = np.minimum(np.r_[first[1:], len(rows)], first + k + 1)
    codes = np.frombuffer(b"".join(rows.codes.iloc[first]), np.uint8).reshape(len(first), -1).T.copy()
    of, r, term = (rows[c].to_numpy()[first] for c in ("coarse", "r", "term"))
    q = q * fitted.scale
    out: list[tuple] = []
    for s in range(0, len(q), 64):
        ahead = fitted.ahead(q[s : s + 64])
        for i, table in enumerate(fitted.quantizer.tables(q[s : s + 64]), s):
            along = np.zeros(len(first))
            for j, byte in enumerate(codes):
                along += table[j][byte]
            score = ahead[i - s][of] + term - 2 * r * along
            best = np.argpartition(score, rerank)[:rerank] if len(score) > rerank else np.arange(len(score))
            n = last[best] - first[best]
            at = np.repeat(first[best], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            near = np.repeat(score[best], n)
            own = ids[at] != query_ids[i]
            out.append((np.full(own.sum(), query_ids[i]), rid[at][own], ids[at][own], vh[at][own], near[own]))
    return pd.DataFrame(dict(zip(("query_id", "rid", "vec_id", "vh", "near"), (np.concatenate(c) for c in zip(*out, strict=True)), strict=True)))


def search(candidates: DataFrame, queries: DataFrame, fitted: Index, k: int = 10, rerank: int = RERANK, block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest candidates found for each query.

    Both are written tables of index() with rid, a number of its own for each row of candidates.
    """
    blocks = max(1, -(-candidates.count() // block))
    query_blocks = max(1, -(-queries.count() // query_block))
    # A block holds BLOCK rows on average. Rows are spread by their number, so copies and hot ids fill all blocks alike.
    own = F.pmod(F.xxhash64(F.lit(7), "rid"), F.lit(blocks)).cast("int")
    asks = F.pmod(F.xxhash64(F.lit(8), "vec_id"), F.lit(query_blocks)).cast("int")
    left = candidates.select(own.alias("b"), F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("qb"), "rid", "vec_id", "codes", "coarse", "r", "term", "vh")
    right = queries.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"), asks.alias("qb"), "vec_id", "vec")

    def tile(rows: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(wanted):
            return pd.DataFrame({"query_id": [], "rid": [], "vec_id": [], "vh": [], "near": []}).astype({"query_id": "int64", "rid": "int64", "vec_id": "int64", "vh": "int64"})
        q = np.frombuffer(b"".join(wanted.vec), np.float64).reshape(len(wanted), -1)
        return scan(rows, wanted.vec_id.to_numpy(), q, fitted, k, rerank)

    named = left.groupBy("b", "qb").cogroup(right.groupBy("b", "qb")).applyInPandas(tile, "query_id long, rid long, vec_id long, vh long, near double")
    # A vector has the same score in all tiles. Of its copies the k + 1 smallest ids are enough.
    by_score = Window.partitionBy("query_id").orderBy("near", "vh")
    named = named.withColumn("place", F.dense_rank().over(by_score)).filter(F.col("place") <= rerank)
    copies = Window.partitionBy("query_id", "place").orderBy("vec_id", "rid")
    named = named.withColumn("copy", F.row_number().over(copies)).filter(F.col("copy") <= k + 1).select("query_id", "rid", "vec_id")
    met = named.join(candidates.select("rid", "vec"), "rid").join(queries.select(F.col("vec_id").alias("query_id"), F.col("vec").alias("q")), "query_id")

    def true(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 4096):
            x, q = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.float64).reshape(b.num_rows, -1) for c in ("vec", "q"))
            with np.errstate(over="ignore"):
                d = np.sqrt(((x - q) ** 2).sum(1))
            wide = np.isinf(d)  # squares that no double holds
            d[wide] = np.sqrt((((x[wide] - q[wide]) * fitted.scale) ** 2).sum(1)) / fitted.scale
            yield pa.RecordBatch.from_arrays([b.column("query_id"), b.column("vec_id"), pa.array(d)], ["query_id", "vec_id", "score"])

    found = met.select("query_id", "vec_id", "vec", "q").mapInArrow(true, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def indexed(rows: DataFrame, fitted: Index) -> DataFrame:
    """index() of rows with numbers, written."""
    numbered = index(rows, fitted).select(F.monotonically_increasing_id().alias("rid"), "*")
    return materialize(numbered, "vectors")


def nearest(rows: DataFrame, every: int = 100, k: int = 10, rerank: int = RERANK) -> DataFrame:
    """The k nearest rows of each row whose vec_id is divisible by ``every``, among all others."""
    rows = usable(rows)
    fitted = train(rows)
    if fitted is None:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    table = indexed(rows, fitted)
    queries = table.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("vec").alias("vec"))
    return search(table, materialize(queries, "queries"), fitted, k, rerank)
