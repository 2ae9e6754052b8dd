"""Substring dedup with a log-structured index of window fingerprints.

A window is 20 consecutive words. Every word goes that lies in a window whose words also start earlier: in an earlier
document, or earlier in the same one. Windows are judged on the input.

Fingerprints. A window's fingerprint is the smallest hash of its 8-word pieces. Equal windows have equal fingerprints,
and neighbours mostly share theirs, so a stretch of windows with one fingerprint is stored as one row: the fingerprint
f, a hash g of all the stretch's words, and its place.

Index. Each batch of documents becomes two immutable tables: a run in buckets of f, sorted by f, and the packed texts
in buckets of their keys. A new batch's run is merge-joined with the runs of earlier batches by f, without moving them.
A stretch whose (f, g) stands earlier is covered whole. Where an f has stretches of different words, the first stretch
of each kind is verified window by window by 128-bit hashes of the words; only the documents of such stretches are taken
from the packed texts, whose buckets stay where they are. When there are more than FANOUT runs, compact() merges them
into one that keeps the first place of each (f, g). A manifest names the tables, so that an index can be opened again.

A document's key is its doc_id and 94 bits of its text: a 64-bit hash, and 30 bits of another that lie in every place.

Skew. Stretches that repeat among some thousand documents are settled there and do not enter the groups by f; rows that
repeat as a whole are indexed once, combined before the shuffle; the windows that are verified are counted with
map-side aggregation and joined back under skew handling.

Defined results: a null text has no words; a text under 20 words keeps all; documents of an earlier batch count as
earlier, within a batch a smaller doc_id does, and a null doc_id comes last. Rows that agree in doc_id and text count
as one document and get the same result; different texts with one doc_id, or without one, are documents of their own.
Texts may have up to 2**29 words. Other columns pass through, whatever they are called.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from geoloom.llm._common import drop_path, materialize, order_id, shared_dir, wider

WINDOW = 20
PIECE = 8
#: Runs that may stand side by side, and batches that a table is taken in as.
FANOUT, BATCHES = 2, 4
C_BITS, N_BITS = 30, 4  # a place is start << 34 | c << 4 | windows; with k, c tells apart texts with one doc_id
#: Stretches that are compared with each other before they leave a task.
SETTLED = 300_000
KEY = ["o", "k", "c"]

_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)]


def _word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def _rolling(hashes: np.ndarray, n: int, width: int, factor: np.uint64) -> np.ndarray:
    """A hash of the ``width`` words from each of the first n starts."""
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out *= factor
        out += hashes[k : n + k]
    out ^= out >> np.uint64(29)
    out *= _MIX[1]
    return out ^ (out >> np.uint64(32))


def _spans(words: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The words joined by blanks, and where each begins and ends."""
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    return b" ".join(words), np.r_[0, ends[:-1] + 1], ends


def stretches(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """f, g, first window and number of windows of each stretch of the text."""
    words = text.split()
    n = len(words) - WINDOW + 1
    if n < 1:
        return (np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64))
    pieces = _rolling(_word_hashes(words), len(words) - PIECE + 1, PIECE, _MIX[0])
    at = np.arange(n) + np.lib.stride_tricks.sliding_window_view(pieces, WINDOW - PIECE + 1).argmin(1)
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    count = np.diff(np.r_[first, n])
    line, begins, ends = _spans(words)
    h = xxhash.xxh3_64_intdigest
    g = np.array([h(line[a:b]) for a, b in zip(begins[first].tolist(), ends[first + count + WINDOW - 2].tolist(), strict=True)], np.uint64)
    return pieces[at[first]], g, first, count


def _runs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a run from (o, k, c, z). dup marks merged stretches that came earlier in this task; g counts their windows."""
    unzip = zstandard.ZstdDecompressor()
    kept: list[tuple[np.ndarray, ...]] = []
    for b in batches:
        for at in range(0, b.num_rows, 256):
            part = b.slice(at, 256)
            found = [stretches(unzip.decompress(z.as_py()) if z.is_valid else b"") for z in part.column("z")]
            sizes = [len(x[0]) for x in found]
            f, g = (np.concatenate([x[i] for x in found]).view(np.int64) for i in (0, 1))
            first, count = (np.concatenate([x[i] for x in found]) for i in (2, 3))
            o, k, c = (np.repeat(part.column(n).to_numpy(), sizes) for n in KEY)
            kept.append((f, g, o, k, first << C_BITS + N_BITS | c << N_BITS | count))
            if sum(len(x[0]) for x in kept) >= SETTLED:
                yield _settled(kept)
                kept = []
    if kept:
        yield _settled(kept)


def _settled(kept: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    f, g, o, k, place = (np.concatenate(x) for x in zip(*kept, strict=True))
    first, count, c = place >> C_BITS + N_BITS, place & (1 << N_BITS) - 1, place & ((1 << C_BITS) - 1 << N_BITS)
    order = np.lexsort((place, k, o, g, f))
    again = np.zeros(len(f), bool)
    again[order[1:]] = (f[order[1:]] == f[order[:-1]]) & (g[order[1:]] == g[order[:-1]])
    late, stays = np.flatnonzero(again), np.flatnonzero(~again)
    # Neighbouring late stretches make one row.
    joins = np.zeros(len(late), bool)
    same = (o[late[1:]] == o[late[:-1]]) & (k[late[1:]] == k[late[:-1]]) & (c[late[1:]] == c[late[:-1]])
    joins[1:] = (late[1:] == late[:-1] + 1) & same & (first[late[1:]] == first[late[:-1]] + count[late[:-1]])
    heads = np.flatnonzero(~joins)
    n = np.add.reduceat(count[late], heads) if len(late) else np.empty(0, np.int64)
    head = late[heads]
    spread = (_MIX[2] * ((o[head] ^ k[head]).astype(np.uint64) ^ (first[head].astype(np.uint64) << np.uint64(20)))).view(np.int64)
    columns = [np.concatenate(x) for x in ((f[stays], spread), (g[stays], n), (o[stays], o[head]), (k[stays], k[head]), (place[stays], place[head]), (np.zeros(len(stays), bool), np.ones(len(head), bool)))]
    return pa.RecordBatch.from_arrays(list(map(pa.array, columns)), ["f", "g", "o", "k", "place", "dup"])


def _windows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(w1, w2, o, k, place) of the windows at ``places`` in packed texts."""
    unzip, h = zstandard.ZstdDecompressor(), xxhash.xxh3_128_digest
    for whole in batches:
        for at in range(0, whole.num_rows, 256):
            b, found, held = whole.slice(at, 256), [], 0
            for own, k, z, places in zip(*(b.column(x) for x in ("o", "k", "z", "places")), strict=True):
                p = places.values.to_numpy()
                line, begins, ends = _spans(unzip.decompress(z.as_py()).split())
                n, start = p & (1 << N_BITS) - 1, p >> C_BITS + N_BITS
                starts = np.unique(np.repeat(start, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
                words = zip(begins[starts].tolist(), ends[starts + WINDOW - 1].tolist(), strict=True)
                w = np.frombuffer(b"".join([h(line[x:y]) for x, y in words]), "<i8").reshape(-1, 2)
                place = starts << C_BITS + N_BITS | int(p[0] & ((1 << C_BITS) - 1 << N_BITS)) | 1
                found.append((w[:, 0], w[:, 1], np.full(len(starts), own.as_py()), np.full(len(starts), k.as_py()), place))
                held += len(starts)
                if held > SETTLED:
                    yield _joined(found)
                    found, held = [], 0
            if found:
                yield _joined(found)


def _joined(found: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], ["w1", "w2", "o", "k", "place"])


def _pack(text: str, schema: StructType):  # noqa: ANN202
    """Texts as compressed bytes; a null text stays null in the rows, and is empty in the index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zip_ = zstandard.ZstdCompressor(level=3)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                z = pa.array([None if (s := t.as_py()) is None else zip_.compress(s.encode("utf-8", "surrogatepass")) for t in b.column(text)], pa.binary())
                yield pa.RecordBatch.from_arrays([z if n == text else c for n, c in zip(b.schema.names, b.columns, strict=True)], b.schema.names)

    return run, StructType([f if f.name != text else StructType().add(text, "binary")[0] for f in schema])


def kept_words(text: bytes, ranges: np.ndarray) -> tuple[list[bytes], list[bytes]]:
    """All words, and those outside the ranges (first word, number of windows)."""
    words = text.split()
    if not len(ranges):
        return words, words
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, ranges[:, 0], 1)
    np.add.at(edges, ranges[:, 0] + ranges[:, 1] + WINDOW - 1, -1)
    stay = np.cumsum(edges)[:-1] == 0
    return words, [w for w, k in zip(words, stay.tolist(), strict=True) if k]


def _c_of(place: str) -> Column:
    return F.shiftright(place, N_BITS).bitwiseAND(F.lit((1 << C_BITS) - 1))


def _text_key(text: str) -> dict[str, Column]:
    """k and c: 94 bits of a text; a null text counts as empty."""
    whole = F.coalesce(F.col(text), F.lit(""))
    return {"k": F.xxhash64(whole), "c": F.crc32(whole).bitwiseAND(F.lit((1 << C_BITS) - 1))}


def _ranked(run: DataFrame) -> DataFrame:
    """Rows (f, g, o, k, place) of a run with late (whether a row of its f and g is earlier) and the range of its f's g.

    Runs lie in buckets of f, so the windows need no shuffle, and all three share one order, so rows are sorted once.
    """
    inside = Window.partitionBy("f").orderBy("g", "o", "k", "place")
    whole = inside.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = run.filter("NOT dup").select("f", "g", "o", "k", "place", F.lag("g").over(inside).alias("was"), F.min("g").over(whole).alias("low"), F.max("g").over(whole).alias("high"))
    return rows.withColumn("late", F.coalesce(F.col("was") == F.col("g"), F.lit(False))).drop("was")


class FingerprintIndex:
    """Runs of window fingerprints and the packed texts, in one folder that all executors see.

    With the path of an earlier index that index is opened again. Use it in a with statement, or call close(), so that
    no table stays in the session's catalogue; the files stay if keep is set.
    """

    RUN, TEXTS = "f LONG, g LONG, o LONG, k LONG, place LONG, dup BOOLEAN", "o LONG, k LONG, c LONG, z BINARY"

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None, *, keep: bool = False) -> None:
        self.spark, self.keep = spark, keep
        self.path = path or f"{shared_dir(spark)}/fingerprints-{uuid.uuid4().hex}"
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.runs: list[str] = []
        self.texts: list[str] = []
        self.version = 0
        if path and (rows := self._manifest()):
            self.version, self.buckets = rows[0].version, rows[0].buckets
            for kind, names in (("run", self.runs), ("texts", self.texts)):
                names += [r.name for r in rows if r.kind == kind]
                columns, by = (self.RUN, "f") if kind == "run" else (self.TEXTS, "o, k, c")
                for n in names:
                    spark.sql(f"CREATE TABLE IF NOT EXISTS {n} ({columns}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{n}'")

    def __enter__(self) -> FingerprintIndex:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    def _manifest(self) -> list:
        try:
            rows = self.spark.read.parquet(f"{self.path}/manifest-*")
        except AnalysisException:  # a new index
            return []
        last = rows.agg(F.max("version").alias("version"))
        return rows.join(last, "version").orderBy("at").collect()  # a row for each table

    def _commit(self) -> None:
        """Name the tables of this version; what an earlier one named stays until it is no longer named."""
        self.version += 1
        rows = [(self.version, i, kind, n, self.buckets) for i, (kind, n) in enumerate([*(("run", n) for n in self.runs), *(("texts", n) for n in self.texts)])]
        made = self.spark.createDataFrame(rows, "version int, at int, kind string, name string, buckets int").coalesce(1)
        made.write.parquet(f"{self.path}/manifest-{self.version:08d}")

    def _write(self, rows: DataFrame, *by: str) -> str:
        name = f"fingerprints_{uuid.uuid4().hex}"
        parts = rows.repartition(self.buckets, *by)
        try:
            parts.write.bucketBy(self.buckets, *by).sortBy(*by).option("path", f"{self.path}/{name}").option("compression", "zstd").format("parquet").saveAsTable(name)
        except Exception:
            self._drop([name])
            raise
        return name

    def compact(self) -> None:
        """Merge the runs into one."""
        if len(self.runs) < 2:
            return
        old, rows = self.runs, _ranked(reduce(DataFrame.union, [self.spark.table(r) for r in self.runs]))
        self.runs = [self._write(rows.filter("NOT late").select("f", "g", "o", "k", "place", F.lit(False).alias("dup")), "f")]
        self._commit()
        self._drop(old)

    def _drop(self, names: list[str]) -> None:
        for n in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {n}")
            drop_path(self.spark, f"{self.path}/{n}")

    def close(self) -> None:
        if not self.keep:
            self._drop([*self.runs, *self.texts])
            drop_path(self.spark, self.path)
        for n in [*self.runs, *self.texts]:
            self.spark.sql(f"DROP TABLE IF EXISTS {n}")
        self.runs, self.texts = [], []

    def ingest(self, docs: DataFrame) -> DataFrame:
        """(o, k, c, ranges): what to remove from the batch's documents (o, k, c, text), which then belong to the index.

        ranges are (first word, number of windows); documents that keep all are left out.
        """
        history, older = self.runs, self.texts
        pack, schema = _pack("text", docs.select(*KEY, "text").schema)
        packed = docs.select(*KEY, "text").mapInArrow(pack, schema).groupBy(*KEY).agg(F.first("text").alias("z"))
        texts = self._write(packed, *KEY)
        run = self._write(self.spark.table(texts).mapInArrow(_runs_of, "f long, g long, o long, k long, place long, dup boolean"), "f")
        table = self.spark.table(run)
        rows = _ranked(table)
        if history:
            before = _ranked(reduce(DataFrame.union, [self.spark.table(r) for r in history])).filter("NOT late")
            kinds = before.select("f", "g", F.lit(True).alias("old"))
            spans = before.filter("g = low").select("f", F.col("low").alias("low2"), F.col("high").alias("high2"))
            rows = rows.join(kinds, ["f", "g"], "left").join(spans, "f", "left")
            rows = rows.withColumn("old", F.coalesce("old", F.lit(False))).withColumns({"low": F.least("low", "low2"), "high": F.greatest("high", "high2")})
        else:
            rows = rows.withColumn("old", F.lit(False))
        # A stretch is covered whole if its kind is in the history, or earlier in the batch. Where a fingerprint has
        # different words, the first stretch of each kind is compared window by window.
        late, mixed = F.col("late") | F.col("old"), F.col("low") < F.col("high")
        judged = materialize(rows.filter(late | mixed).select("o", "k", "place", late.alias("late")), "judged")
        windows = self._windows([texts], judged.filter("NOT late"), 1)
        if history:
            own = table.filter("NOT dup").groupBy("f").agg(F.min("g").alias("low2"), F.max("g").alias("high2"))
            asked = before.join(own, "f").filter(F.least("low", "low2") < F.greatest("high", "high2")).select("o", "k", "place")
            windows = windows.union(self._windows(older, asked, 0))
        windows = materialize(windows, "windows")
        at = F.struct("age", "o", "k", "place")  # what an earlier batch has is earlier, whatever its doc_id
        first = windows.groupBy("w1", "w2").agg(F.min(at).alias("first"), F.max(at).alias("last")).filter("first < last").drop("last")
        found = windows.join(first, ["w1", "w2"]).filter((F.col("age") == 1) & (at > F.col("first"))).select("o", "k", "place", F.lit(1).cast("long").alias("n"))
        whole = judged.filter("late").select("o", "k", "place", F.col("place").bitwiseAND(F.lit((1 << N_BITS) - 1)).alias("n"))
        inside = table.filter("dup").select("o", "k", "place", F.col("g").alias("n"))
        gone = whole.union(inside).union(found)
        gone = gone.select("o", "k", _c_of("place").alias("c"), F.struct(F.shiftright("place", C_BITS + N_BITS).alias("at"), "n").alias("r"))
        out = materialize(gone.groupBy(*KEY).agg(F.collect_list("r").alias("ranges")), "ranges")
        self.runs, self.texts = [*history, run], [*older, texts]
        self._commit()
        if len(self.runs) > FANOUT:
            self.compact()
        return out

    def _windows(self, tables: list[str], shown: DataFrame, age: int) -> DataFrame:
        """(w1, w2, age, o, k, place) of the windows in the stretches (o, k, place) of the texts in the tables."""
        asked = shown.groupBy("o", "k", _c_of("place").alias("c")).agg(F.collect_set("place").alias("places"))
        met = [self.spark.table(t).join(asked.hint("shuffle_hash"), KEY).select("o", "k", "z", "places").mapInArrow(_windows_of, "w1 long, w2 long, o long, k long, place long") for t in tables]
        return reduce(DataFrame.union, met).select("w1", "w2", F.lit(age).alias("age"), "o", "k", "place")


def substring_dedup(docs: DataFrame, batches: int = BATCHES, index: FingerprintIndex | None = None) -> DataFrame:
    """docs with kept (the words that stay, joined by blanks), n_words and n_removed in place of such columns.

    The table is taken in as ``batches`` batches by doc_id; with an index, after what the index holds already.
    """
    spark = docs.sparkSession
    drop = {"kept", "n_words", "n_removed"}
    keep = [c for c in docs.columns if c.lower() not in drop]
    names = [f"c{i}" for i in range(len(keep))]
    at = {c.lower(): n for c, n in zip(keep, names, strict=True)}
    text = at["text"]
    rows = docs.select(*keep).toDF(*names).withColumns({"o": order_id(at["doc_id"]), **_text_key(text)})
    cuts = docs.filter("doc_id IS NOT NULL").approxQuantile("doc_id", [k / batches for k in range(1, batches)], 0.01) if batches > 1 else []
    own = index or FingerprintIndex(spark)
    ranges, low = [], None
    try:
        for cut in [*sorted({int(c) for c in cuts}), None]:
            part = rows if low is None else rows.filter(F.col("o") > low)
            part = part if cut is None else part.filter(F.col("o") <= cut)
            ranges.append(own.ingest(part.select(*KEY, F.col(text).alias("text"))))
            low = cut
    finally:
        if index is None:
            own.close()
    found = reduce(DataFrame.union, ranges)
    run, schema = _pack(text, rows.schema)
    met = rows.mapInArrow(run, schema).join(found.hint("shuffle_hash"), KEY, "left").select(*names, "ranges")

    def clean(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unzip = zstandard.ZstdDecompressor()
        for whole in parts:
            for start in range(0, whole.num_rows, 256):
                b = whole.slice(start, 256)
                texts, kept, n, gone = [], [], [], []
                for z, r in zip(b.column(text), b.column("ranges"), strict=True):
                    data = unzip.decompress(z.as_py()) if z.is_valid else b""
                    pairs = np.stack([r.values.field(0).to_numpy(), r.values.field(1).to_numpy()], 1) if r.is_valid else np.empty((0, 2), np.int64)
                    words, left = kept_words(data, pairs)
                    texts.append(data.decode("utf-8", "surrogatepass") if z.is_valid else None)
                    kept.append(b" ".join(left).decode("utf-8", "surrogatepass"))
                    n.append(len(words))
                    gone.append(len(words) - len(left))
                columns = [pa.array(texts, pa.string()) if c == text else b.column(c) for c in names]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(kept, pa.string()), pa.array(n, pa.int64()), pa.array(gone, pa.int64())], [*names, "kept", "n_words", "n_removed"])

    out = met.mapInArrow(clean, wider(rows.select(*names), ("kept", "string"), ("n_words", "long"), ("n_removed", "long")))
    return out.toDF(*keep, "kept", "n_words", "n_removed")


def digests(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of each row."""
    out = substring_dedup(docs.select("doc_id", "text"), batches)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
