"""Language identification by rank-order n-gram profiles.

Every language has a profile: its most frequent letter n-grams (one to three letters, words padded with a blank) in
order of frequency. A document's own profile is compared to each by the out-of-place distance: the sum of how far each
of its n-grams stands from its place in the language's profile, and the full profile length for n-grams that are not in
it. The nearest language wins, and ties go to the smaller name.

Defined results: a null text, an empty one or one without a letter gives ``und`` and score 0; without training rows all
documents give ``und``. A text of any length is profiled whole. Repeated rows each get their own row. Other columns pass through unless they have the name of
an output column, which is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from geoloom.llm._common import slices, wider

#: n-grams of a profile.
PROFILE = 300
#: Training documents of a language that are read, about; they are drawn by a hash of id and text.
TRAIN_PER_LANG = 1500
BITS = 21  # of a code point


@dataclass
class Profiles:
    """langs[j] has rank[i, j] for n-gram grams[i]; grams are sorted, a missing one has the rank ``size``."""

    langs: list[str]
    grams: np.ndarray
    rank: np.ndarray
    size: int


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def ngrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the text's 1- to 3-grams and their counts; a code holds up to three code points, 21 bits each."""
    cp = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    cp = np.where(_letters()[cp], cp, 0)
    cp = np.concatenate(([0], cp, [0]))
    cp = cp[np.r_[True, (cp[1:] != 0) | (cp[:-1] != 0)]]
    alphabet, small = np.unique(cp, return_inverse=True)
    m = len(alphabet)
    if m < 2:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    one, two = small[small > 0], small[:-1] * m + small[1:]
    three = (two[:-1] * m + small[2:])[small[1:-1] > 0]
    if m <= 64:
        counts = [np.bincount(x, minlength=m**k) for k, x in ((1, one), (2, two), (3, three))]
        found = [np.flatnonzero(c) for c in counts]
        counts = [c[f] for c, f in zip(counts, found, strict=True)]
    else:
        found, counts = zip(*(np.unique(x, return_counts=True) for x in (one, two, three)), strict=True)
    wide = np.where(alphabet == 0, 32, alphabet).astype(np.int64)  # no code is 0, so codes of different lengths differ
    codes = [
        wide[found[0]],
        wide[found[1] // m] << BITS | wide[found[1] % m],
        wide[found[2] // (m * m)] << 2 * BITS | wide[found[2] // m % m] << BITS | wide[found[2] % m],
    ]
    return np.concatenate(codes), np.concatenate(counts).astype(np.int64)


def top_grams(text: str, size: int) -> np.ndarray:
    """The most frequent n-grams in order; equal counts by code."""
    codes, counts = ngrams(text)
    if len(codes) > 4 * size:  # leave out what cannot be among the first, but none that ties with the last
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        codes, counts = codes[counts >= least], counts[counts >= least]
    return codes[np.lexsort((codes, -counts))[:size]]


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, size: int = PROFILE, per_lang: int = TRAIN_PER_LANG) -> Profiles:
    """Profiles from (doc_id, text, lang) of the rows given, of which about per_lang of each language are read."""
    docs = docs.filter("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "text", "lang")
    # One row for each language: the labels of the model, which the driver holds anyway.
    n = {r[0]: r[1] for r in docs.groupBy("lang").count().collect()}
    if not n:
        return Profiles([], np.empty(0, np.int64), np.empty((0, 0), np.int32), size)
    share = F.lit(0.0)
    for lang, count in n.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, per_lang / count))).otherwise(share)
    # The text counts too, so that rows without an id, or with one id, do not enter all together.
    sample = docs.filter((F.abs(F.xxhash64("doc_id", "text") % 1_000_000) < share * 1_000_000))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 2000):
            langs = np.array(b.column("lang").to_pylist(), dtype=object)
            texts = b.column("text").to_pylist()
            for lang in sorted(set(langs)):
                parts = [ngrams(texts[i]) for i in np.flatnonzero(langs == lang)]
                codes, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
                counts = np.bincount(at, np.concatenate([p[1] for p in parts]), len(codes)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes), pa.array(counts)], ["lang", "gram", "n"])

    counts = sample.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    ranked = counts.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).filter(F.col("rank") <= size)
    rows = ranked.select("lang", "gram", F.col("rank") - 1).collect()  # size rows for each language
    langs = sorted({r[0] for r in rows})
    grams = np.array(sorted({r[1] for r in rows}), np.int64)
    rank = np.full((len(grams), len(langs)), size, np.int32)
    for lang, gram, r in rows:
        rank[np.searchsorted(grams, gram), langs.index(lang)] = r
    return Profiles(langs, grams, rank, size)


def identify(text: str | None, model: Profiles) -> tuple[str, float]:
    """The language and 1 - distance / (n-grams of the document * profile size)."""
    top = top_grams(text or "", model.size)
    if not len(top) or not model.langs:
        return "und", 0.0
    at = np.minimum(np.searchsorted(model.grams, top), max(len(model.grams) - 1, 0))
    known = model.grams[at] == top
    ranks = np.where(known[:, None], model.rank[at], model.size)
    away = np.where(ranks < model.size, np.abs(ranks - np.arange(len(top))[:, None]), model.size).sum(0)
    best = int(away.argmin())
    return model.langs[best], float(1 - away[best] / (len(top) * model.size))


def predict(docs: DataFrame, model: Profiles, text: str = "text") -> DataFrame:
    """docs with lang_pred and score; the prediction reads the text alone."""
    keep = [c for c in docs.columns if c.lower() not in ("lang_pred", "score")]
    docs = docs.select(*keep)
    schema = wider(docs, ("lang_pred", "string"), ("score", "double"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            found = [identify(t.as_py(), model) for t in b.column(text)]
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())],
                [*b.schema.names, "lang_pred", "score"],
            )

    return docs.mapInArrow(run, schema)


def identify_documents(docs: DataFrame) -> DataFrame:
    """Learn from the documents that are not held out, predict all: doc_id, held_out, lang_pred, score."""
    model = train(docs.filter(~held_out()))
    return predict(docs.select("doc_id", held_out().alias("held_out"), "text"), model).drop("text")
