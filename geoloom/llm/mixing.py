"""Mixing sources to target weights by subset-sum budget fitting.

A document's size is its number of words. Sources, by code point with null last, weigh 1, 2, 3, 1, 2, 3, ... and share
all words by weight; no target exceeds EPOCHS times its source's size, and the excess goes to the others by weight
until none is above. A source whose target is r whole passes and a rest takes every document r times and fits the rest
exactly if it can: documents are counted by exact length, most of the rest is filled in proportion, what then remains
is a bounded-knapsack problem over the length counts, solved by dynamic programming, and of each length the documents
with the smallest seeded hashes are taken.

Only counts by (source, length) are gathered, never documents. Which documents of a length are taken is decided by
hash ranges: counts of BUCKETS hash ranges settle all but one range, and only that one is ranked, so a length that a
third of all rows have is never sorted in one task.

Defined results: a null or wordless text has size 0 and is taken with 0 words; a source of empty documents has target
0; a text of any length counts whole; an empty table gives no rows. Repeated rows are documents of their own. Reruns agree, however the files are laid
out: of the documents of one length the hashes of id and text decide, and rows that agree in both are interchangeable.
The list of sources is ordered in one task: sources are taken to be some thousands at most.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from geoloom.llm._common import WORD, materialize

WEIGHTS = (1, 2, 3)
EPOCHS = 3
BUCKETS = 1024
SEED = 20240229
#: Words that the dynamic programme fits at least (and as many as the longest document, if that is longer).
FIT = 16_384


def targets(per_source: DataFrame) -> DataFrame:
    """per_source (source, source_size), a row each, with weight and target."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.row_number().over(by_name) - 1) % len(WEIGHTS) + 1).cast("double")
    rows = per_source.withColumn("weight", weight).withColumn("most", F.lit(float(EPOCHS)) * F.col("source_size"))
    # In order of most / weight the sources that reach their limit come first.
    line = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before, whole = line.rowsBetween(Window.unboundedPreceding, -1), line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(whole) - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    weights = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    rows = rows.withColumn("level", left / weights)  # the share of a unit of weight if this source and later ones stay below
    rows = rows.withColumn("full", F.col("most") < F.col("level") * F.col("weight"))
    level = F.min(F.when(~F.col("full"), F.struct(F.col("most") / F.col("weight"), F.col("source").isNull(), "source", "level"))).over(whole)["level"]
    return rows.withColumn("target", F.when(F.col("full"), F.col("most")).otherwise(level * F.col("weight"))).select("source", "source_size", "weight", "target")


def fit(sizes: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each size make up the budget, or as much of it as the sizes allow."""
    order = np.argsort(-sizes)
    sizes, counts = sizes[order].astype(np.int64), counts[order].astype(np.int64)
    total = int((sizes * counts).sum())
    take = np.zeros(len(sizes), np.int64)
    if budget <= 0 or total == 0:
        return take[np.argsort(order)]
    if budget >= total:
        return counts[np.argsort(order)]
    # In proportion, down to a rest that the dynamic programme can fit exactly from all lengths.
    keep = max(FIT, int(sizes[0]))
    bulk = max(0, budget - keep)
    take = np.array([int(c) * bulk // total for c in counts], np.int64)
    rest = budget - int((take * sizes).sum())
    for i in np.flatnonzero(take < counts):  # longest first, one of each at most
        if 0 < sizes[i] <= rest - keep:
            take[i] += 1
            rest -= int(sizes[i])
    free = counts - take
    items = []
    for i in np.flatnonzero((free > 0) & (sizes > 0) & (sizes <= rest)):
        left, step = min(int(free[i]), rest // int(sizes[i])), 1
        while left > 0:
            items.append((int(sizes[i]) * min(step, left), i, min(step, left)))
            left -= step
            step *= 2
    reach, whole, by = 1, (1 << rest + 1) - 1, np.full(rest + 1, -1, np.int64)
    for k, (words, _, _) in enumerate(items):
        new = reach << words & whole & ~reach
        if new:
            bits = np.unpackbits(np.frombuffer(new.to_bytes(rest // 8 + 1, "little"), np.uint8), bitorder="little")
            by[np.flatnonzero(bits)] = k
            reach |= new
            if reach >> rest & 1:
                break
    at = reach.bit_length() - 1
    while at:  # the item that first reached a sum stands on sums that earlier items reached
        words, i, n = items[by[at]]
        take[i] += n
        at -= words
    return take[np.argsort(order)]


def _fit_source(rows: pd.DataFrame) -> pd.DataFrame:
    """The lengths of one source: size, n, passes and more (of which one more is taken)."""
    target, total = float(rows.target.iloc[0]), int(rows.source_size.iloc[0])
    budget = min(int(round(target)), EPOCHS * total)
    passes = budget // total if total else 0
    more = fit(rows["size"].to_numpy(), rows.n.to_numpy(), budget - passes * total)
    return pd.DataFrame({"source": rows.source, "size": rows["size"], "passes": passes, "more": more})


def decide(rows: DataFrame) -> DataFrame:
    """rows (rid, doc_id, th, source, size, written somewhere) with source_size, target and times; th is a text's hash."""
    rows = rows.withColumn("h", F.xxhash64(F.lit(SEED), F.col("doc_id"), F.col("th")))
    rows = rows.withColumn("bucket", F.pmod(F.shiftrightunsigned("h", 20), F.lit(BUCKETS)).cast("int"))
    counts = materialize(rows.groupBy("source", "size", "bucket").agg(F.count("*").alias("n")), "mix-counts")
    per_source = materialize(targets(counts.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))), "mix-targets")
    lengths = counts.groupBy("source", "size").agg(F.sum("n").alias("n"))
    same = lambda a, b, *names: [a[n].eqNullSafe(b[n]) for n in names]
    lengths = lengths.join(per_source.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    fitted = lengths.groupBy("source").applyInPandas(_fit_source, "source string, size long, passes long, more long")
    before = Window.partitionBy("source", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    ranges = counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    ranges = ranges.join(fitted, same(ranges, fitted, "source", "size")).select(ranges.source, ranges["size"], "bucket", "n", "before", "passes", "more")
    ranges = ranges.join(per_source, same(ranges, per_source, "source")).select(ranges["*"], "source_size", "target")
    ranges = materialize(ranges, "mix-ranges")
    met = rows.join(ranges, same(rows, ranges, "source", "size", "bucket")).select(rows["*"], "n", "before", "passes", "more", "source_size", "target")
    settled = (F.col("before") + F.col("n") <= F.col("more")) | (F.col("before") >= F.col("more"))
    extra = F.when(F.col("before") < F.col("more"), 1).otherwise(0)
    out = [*rows.columns[: rows.columns.index("h")], "source_size", "target"]
    sure = met.filter(settled).select(*out, (F.col("passes") + extra).alias("times"))
    rank = F.row_number().over(Window.partitionBy("source", "size", "bucket").orderBy("h", "doc_id", "th", "rid"))
    cut = met.filter(~settled).withColumn("rank", rank)
    ranked = cut.select(*out, (F.col("passes") + F.when(F.col("before") + F.col("rank") <= F.col("more"), 1).otherwise(0)).alias("times"))
    return sure.union(ranked)


def _size(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def mixture(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken, times) for each row of docs (doc_id, source, text)."""
    rows = docs.select(docs.doc_id.cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), docs.source.cast("string").alias("source"), _size("text").alias("size"))
    rows = materialize(rows.select(F.monotonically_increasing_id().alias("rid"), "*"), "mix-rows")
    taken = (F.col("times") * F.col("size")).alias("taken")
    return decide(rows).select("doc_id", "size", "source_size", "target", taken, "times")


def mix(docs: DataFrame) -> DataFrame:
    """The mixed corpus: each row of docs as often as the mixture takes it; rows without words stay once."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    at = {c.lower(): n for c, n in zip(docs.columns, names, strict=True)}
    rows = docs.toDF(*names).withColumns({"rid": F.monotonically_increasing_id(), "size": _size(at["text"])})
    rows = materialize(rows, "mix-docs")
    slim = rows.select("rid", F.col(at["doc_id"]).cast("long").alias("doc_id"), F.xxhash64(at["text"]).alias("th"), F.col(at["source"]).cast("string").alias("source"), "size")
    times = decide(slim).select("rid", F.when(F.col("size") == 0, 1).otherwise(F.col("times")).cast("int").alias("times"))
    taken = rows.join(times.filter("times > 0").hint("shuffle_hash"), "rid")
    return taken.select(*names, F.explode(F.sequence(F.lit(1), F.col("times"))).alias("pass")).select(*names).toDF(*docs.columns)
