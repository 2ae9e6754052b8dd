"""Line dedup: windows of three consecutive lines that repeat anywhere in the corpus lose their later occurrences.

Lines are what stands between line feeds; lines of white space alone are passed over (they are neither hashed nor
removed). Each three consecutive lines of a document make a window, and windows overlap. A window is repeated if the
same three lines stand earlier: in a document of smaller doc_id, or higher up in the same document. The positions that
repeated windows cover are merged, and the lines at them go. Everything is judged on the input.

DataFrame functions only. A window travels as its 128-bit hash and its position; the text is shuffled once, at the end.
The first occurrence of a window is found by an aggregation that combines before the shuffle, so a window that a third
of all documents share costs one row a task there, and the join back to it can be split by skew handling.

Defined results: a null text stays null; a text of fewer than three lines stays as it is; a text that loses all its
lines becomes what is left (perhaps the empty string). A null doc_id comes after all others. Rows that agree in doc_id
and text count as one document and get the same result. A text of any length is taken apart whole. Other columns pass through whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.llm._common import order_id

INK = r"[^\x20\x09-\x0D]"


def _inked(text: str) -> Column:
    """(i, l) of each line that has more than white space."""
    lines = F.transform(F.split(F.col(text), "\n", -1), lambda x, i: F.struct(i.alias("i"), x.alias("l")))
    return F.filter(lines, lambda x: x["l"].rlike(INK))


def _windows(docs: DataFrame) -> DataFrame:
    """(o, th, p, h1, h2): p counts a document's lines with ink from 0."""
    lines = docs.select("o", "th", _inked("text").alias("ink")).filter(F.size("ink") >= 3)
    hashes = F.transform(
        F.sequence(F.lit(0), F.size("ink") - 3),
        lambda p: F.struct(
            p.alias("p"),
            F.xxhash64(F.col("ink")[p]["l"], F.col("ink")[p + 1]["l"], F.col("ink")[p + 2]["l"]).alias("h1"),
            F.xxhash64(F.lit(1), F.col("ink")[p + 2]["l"], F.col("ink")[p + 1]["l"], F.col("ink")[p]["l"]).alias("h2"),
        ),
    )
    return lines.select("o", "th", F.explode(hashes).alias("w")).select("o", "th", "w.p", "w.h1", "w.h2")


def covered(docs: DataFrame) -> DataFrame:
    """(o, th, gone): the merged positions to remove, among a document's lines with ink; docs has o, th and text."""
    windows = _windows(docs)
    at = F.struct("o", "th", "p")
    first = windows.groupBy("h1", "h2").agg(F.min(at).alias("first"), F.max(at).alias("last")).filter("first < last").drop("last")
    later = windows.join(first, ["h1", "h2"]).filter(at > F.col("first"))
    lines = later.select("o", "th", F.explode(F.array("p", F.col("p") + 1, F.col("p") + 2)).alias("p"))
    return lines.groupBy("o", "th").agg(F.collect_set("p").alias("gone"))


def line_dedup(docs: DataFrame, *, counts: bool = False) -> DataFrame:
    """docs with the new text and, if there is such a column, n_chars set to its length.

    counts adds n_lines (lines with ink) and n_removed.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    lower = [c.lower() for c in docs.columns]
    text, doc_id = names[lower.index("text")], names[lower.index("doc_id")]
    rows = docs.toDF(*names).withColumns({"o": order_id(doc_id), "th": F.xxhash64(text)})
    gone = covered(rows.select("o", "th", F.col(text).alias("text")))
    joined = rows.join(gone.hint("shuffle_hash"), ["o", "th"], "left")
    indexes = F.transform(F.col("gone"), lambda p: F.col("ink")[p]["i"])
    lines = F.split(F.col(text), "\n", -1)
    stay = F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), indexes), lambda i: lines[i])
    touched = joined.withColumn("ink", F.when(F.col("gone").isNotNull(), _inked(text)))
    new = F.when(F.col("gone").isNull(), F.col(text)).otherwise(F.array_join(stay, "\n"))
    out = touched.withColumn("new", new)
    columns = []
    for name, old in zip(names, docs.columns, strict=True):
        if name == text:
            columns.append(F.col("new").alias(old))
        elif old.lower() == "n_chars":
            kind = docs.schema[old].dataType
            columns.append(F.when(F.col("gone").isNull(), F.col(name)).otherwise(F.length("new").cast(kind)).alias(old))
        else:
            columns.append(F.col(name).alias(old))
    if counts:
        n = F.when(F.col(text).isNull(), 0).otherwise(F.size(_inked(text)))
        columns += [n.cast("long").alias("n_lines"), F.coalesce(F.array_size("gone"), F.lit(0)).cast("long").alias("n_removed")]
    return out.select(*columns)


#: The same by comparing whole lines instead of hashes.
ORACLE_SQL = r"""
WITH cut AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents
), ink AS (
  SELECT doc_id, i, lines[i] AS l, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS p
  FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM cut)
  WHERE regexp_matches(lines[i], '[^\x20\x09-\x0D]')
), win AS (
  SELECT a.doc_id, a.p, a.l || chr(10) || b.l || chr(10) || c.l AS w
  FROM ink a JOIN ink b ON b.doc_id = a.doc_id AND b.p = a.p + 1 JOIN ink c ON c.doc_id = a.doc_id AND c.p = a.p + 2
), late AS (
  SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY w ORDER BY doc_id, p) AS k FROM win) WHERE k > 1
), gone AS (
  SELECT DISTINCT doc_id, p + d AS p FROM late, (VALUES (0), (1), (2)) AS v(d)
), gone_i AS (
  SELECT ink.doc_id, list(ink.i) AS gone FROM gone JOIN ink ON ink.doc_id = gone.doc_id AND ink.p = gone.p GROUP BY ink.doc_id
)
SELECT c.doc_id,
       CASE WHEN g.gone IS NULL THEN c.text
            ELSE array_to_string(list_transform(list_filter(range(1, len(c.lines) + 1), lambda i: NOT list_contains(g.gone, i)), lambda i: c.lines[i]), chr(10)) END AS text,
       CAST((SELECT count(*) FROM ink WHERE ink.doc_id = c.doc_id) AS BIGINT) AS n_lines,
       CAST(coalesce(len(g.gone), 0) AS BIGINT) AS n_removed
FROM cut c LEFT JOIN gone_i g ON g.doc_id = c.doc_id
"""
