"""FeatureCollections in large files, cut at feature borders, so that many tasks read one file.

Where a feature begins can't be told for certain from the middle of a file. So each piece of a file guesses: an object
that begins with its type "Feature" (inside a text its quotes would be escaped), and follows the objects from there until one begins
in the next piece. If that is where the next piece guessed, and so on to the end, all guesses are right: the first piece
begins at the array itself. A file with a wrong guess (features in features, or with their type elsewhere) is read in one go, by one task.
"""

from __future__ import annotations

import codecs
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geoloom.plans.stages import materialize
from geoloom.sources.geotiff import ReadAt, read_at

PIECE = 64 << 20
BLOCK = 1 << 20
START = re.compile(rb'\{\s{0,64}"type"\s{0,64}:\s{0,64}"Feature"')
ARRAY = re.compile(r'"features"\s*:\s*\[')
#: Beyond all positions: the array has ended.
ENDED = 1 << 62


def first_start(at: ReadAt, start: int, end: int) -> int | None:
    """Where the first object that looks like a feature begins, from start and before end."""
    for b in range(start, end, BLOCK):
        found = START.search(at(b, min(BLOCK, end - b) + 256))
        if found and b + found.start() < min(b + BLOCK, end):
            return b + found.start()
    return None


def array_start(at: ReadAt, length: int) -> int:
    """Where the array of features begins, after its bracket; an error where there is none at the top."""
    size = BLOCK
    while True:
        text = at(0, size).decode("utf-8", "ignore")
        for m in ARRAY.finditer(text):
            try:
                if "features" in json.loads(text[: m.start()].lstrip("\ufeff") + '"features": 0}'):
                    return len(text[: m.end()].encode())
            except ValueError:  # this one is not at the top
                continue
        if size >= length:
            raise ValueError("the file is no FeatureCollection")
        size *= 2


def objects(at: ReadAt, start: int, end: int) -> Iterator[tuple[int, str | None]]:
    """(position, text) of the array's objects from start on that begin before end; then where the next one begins, or ENDED."""
    decoder, scan = codecs.getincrementaldecoder("utf-8")(), json.JSONDecoder()
    text, i, position, read, size = "", 0, start, start, BLOCK

    def more() -> bool:
        nonlocal text, i, read, size
        data = at(read, size)
        read, text, i, size = read + len(data), text[i:] + decoder.decode(data), 0, size * 2
        return bool(data)

    while True:
        gap = re.compile(r"[\s,]*").match(text, i).end()
        position, i = position + gap - i, gap
        if i == len(text):
            if not more():
                raise ValueError("the file ends within its features")
        elif text[i] == "]":
            yield ENDED, None
            return
        elif position >= end:
            yield position, None
            return
        else:
            try:
                _, j = scan.raw_decode(text, i)
            except ValueError:
                if not more():
                    raise
                continue
            yield position, text[i:j]
            position, i, size = position + len(text[i:j].encode()), j, BLOCK


def feature_texts(spark: SparkSession, path: str, piece: int = PIECE) -> DataFrame:
    """(value): the text of each feature in the files of path that are larger than piece."""
    files = spark.read.format("binaryFile").load(path).select("path", "length").filter(F.col("length") > piece)
    pieces = files.withColumn("start", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(piece).cast("long"))))

    def marks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for name, length, start in zip(f["path"], f["length"], f["start"], strict=True):
                at, end = read_at(name), min(start + piece, length)
                first = first_start(at, start, end) if start else array_start(at, length)
                stop = None
                if first is not None:
                    try:
                        stop = next(p for p, text in objects(at, first, end) if text is None)
                    except ValueError:  # a wrong guess, or a broken file, which the reading in one go tells
                        stop = -1
                rows.append((name, length, start, end, first, stop))
            yield pd.DataFrame(rows, columns=["path", "length", "start", "end", "first", "stop"]).astype({"first": "Int64", "stop": "Int64"})

    # A number of its own, so that adaptive execution does not put these few bytes, which stand for many, into one task.
    tasks = max(1, pieces.count())
    found = materialize(pieces.repartitionByRange(tasks, "path", "start").mapInPandas(marks, "path string, length long, start long, end long, first long, stop long"), "pieces")
    # A row for each piece of a file, not for its features.
    before = F.last("stop", ignorenulls=True).over(Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    goes_on = F.when(F.col("start") == 0, F.col("stop") >= 0).otherwise(F.when(F.col("first").isNull(), F.col("before") >= F.col("end")).otherwise((F.col("first") == F.col("before")) & (F.col("stop") >= 0)))
    judged = found.withColumn("before", before).withColumn("right", goes_on)
    judged = judged.withColumn("all_right", F.min("right").over(Window.partitionBy("path")))
    picked = judged.filter("(all_right AND first IS NOT NULL) OR (NOT all_right AND start = 0)")
    picked = picked.select("path", "first", F.when(F.col("all_right"), F.col("end")).otherwise(ENDED).alias("end"))

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for name, first, end in zip(f["path"], f["first"], f["end"], strict=True):
                batch: list[str] = []
                for _, text in objects(read_at(name), int(first), int(end)):
                    if text is not None:
                        batch.append(text)
                    if len(batch) == 1024:
                        yield pd.DataFrame({"value": batch})
                        batch = []
                yield pd.DataFrame({"value": batch})

    return picked.repartitionByRange(tasks, "path", "first").mapInPandas(read, "value string")
