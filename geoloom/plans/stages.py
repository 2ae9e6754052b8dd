"""Cutting lineage for iterative jobs, and connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F


#: What the innermost scratch() block of this thread (or context) has written.
_WRITTEN: ContextVar[list[str] | None] = ContextVar("written", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir. Where it is unset, a folder of this
    machine serves, but only if all tasks run here; on a cluster each machine would read only what it wrote itself.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (found or f"{tempfile.gettempdir()}/geoloom-shared").rstrip("/")


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder through Hadoop's file system, so that it works in any store."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df, written as Parquet in the shared folder and read again, and its path; survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    if (record := _WRITTEN.get()) is not None:
        record.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def materialize(df: DataFrame, name: str) -> DataFrame:
    return written(df, name)[0]


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """What written stages leave in the shared folder within the block is recorded and deleted at its end; other threads'
    stages and those of an inner block are not this block's.

    Results that are still lazy read these files, so write or collect them inside the block.
    """
    record: list[str] = []
    outer = _WRITTEN.set(record)
    try:
        yield record
    finally:
        _WRITTEN.reset(outer)
        for path in record:
            drop_path(spark, path)
        record.clear()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for the nodes of edges (a, b), of any type with an order; root is the smallest node that is reachable.

    Rounds of contraction: every node points to its smallest neighbour if that is smaller, pointers are followed to their
    ends by doubling, and the edges are drawn again between the ends, without loops and repeats. A component's smallest
    node always points to itself, so it is the last one left. Edges, not nodes, are few after a round or two; nothing is
    collected, and all state is written between steps.
    """
    low, high = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    left = materialize(edges.filter("a <> b").select(low, high).distinct(), "edges")
    rounds = []
    while not left.isEmpty():
        near = left.union(left.select(F.col("b").alias("a"), F.col("a").alias("b"))).groupBy("a").agg(F.min("b").alias("m"))
        ends = materialize(near.select(F.col("a").alias("node"), F.least("a", "m").alias("root")), "pointers")
        while True:
            # Roots that are no ends yet: few, and none where all pointers of a component already meet in one node.
            step = ends.filter("node <> root").select(F.col("node").alias("root"), F.col("root").alias("next"))
            step = materialize(step.join(ends.select("root").distinct(), "root"), "steps")
            if step.isEmpty():
                break
            ends = materialize(ends.join(step, "root", "left").select("node", F.coalesce("next", "root").alias("root")), "pointers")
        rounds.append(ends)
        of = lambda n, r: ends.select(F.col("node").alias(n), F.col("root").alias(r))  # noqa: E731, B023
        drawn = left.join(of("a", "ra"), "a").join(of("b", "rb"), "b").filter("ra <> rb")
        left = materialize(drawn.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "edges")
    if not rounds:
        return left.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = rounds[0]
    for ends in rounds[1:]:
        out = out.join(ends.select(F.col("node").alias("root"), F.col("root").alias("next")), "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    return materialize(out, "components")


def numbered(df: DataFrame, by: str, name: str) -> DataFrame:
    """df with each row's place in the order of by (unique), from 0, as long: ranges are numbered for themselves, then shifted
    by the sizes of the ranges before them, one row a range."""
    ranged = materialize(df.repartitionByRange(by).withColumn("__range", F.spark_partition_id()), "ranges")
    before = ranged.groupBy("__range").agg(F.count("*").alias("__n"))
    before = before.select("__range", (F.sum("__n").over(Window.orderBy("__range")) - F.col("__n")).alias("__before"))
    place = F.row_number().over(Window.partitionBy("__range").orderBy(by)) - 1 + F.col("__before")
    return ranged.join(F.broadcast(before), "__range").withColumn(name, place.cast("long")).drop("__range", "__before")
