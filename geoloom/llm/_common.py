"""Helpers that the training-data operators share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from geoloom.plans.stages import drop_path, materialize, scratch, shared_dir  # noqa: F401

#: A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Stands for a null doc_id where documents are ordered: after every other.
NO_ID = 2**63 - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_id(col: str = "doc_id") -> Column:
    return F.coalesce(F.col(col).cast("long"), F.lit(NO_ID))


def wider(df: DataFrame, *more: tuple[str, str]) -> StructType:
    """The schema of df with further (name, type) columns."""
    out = StructType(list(df.schema.fields))
    for name, kind in more:
        out.add(name, StructType.fromDDL(f"x {kind}")[0].dataType)
    return out


#: Rows of texts that a worker looks at together.
TEXT_ROWS = 512


def slices(batches: Iterator[pa.RecordBatch], rows: int = TEXT_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in slices of few rows, since texts are long. How much a batch holds the session says, in bytes
    (spark.sql.execution.arrow.maxBytesPerBatch, 64 MB if not set otherwise).
    """
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)
