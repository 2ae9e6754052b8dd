"""Hexagon counts over a stream of points, by event time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.operators.spatial import hex_of


def windowed_hexbin(events: DataFrame, time: str, x: str, y: str, cell_km: float, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(start, q, r, count) of each window and cell; rows later than the watermark are dropped, as streams must."""
    rows = events.withWatermark(time, late).filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    cells = rows.select(time, hex_of(F.col(x), F.col(y), cell_km * 1000).alias("h"))
    counts = cells.groupBy(F.window(time, window).alias("w"), "h.q", "h.r").agg(F.count("*").alias("count"))
    return counts.select(F.col("w.start").alias("start"), "q", "r", "count")
