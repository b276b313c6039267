"""Flat histograms of a stream: counts by (group, bin) add up over batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilstat.operators.histograms import Bins


def stream_histogram(events: DataFrame, x: str, bins: Bins, time: str, every: str, late: str, by: list[str]) -> DataFrame:
    """(window, by..., bin, ct) per time window of a streaming (or static) frame; rows later than `late` are dropped by the watermark."""
    inside = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).filter((F.col(x) >= bins.low) & (F.col(x) < bins.high))
    return inside.groupBy(F.window(time, every), *by, bins.number(F.col(x)).alias("bin")).agg(F.count("*").alias("ct"))
