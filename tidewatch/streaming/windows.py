"""Streaming forms of the segment and window operators (an extension: the model has no streams)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def gap_sessions(stream: DataFrame, time: str, label: str, gap: str = "15 minutes", late: str = "1 hour") -> DataFrame:
    """Gap-free segments of each label: start, end and rows; late rows are taken for ``late``."""
    out = stream.withWatermark(time, late).groupBy(F.session_window(time, gap), label).agg(F.count(F.lit(1)).alias("n"))
    return out.select(label, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def sliding_stats(stream: DataFrame, time: str, label: str, value: str, width: str = "7 days", slide: str = "1 day", late: str = "1 day") -> DataFrame:
    """Mean and deviation in sliding windows of each label."""
    out = stream.withWatermark(time, late).groupBy(F.window(time, width, slide), label).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))
    return out.select(label, F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n", "mean", "std")
