"""Streaming forms of the summaries: the same aggregations over event-time windows with a watermark."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from batchloom.operators.summaries import STATISTICS


def windowed_means(events: DataFrame, ts: str, var: str, stats: Sequence[str], by: Sequence[str] = (), every: str = "10 minutes", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Statistics of a variable in tumbling (or, with ``slide``, sliding) windows; rows later than ``late`` are dropped on a stream. Works on a batch frame too."""
    window = F.window(ts, every, slide) if slide else F.window(ts, every)
    aggs: list[Column] = [STATISTICS[s.upper()](F.col(var)).alias(s.lower()) for s in stats]
    out = events.withWatermark(ts, late).groupBy(window.alias("w"), *by).agg(*aggs, F.count("*").alias("_FREQ_"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, *[s.lower() for s in stats], "_FREQ_")


def sessions(events: DataFrame, ts: str, by: Sequence[str], gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of each key that end after a gap without events."""
    out = events.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), *by).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n")
