"""Streams of progress events: sessions with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.islands import GAP_SECONDS


def session_stream(events: DataFrame, key: str = "project", t: str = "t", gap_seconds: int = GAP_SECONDS, late: str = "10 minutes") -> DataFrame:
    """key, start, end, n_events of closed sessions (append). Events later than the watermark are left out; t must be a timestamp."""
    d = events.withColumn(t, F.col(t).cast("timestamp")).withWatermark(t, late)
    g = d.groupBy(key, F.session_window(t, f"{gap_seconds} seconds").alias("_w")).agg(F.min(t).alias("start"), F.max(t).alias("end"), F.count("*").alias("n_events"))
    return g.select(key, "start", "end", "n_events")
