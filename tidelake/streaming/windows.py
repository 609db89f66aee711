"""Event-time aggregation with watermarks, over streams or batches of events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tumbling(events: DataFrame, ts: str, width: str, keys: list[str], aggregates: list[Column], lateness: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Windows of a width (sliding where `slide` is given); rows later than the watermark are dropped by a stream."""
    if events.isStreaming:
        events = events.withWatermark(ts, lateness)
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    return _flat(events.groupBy(w.alias("window"), *keys).agg(*aggregates))


def sessions(events: DataFrame, ts: str, gap: str, keys: list[str], aggregates: list[Column], lateness: str = "10 minutes") -> DataFrame:
    """Runs of a key's events with no pause of `gap` or longer."""
    if events.isStreaming:
        events = events.withWatermark(ts, lateness)
    return _flat(events.groupBy(F.session_window(ts, gap).alias("window"), *keys).agg(*aggregates))


def _flat(windowed: DataFrame) -> DataFrame:
    rest = [c for c in windowed.columns if c != "window"]
    return windowed.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *rest)
