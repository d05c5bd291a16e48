"""Event-time windows and daily quotas, the same expressions in batch and in streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def as_event_time(events: DataFrame, ts: str = "ts") -> DataFrame:
    """Zone-less times as UTC instants, which watermarks need."""
    return events.withColumn(ts, F.col(ts).cast("timestamp"))


def windowed(events: DataFrame, size: str, slide: str | None = None, late: str | None = None, ts: str = "ts", keys: tuple[str, ...] = ("event_type",), value: str = "value") -> DataFrame:
    """Counts and sums by tumbling or sliding windows; ``late`` sets a watermark for streams."""
    rows = as_event_time(events, ts)
    if late:
        rows = rows.withWatermark(ts, late)
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    out = rows.groupBy(w.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n", "total")


def sessions(events: DataFrame, gap: str, key: str = "user_id", late: str | None = None, ts: str = "ts") -> DataFrame:
    """Runs of a key's events with no longer pause than the gap."""
    rows = as_event_time(events, ts)
    if late:
        rows = rows.withWatermark(ts, late)
    out = rows.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return out.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def daily_usage(events: DataFrame, late: str | None = None, ts: str = "ts", key: str = "workspace_id", amount: str = "pages") -> DataFrame:
    """Usage by key and UTC day."""
    return windowed(events, "1 day", None, late, ts, (key,), amount).select(key, F.to_date("start").alias("day"), F.col("total").alias(amount))
