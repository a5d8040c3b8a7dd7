"""Windows over event time, for batches and streams alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LATE = "10 minutes"


def event_time(events: DataFrame, column: str = "ts", late: str = LATE) -> DataFrame:
    """Events with ``column`` as a timestamp and, on a stream, a watermark: later rows than ``late`` are dropped."""
    timed = events.withColumn(column, F.col(column).cast("timestamp"))
    return timed.withWatermark(column, late) if timed.isStreaming else timed


def _bounds(rows: DataFrame, keys: list[str]) -> DataFrame:
    ends = [F.col(f"window.{e}").cast("timestamp_ntz").alias(f"window_{e}") for e in ("start", "end")]
    return rows.select(*ends, *(c for c in rows.columns if c != "window"))


def tumbling(events: DataFrame, size: str, keys: list[str], column: str = "ts", **aggregates: Column) -> DataFrame:
    """Aggregates for each window of ``size`` and key."""
    rows = event_time(events, column).groupBy(F.window(column, size), *keys).agg(*(a.alias(n) for n, a in aggregates.items()))
    return _bounds(rows, keys)


def sliding(events: DataFrame, size: str, step: str, keys: list[str], column: str = "ts", **aggregates: Column) -> DataFrame:
    """Aggregates for each window of ``size`` that begins each ``step``."""
    rows = event_time(events, column).groupBy(F.window(column, size, step), *keys).agg(*(a.alias(n) for n, a in aggregates.items()))
    return _bounds(rows, keys)


def sessions(events: DataFrame, gap: str, keys: list[str], column: str = "ts", **aggregates: Column) -> DataFrame:
    """Aggregates for each session of a key: events with less than ``gap`` between them."""
    rows = event_time(events, column).groupBy(F.session_window(column, gap).alias("window"), *keys).agg(*(a.alias(n) for n, a in aggregates.items()))
    return _bounds(rows, keys)


def first_events(events: DataFrame, keys: list[str], column: str = "ts") -> DataFrame:
    """One event a key: on a stream the first to come within the watermark, in a batch the first by time."""
    if events.isStreaming:
        return event_time(events, column).dropDuplicatesWithinWatermark(keys)
    picked = events.groupBy(*keys).agg(F.min_by(F.struct(*(c for c in events.columns if c not in keys)), F.struct(column, *(c for c in events.columns if c not in (*keys, column)))).alias("e"))
    return picked.select(*keys, "e.*").select(*events.columns)
