"""Event-time operators that run on tables and on streams alike."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.sinks import upsert


def _timed(events: DataFrame, late: str | None) -> DataFrame:
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if late else events


def windowed_counts(events: DataFrame, size: str, slide: str | None = None, late: str | None = None) -> DataFrame:
    """Counts and sums of (ts, event_type, value) in tumbling or sliding windows."""
    rows = _timed(events, late)
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    out = rows.groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return out.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    """Sessions of each user: start, end of the last event's gap, events."""
    rows = _timed(events, late)
    out = rows.groupBy(F.session_window("ts", gap).alias("s"), "user_id").agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "n")


def deduplicated(events: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys) if events.isStreaming else events.dropDuplicates(keys)


def merging(read: Callable[[], DataFrame | None], write: Callable[[DataFrame], None], keys: list[str]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that upserts each micro-batch into the table behind read and write."""

    def merge(batch: DataFrame, _: int) -> None:
        new = batch.dropDuplicates(keys)
        old = read()
        write(new if old is None else upsert(old, new, keys))

    return merge
