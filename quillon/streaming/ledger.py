"""Streaming forms of the ledgers: first/last seen per key and event-time windows (an extension; batch forms are in operators)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def observations(events: DataFrame, key: str, at: str, delay: str = "1 day", every: str = "1 day") -> DataFrame:
    """Count, first and last observation of each key in tumbling windows; late rows beyond ``delay`` are left to the batch form."""
    rows = events.withWatermark(at, delay) if events.isStreaming else events
    return rows.groupBy(F.window(at, every), F.col(key)).agg(F.count(F.lit(1)).alias("n"), F.min(at).alias("first_seen"), F.max(at).alias("last_seen"))


def sessions(events: DataFrame, key: str, at: str, gap: str = "30 minutes", delay: str = "1 day") -> DataFrame:
    """Sessions of each key closed by a gap."""
    rows = events.withWatermark(at, delay) if events.isStreaming else events
    return rows.groupBy(F.session_window(at, gap), F.col(key)).agg(F.count(F.lit(1)).alias("n"))


def on_new_generation(pointer: DataFrame, action, checkpoint: str):
    """Run ``action(generation)`` once for each pointer row that arrives."""

    def each(batch: DataFrame, _: int) -> None:
        for (generation,) in batch.select("generation").distinct().collect():  # pointer rows: a handful
            action(generation)

    return pointer.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
