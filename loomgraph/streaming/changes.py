"""Change batches on Structured Streaming: debounced sessions, and lessons kept up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sessions(events: DataFrame, gap: str = "1 day", watermark: str | None = None) -> DataFrame:
    """(user_id, start, end, n, kinds): bursts of events that no pause of ``gap`` or more interrupts.

    The same plan serves a batch and, with a watermark, a stream in append mode.
    """
    own = events.withWatermark("ts", watermark) if watermark else events
    s = own.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"), F.max("event_type").alias("last_kind"))
    return s.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "last_kind")


def maintain(stream: DataFrame, apply, checkpoint: str):
    """Starts a query that hands each micro-batch (rows, batch id) to ``apply``; replays after a failure carry the same id."""
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
