"""Streams of session events: capture into a store, sessions by silence, daily counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from memloom.operators.store import Store, event_kind, has_credentials

#: How often a micro-batch starts again after another writer.
ATTEMPTS = 20


def captured(events: DataFrame) -> DataFrame:
    """Events with their kind; texts with credentials are withheld."""
    text = F.coalesce("prompt", "tool_response", "tool_input")
    return events.select("hook_id", "session_id", event_kind(F.col("hook_event_name")).alias("kind"), "received_at", F.when(has_credentials(text), "[REDACTED]").otherwise(text).alias("text"))


def into_store(stream: DataFrame, store: Store, checkpoint: str, key: str = "hook_id", at: str = "received_at") -> StreamingQuery:
    """Upsert every micro-batch into the buckets it touches; ``availableNow`` ends when all there is has been read.

    Another writer's generation makes a batch start again from it, a bounded number of times.
    """

    def write(batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        for _ in range(ATTEMPTS):
            if store.upsert(batch, key, at):
                return
        raise RuntimeError(f"batch {number} lost to other writers {ATTEMPTS} times")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def idle_sessions(stream: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """Sessions that end by silence, with a watermark for late events."""
    window = F.session_window("received_at", gap)
    return stream.withWatermark("received_at", late).groupBy("session_id", window).agg(F.count("*").alias("events")).select("session_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "events")


def daily(events: DataFrame, at: str = "ts") -> DataFrame:
    """Events by day and type (tumbling windows)."""
    return events.groupBy(F.window(at, "1 day").alias("w"), "event_type").agg(F.count("*").alias("events"), F.round(F.sum("value"), 4).alias("value")).select(F.to_date("w.start").alias("day"), "event_type", "events", "value")
