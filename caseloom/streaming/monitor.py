"""Escalations on a stream by time window, without repeated and without late requests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def first_requests(requests: DataFrame, key: str, event_time: str, delay: str) -> DataFrame:
    """A stream's requests, each ``key`` once.

    Of rows with one key that come within ``delay`` of each other by ``event_time`` only the first is
    kept. State is held for as long and no longer. Rows later than the watermark are dropped; those
    without a key or a time are, too, since no state could ever be freed for them.
    """
    usable = requests.where(F.col(key).isNotNull() & F.col(event_time).isNotNull())
    return usable.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([key])


def escalation_windows(decided: DataFrame, event_time: str, window: str, slide: str | None = None) -> DataFrame:
    """``window_start, window_end, rule_id, requests, escalated`` of decided requests (escalate, rule_id).

    A request without a rule counts under ``NONE``. On a stream a window is passed on once the
    watermark has passed its end, and is final then.
    """
    period = F.window(event_time, window, slide) if slide else F.window(event_time, window)
    return (
        decided.groupBy(period.alias("_window"), F.coalesce("rule_id", F.lit("NONE")).alias("rule_id"))
        .agg(F.count("*").alias("requests"), F.count_if("escalate").alias("escalated"))
        .select(F.col("_window.start").alias("window_start"), F.col("_window.end").alias("window_end"), "rule_id", "requests", "escalated")
    )


def start_monitor(counts: DataFrame, path: str, checkpoint_path: str, **trigger: object) -> StreamingQuery:
    """Append the finished windows to ``path``; the sink's log keeps a batch that runs again from counting twice."""
    writer = counts.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint_path)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
