"""Cached, replayed and live phases, read strategies, and the clock that data drives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivulet.operators.sequence import carried, numbered

STRATEGIES = ("COMMITED", "EARLIEST", "LATEST", "ONCE_EARLIEST", "ONCE_LATEST")


def cache_then_live(events: DataFrame, started: Column, ts: str = "ts") -> DataFrame:
    """phase, and dispatched_at: what arrived before the start is handed on at the start, in front of what comes then."""
    return events.withColumn("phase", F.when(F.col(ts) < started, "cached").otherwise("live")).withColumn("dispatched_at", F.greatest(F.col(ts), started))


def event_log(events: DataFrame, until: Column, feed: str = "feed", order: str = "event_id", ts: str = "ts") -> DataFrame:
    """What was cached before the start, with its own numbers."""
    return numbered(events.where(F.col(ts) < until), [feed], order)


def catchup_then_live(log: DataFrame, live: DataFrame) -> DataFrame:
    return log.withColumn("mode", F.lit("replay")).unionByName(live.withColumn("mode", F.lit("live")))


def read(events: DataFrame, strategy: str, existing: Column, committed: Column) -> DataFrame:
    """What a reader started now sees; existing: there at the start; committed: read by an earlier run."""
    chosen = {"EARLIEST": F.lit(True), "COMMITED": ~committed, "LATEST": ~existing, "ONCE_EARLIEST": existing, "ONCE_LATEST": F.lit(False)}
    return events.where(chosen[strategy])


def data_clock(events: DataFrame, wall_clock: str, feed: str = "feed", order: str = "event_id") -> DataFrame:
    """clock_ms: of the last replayed record up to each event."""
    return carried(events, [feed], order, wall_clock, "clock_ms")


def latest_per_batch(events: DataFrame, batch: Column, order: str = "event_id") -> DataFrame:
    return events.groupBy(batch.alias("batch")).agg(F.max(order).alias(order))
