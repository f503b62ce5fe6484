"""Topology and audit listings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def topology(subscriptions: DataFrame) -> DataFrame:
    """processors (sorted, comma-joined) of each feed and group; subscriptions are configuration, so the lists are short."""
    return subscriptions.groupBy("feed", "grp").agg(F.array_join(F.array_sort(F.collect_set("processor")), ",").alias("processors"))


def feed_topology(subscriptions: DataFrame) -> DataFrame:
    """Each feed with its consumers as an array of (group, callback, processors)."""
    consumers = subscriptions.groupBy("feed", "grp", "callback").agg(F.array_sort(F.collect_set("processor")).alias("processors"))
    return consumers.groupBy("feed").agg(F.array_sort(F.collect_list(F.struct("grp", "callback", "processors"))).alias("consumers"))


def audit(records: DataFrame, by: str, payload: str, ts: str = "ts") -> DataFrame:
    return records.groupBy(F.col(by).alias("processor")).agg(F.count("*").alias("record_count"), F.sum(F.length(payload)).cast("bigint").alias("size_bytes"), F.min(ts).alias("started_at"), F.max(ts).alias("last_write_at"))


def audit_list(closed: DataFrame, live: DataFrame) -> DataFrame:
    """Captures of both tables, the live one where a processor has both; live ones first, then by the last write."""
    rest = closed.join(live.select("processor").distinct(), "processor", "left_anti")
    both = live.withColumn("is_live", F.lit(True)).unionByName(rest.withColumn("is_live", F.lit(False)))
    return both.orderBy(F.col("is_live").desc(), F.col("last_write_at").desc())
