"""Counters, gauges, latency percentiles and deltas."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rivulet.functions.scalar import clamp_latency, label
from rivulet.operators.sequence import ROWS_PER_LOT, neighbour


def published(events: DataFrame, feed: str = "feed") -> DataFrame:
    return events.groupBy(feed).agg(F.count("*").alias("value")).select(label("feed", F.col(feed), "published").alias("label"), "value")


def busy_cycles(drained: DataFrame, group: str = "feed") -> DataFrame:
    """Cycles with work, not events. Two plain aggregates: (group, cycle) first, so a large group is spread over tasks."""
    cycles = drained.groupBy(group, "cycle").agg(F.count("*").alias("_n"))
    return cycles.groupBy(group).agg(F.count("*").alias("value")).select(label("group", F.col(group), "processed").alias("label"), "value")


def idle_cycles(events: DataFrame, group: str, slot: str) -> DataFrame:
    """idle and active slots of each group, out of all slots in which any group was active."""
    busy = events.groupBy(group, slot).agg(F.count("*").alias("_n"))
    slots = busy.select(slot).distinct().count()
    return busy.groupBy(group).agg(F.count("*").alias("active")).select(group, (F.lit(slots) - F.col("active")).alias("idle"), "active")


def node_invocations(events: DataFrame, nodes: DataFrame) -> DataFrame:
    """Invocations of the nodes (processor, node, feed); events are counted by feed before the join."""
    counts = events.groupBy("feed").agg(F.count("*").alias("n")).join(nodes, "feed")
    return counts.groupBy("processor", "node").agg(F.sum("n").alias("value")).select(label("node", F.col("processor"), F.col("node"), "invocations").alias("label"), "value")


def gauge(events: DataFrame, by: str, value: str, order: str = "event_id") -> DataFrame:
    """The last value by the order, which is also the last-value cache of a feed."""
    return events.groupBy(F.col(by).alias("label")).agg(F.max_by(value, order).alias("value"))


def intervals(ticks: DataFrame, by: Column | str, order: str, time: Column, name: str, rows_per_lot: int = ROWS_PER_LOT) -> DataFrame:
    """From each tick to the next of its cycle; null for the last."""
    timed = ticks.withColumn("_by", by if isinstance(by, Column) else F.col(by)).withColumn("_time", time)
    return neighbour(timed, ["_by"], order, "_time", name, after=True, rows_per_lot=rows_per_lot).withColumn(name, F.col(name) - F.col("_time")).drop("_by", "_time")


def percentiles(latencies: DataFrame, by: str, value: Column) -> DataFrame:
    """n, p50, p90, p99, p999 and max_ms. A count for each value is what the shuffle carries, however many events there are."""
    counted = latencies.select(by, clamp_latency(value).alias("_v")).where("_v is not null").groupBy(by, "_v").agg(F.count("*").alias("_n"))
    along = Window.partitionBy(by).orderBy("_v")
    ranked = counted.withColumn("_to", F.sum("_n").over(along)).withColumn("_all", F.sum("_n").over(Window.partitionBy(by)))
    at = lambda p: F.min(F.when(F.col("_to") >= F.ceil(F.col("_all") * F.lit(p)), F.col("_v")))
    return ranked.groupBy(by).agg(F.sum("_n").alias("n"), at(0.5).alias("p50"), at(0.9).alias("p90"), at(0.99).alias("p99"), at(0.999).alias("p999"), F.max("_v").alias("max_ms"))


def summary(events: DataFrame, by: str, value: str) -> DataFrame:
    return events.groupBy(by).agg(F.count("*").alias("n"), F.min(value).alias("min_v"), F.max(value).alias("max_v"))


def statistics(events: DataFrame, by: str, value: str) -> DataFrame:
    """n, min_v, max_v, sum_v and avg_v; sums are of decimals, so they don't depend on the order."""
    exact = F.sum(F.col(value).cast("decimal(28,6)"))
    return events.groupBy(by).agg(F.count(value).alias("n"), F.min(value).alias("min_v"), F.max(value).alias("max_v"), exact.cast("double").alias("sum_v"), (exact.cast("double") / F.count(value)).alias("avg_v"))


def counter(increments: DataFrame, label_: str = "label", amount: str = "amount") -> DataFrame:
    """label, value: the sum of each label's increments; equal labels are one counter."""
    return increments.groupBy(F.col(label_).alias("label")).agg(F.sum(amount).cast("bigint").alias("value"))


def processor_events(events: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Events that each processor receives; they are counted by feed before the join."""
    counts = events.groupBy("feed").agg(F.count("*").alias("n")).join(subscriptions.select("processor", "feed").distinct(), "feed")
    return counts.groupBy("processor").agg(F.sum("n").alias("value")).select(label("processor", F.col("processor"), "events").alias("label"), "value")


def every_counter(*counters: DataFrame) -> DataFrame:
    """All counters (label, value) as one table."""
    return reduce(DataFrame.unionByName, [c.select("label", "value") for c in counters])


# Snapshots that the ring keeps, and the longest window that a delta looks back.
RING, RING_MS = 60, 60_000


def ring_delta(snapshots: DataFrame, now: DataFrame, now_ms: int, window_ms: int) -> DataFrame:
    """label, delta: each counter's value now against its newest snapshot at or before now_ms - window_ms, else against its oldest.

    snapshots: label, ts_ms, value, of which the newest RING of each label are looked at; now: label, value. A window over RING_MS has no
    delta (null), nor has a counter without a snapshot; a window of 0 or less has 0.
    """
    if window_ms > RING_MS or window_ms <= 0:
        return now.select("label", (F.lit(None) if window_ms > 0 else F.lit(0)).cast("bigint").alias("delta"))
    newest = Window.partitionBy("label").orderBy(F.col("ts_ms").desc())
    ring = snapshots.withColumn("_rn", F.row_number().over(newest)).where(F.col("_rn") <= RING)  # Spark drops the rest before the shuffle
    older = F.max_by("value", F.when(F.col("ts_ms") <= now_ms - window_ms, F.col("ts_ms")))
    base = ring.groupBy("label").agg(F.coalesce(older, F.min_by("value", "ts_ms")).alias("_base"))
    return now.join(base, "label", "left").select("label", (F.col("value") - F.col("_base")).cast("bigint").alias("delta"))


def change(counts: DataFrame, by: str, order: str, value: str, name: str = "change") -> DataFrame:
    return counts.withColumn(name, F.col(value) - F.lag(value).over(Window.partitionBy(by).orderBy(order)))


def delta(snapshots: DataFrame, time: str, value: str, window: str) -> DataFrame:
    """value against the newest snapshot at least window (an interval) older, else against the oldest of all.

    snapshots: a row for each sample of one counter, whose value never falls; a range frame finds the older one without a join.
    """
    seconds = F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col(time))
    span = int(window)
    older = F.max(value).over(Window.orderBy("_s").rangeBetween(Window.unboundedPreceding, -span))
    oldest = F.first(value).over(Window.orderBy("_s").rowsBetween(Window.unboundedPreceding, 0))
    return snapshots.withColumn("_s", seconds).select(time, (F.col(value) - F.coalesce(older, oldest)).cast("bigint").alias("delta"))
