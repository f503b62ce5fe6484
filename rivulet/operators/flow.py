"""Duty cycles, queue depths, bounded queues, timers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rivulet.operators.sequence import ROWS_PER_LOT, by_lot, numbered, with_lots

DRAIN = 64


def duty_cycles(published: DataFrame, limit: int = DRAIN) -> DataFrame:
    """cycle (from 0) in which each event is drained, at most limit in one."""
    return published.withColumn("cycle", F.floor((F.col("seq") - 1) / limit).cast("bigint"))


def arrivals(events: DataFrame, at: Column, name: str) -> DataFrame:
    return events.groupBy(at.alias(name)).agg(F.count("*").alias("arrived"))


def queue_depth(arrived: DataFrame, order: str, drained: int) -> DataFrame:
    """Depth of an unbounded queue that loses up to drained events each step: a running sum, reflected at zero."""
    along = Window.orderBy(order)  # a row for each step of time, not for each event
    net = arrived.withColumn("_net", F.sum(F.col("arrived") - drained).over(along))
    return net.select(order, (F.col("_net") - F.least(F.lit(0), F.min("_net").over(along))).cast("bigint").alias("depth"))


def bounded_queue(arrived: DataFrame, order: str, capacity: int, drained: int, by: str | None = None, rows_per_lot: int = ROWS_PER_LOT) -> DataFrame:
    """depth and dropped of a queue that holds capacity events and loses up to drained each step (a row for each unit of time).

    A step maps a depth d to min(max(d + s, low), high), and such maps combine to one of their kind. Lots of steps are combined each for itself,
    the few combined maps are walked for the depth that enters each lot, and lots are walked from there.
    """
    key = by or "_queue"
    frame = arrived if by else arrived.withColumn(key, F.lit(0))
    dealt = with_lots(frame, order, rows_per_lot)
    kinds = dict(frame.dtypes)
    columns = ", ".join(f"`{c}` {kinds[c]}" for c in frame.columns)

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, depth = None, 0
        for f in frames:
            depths, dropped = [], []
            for place, start, n in zip(zip(map(_plain, f[key]), f["_lot"]), f["_start"], f["arrived"]):
                if place != at:
                    at, depth = place, int(start)
                dropped.append(max(0, depth + n - capacity))
                depth = max(0, min(depth + n, capacity) - drained)
                depths.append(depth)
            yield f.drop(columns=["_lot", "_start"]).assign(depth=depths, dropped=dropped)

    def combine(f: pd.DataFrame) -> pd.DataFrame:
        shift, low, high = 0, -(10**18), 10**18
        for n in f.sort_values(order)["arrived"]:
            step, top = int(n) - drained, max(capacity - drained, 0)  # d -> min(max(d + step, 0), top)
            shift, low, high = shift + step, min(max(low + step, 0), top), min(max(high + step, 0), top)
        return pd.DataFrame({key: f[key].iloc[:1].to_numpy(), "_lot": f["_lot"].iloc[:1].to_numpy(), "_shift": [shift], "_low": [low], "_high": [high]})

    def enter(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        queue, depth, fresh = None, 0, True
        for f in frames:
            starts = []
            for q, shift, low, high in zip(map(_plain, f[key]), f["_shift"], f["_low"], f["_high"]):
                if fresh or q != queue:
                    queue, depth, fresh = q, 0, False
                starts.append(depth)
                depth = int(min(max(depth + shift, low), high))
            yield f[[key, "_lot"]].assign(_start=starts)

    if dealt is None:
        ready = frame.withColumn("_lot", F.lit(0.0)).withColumn("_start", F.lit(0).cast("bigint"))
    else:
        maps = dealt.groupBy(key, "_lot").applyInPandas(combine, f"`{key}` {kinds[key]}, _lot double, _shift bigint, _low bigint, _high bigint")
        starts = maps.repartition(key).sortWithinPartitions(key, "_lot").mapInPandas(enter, f"`{key}` {kinds[key]}, _lot double, _start bigint")
        ready = by_lot(dealt, starts, [key])
    out = ready.repartition(F.col(key), F.col("_lot")).sortWithinPartitions(key, "_lot", order).mapInPandas(walk, f"{columns}, depth bigint, dropped bigint")
    return out if by else out.drop(key)


def _plain(key: object) -> object:
    """Null keys are equal to one another."""
    return None if pd.isna(key) else key


def suppressed(events: DataFrame, by: str, order: str, time: str, interval: int) -> DataFrame:
    """evaluated: whether an event comes at least interval after the last evaluated one of its key (the first always is). An interval of
    0 evaluates all; an event without a time isn't evaluated; null keys are one key.

    Greedy, so a key's events pass one task in order; the task holds a number for the key at hand and streams.
    """

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, last = None, None
        for f in frames:
            out = []
            for k, t in zip(map(_plain, f[by]), f[time]):
                if k != name:
                    name, last = k, None
                hit = not pd.isna(t) and (last is None or t - last >= interval)
                if hit:
                    last = t
                out.append(hit)
            yield f.assign(evaluated=out)

    kinds = dict(events.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in events.columns) + ", evaluated boolean"
    return events.repartition(by).sortWithinPartitions(by, order).mapInPandas(walk, schema)


# The timer wheel's tick, and how many timers a poll fires.
TICK_MS, POLL = 1024, 100


def fire_times(events: DataFrame, now_ms: Column, delay_ms: Column, tick_ms: int = 1) -> DataFrame:
    """fire_ms of timers, on the wheel's next tick (TICK_MS for the wheel's own)."""
    due = now_ms + delay_ms
    return events.withColumn("fire_ms", due if tick_ms == 1 else (F.ceil(due / tick_ms) * tick_ms).cast("bigint"))


def polls(timers: DataFrame, order: str, fire_ms: str = "fire_ms", limit: int = POLL) -> DataFrame:
    """poll (from 0): which poll of its tick fires each timer, at most limit in one."""
    return numbered(timers, [fire_ms], order, "poll").withColumn("poll", F.floor((F.col("poll") - 1) / limit).cast("bigint"))


def reentrant(events: DataFrame, count: Column, made: Column) -> DataFrame:
    """Events that each event publishes again: made, an expression of i, for i from 0 to count - 1."""
    several = F.when(count > 0, F.sequence(F.lit(0).cast("bigint"), (count - 1).cast("bigint"))).otherwise(F.array().cast("array<bigint>"))
    return events.withColumn("i", F.explode(several)).withColumn("emitted", made)
