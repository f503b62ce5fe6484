"""Stateful twins of batch operators: numbers along a feed, and suppressed checks, across micro-batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def _schema(df: DataFrame, extra: str) -> str:
    return ", ".join(f"`{n}` {t}" for n, t in df.dtypes) + f", {extra}"


def numbered(events: DataFrame, by: str = "feed", order: str = "event_id") -> DataFrame:
    """seq goes on from batch to batch; inside a batch it follows the order. State: a number for each key."""

    def assign(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seq = state.get[0] if state.exists else 0
        whole = pd.concat(list(frames)).sort_values(order)
        whole["seq"] = range(seq + 1, seq + 1 + len(whole))
        state.update((seq + len(whole),))
        yield whole

    return events.groupBy(by).applyInPandasWithState(assign, _schema(events, "seq bigint"), "seq bigint", "append", GroupStateTimeout.NoTimeout)


def suppressed(events: DataFrame, by: str, order: str, time: str, interval: int) -> DataFrame:
    """evaluated as in ``flow.suppressed``. State: the last evaluated time of each key."""

    def walk(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        whole = pd.concat(list(frames)).sort_values(order)
        out = []
        for t in whole[time]:
            hit = last is None or t - last >= interval
            last = int(t) if hit else last
            out.append(hit)
        state.update((last,))
        yield whole.assign(evaluated=out)

    return events.groupBy(by).applyInPandasWithState(walk, _schema(events, "evaluated boolean"), "last bigint", "append", GroupStateTimeout.NoTimeout)


def last_values(events: DataFrame, by: str, value: str, order: str = "event_id") -> DataFrame:
    """The last value of each key; write it in update mode."""
    return events.groupBy(F.col(by).alias("label")).agg(F.max_by(value, order).alias("value"))


def windowed_counts(events: DataFrame, ts: str, width: str, late: str, by: str = "feed") -> DataFrame:
    """Events by key and window of event time, final once the watermark has passed. Times without zone are taken as the session's."""
    timed = events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    return timed.groupBy(by, F.window("_ts", width).alias("w")).agg(F.count("*").alias("n")).select(by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
