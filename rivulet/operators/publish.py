"""Publishing: map, drop nulls, isolate errors, number, wrap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivulet.operators.sequence import ROWS_PER_LOT, neighbour, numbered


def publish(events: DataFrame, mapped: Column | None = None, feed: str = "feed", order: str = "event_id", value: str = "value") -> DataFrame:
    """Events with seq from 1 along each feed. Rows whose value, or whose mapped value, is null take no number."""
    live = events.where(F.col(value).isNotNull())
    if mapped is not None:
        live = live.withColumn(value, mapped).where(F.col(value).isNotNull())
    return numbered(live, [feed], order)


def map_safely(events: DataFrame, mapped: Column, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """(mapped events, dead letters). mapped is an expression of try_ functions: null for a value that isn't null is a failure."""
    tried = events.withColumn("_mapped", mapped)
    good = tried.where(F.col("_mapped").isNotNull()).withColumn(value, F.col("_mapped")).drop("_mapped")
    dead = tried.where(F.col("_mapped").isNull() & F.col(value).isNotNull()).drop("_mapped").withColumn("severity", F.lit("ERROR"))
    return good, dead


def envelope(published: DataFrame, data: Column, feed: str = "feed") -> DataFrame:
    """Adds the wrapped form: feed, seq and data in one struct."""
    return published.withColumn("envelope", F.struct(F.col(feed).alias("feed"), "seq", data.alias("data")))


def flatten(batches: DataFrame, items: str = "items") -> DataFrame:
    """The elements of every batch, in order, one row each."""
    return batches.select(*[c for c in batches.columns if c != items], F.posexplode(items).alias("pos", "item"))


def merge(*feeds: DataFrame, order: str = "event_id") -> DataFrame:
    """The bag union of feeds with pos, their place in the total order."""
    first, *rest = feeds
    for f in rest:
        first = first.unionByName(f)
    return numbered(first, [], order, "pos")


def unwrapped(events: DataFrame, wrapped: str, inner: str, value: str = "value") -> DataFrame:
    """Broadcast envelopes opened: value becomes the inner event where the wrapped struct is there, and stays elsewhere."""
    return events.withColumn(value, F.when(F.col(wrapped).isNotNull(), F.col(f"{wrapped}.{inner}")).otherwise(F.col(value))).drop(wrapped)


def missing(received: DataFrame, by: str = "feed", seq: str = "seq", rows_per_lot: int = ROWS_PER_LOT) -> DataFrame:
    """Gaps in the received sequence numbers: the number after each gap and how many are missing."""
    known = neighbour(received.where(F.col(seq).isNotNull()), [by], seq, seq, "_before", rows_per_lot=rows_per_lot)
    return known.withColumn("missing", F.col(seq) - F.col("_before") - 1).where("missing > 0").select(by, seq, "missing")
