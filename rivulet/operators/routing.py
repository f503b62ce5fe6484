"""Routing by subscriptions: joins of events with small tables of (group, processor, feed)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivulet.exceptions import ConfigurationError

#: Subscription tables are configuration; above this many rows they are joined by a shuffle.
BROADCAST_ROWS = 100_000


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def subscribed(events: DataFrame, feeds: list[str], feed: str = "feed") -> DataFrame:
    """The events of the named feeds; on a table partitioned by feed other partitions aren't read."""
    return events.where(F.col(feed).isin(feeds))


def active(subscriptions: DataFrame, removed: DataFrame | None = None) -> DataFrame:
    """Subscriptions once each, without the removed ones (by the columns that removed has)."""
    distinct = subscriptions.distinct()
    return distinct if removed is None else distinct.join(removed.distinct(), removed.columns, "left_anti")


def route(events: DataFrame, subscriptions: DataFrame, since: str | None = None, ts: str = "ts") -> DataFrame:
    """A row for each event and subscription to its feed; with since, only events from then on."""
    joined = events.join(_small(subscriptions), "feed")
    return joined.where(F.col(ts) >= F.col(since)) if since else joined


def broadcast_route(events: DataFrame, processors: DataFrame) -> DataFrame:
    """Every event for every processor. The processors are broadcast; more than BROADCAST_ROWS of them are refused, as every event would
    be written that often."""
    names = processors.select("processor").distinct()
    if names.limit(BROADCAST_ROWS + 1).count() > BROADCAST_ROWS:
        raise ConfigurationError(f"more than {BROADCAST_ROWS} processors for a broadcast feed")
    return events.crossJoin(F.broadcast(names))


def listeners(subscriptions: DataFrame) -> DataFrame:
    return subscriptions.groupBy("feed").agg(F.count("*").alias("listeners"))


def dispatch(events: DataFrame, cases: list[tuple[Column, str, Column]], default: tuple[str, Column]) -> DataFrame:
    """callback and delivered of the first case (condition, callback, value) that holds, else of the default."""
    callback, delivered = F, F
    for condition, name, value in cases:
        callback, delivered = callback.when(condition, name), delivered.when(condition, value)
    return events.withColumn("callback", callback.otherwise(default[0])).withColumn("delivered", delivered.otherwise(default[1]))


def matching_services(wanted: DataFrame, services: DataFrame, assignable: DataFrame) -> DataFrame:
    """Services that fit each wanted type, by a table of assignable (child, parent) types; is_exact where the types are equal."""
    w, s, a = wanted.alias("w"), _small(services).alias("s"), _small(assignable).alias("a")
    joined = w.join(a, F.col("a.parent") == F.col("w.iface")).join(s, F.col("s.iface") == F.col("a.child"))
    return joined.select("w.target", "s.name", (F.col("s.iface") == F.col("w.iface")).alias("is_exact"))
