"""Column functions of the feed semantics; all run inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: How bad each verdict is, and the histogram's ceiling.
VERDICT_RANK = {"UP": 0, "UNKNOWN": 1, "DEGRADED": 2, "DOWN": 3}
LATENCY_CEILING = 3_600_000


def wrap_strategy(wrap: Column, broadcast: Column) -> Column:
    """The envelope mode that the two flags stand for."""
    scope = F.when(broadcast, "BROADCAST").otherwise("SUBSCRIPTION")
    return F.concat(scope, F.when(wrap, "_NAMED_EVENT").otherwise("_NOWRAP"))


def verdict_rank(verdict: Column) -> Column:
    ranks = F.create_map(*[F.lit(x) for pair in VERDICT_RANK.items() for x in pair])
    return F.try_element_at(ranks, verdict)


def verdict_of(rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in sorted(VERDICT_RANK, key=VERDICT_RANK.get)]), (rank + 1).cast("int"))


def clamp_latency(value: Column, ceiling: int = LATENCY_CEILING) -> Column:
    """Negatives are null (dropped by aggregates), others at most the ceiling."""
    return F.when(value >= 0, F.least(value, F.lit(ceiling)))


def retry_delay_ms(attempt: Column, initial: int = 5, most: int = 100, factor: float = 2.0) -> Column:
    """The wait before the next attempt, after attempt (from 1) has failed."""
    return F.least(F.lit(most), (F.lit(initial) * F.pow(F.lit(factor), attempt - 1)).cast("bigint"))


def total_backoff_ms(attempts: Column, initial: int = 5, most: int = 100, factor: float = 2.0) -> Column:
    """All waits before the last of so many attempts."""
    waits = F.transform(F.sequence(F.lit(1), F.greatest(attempts.cast("int") - 1, F.lit(1))), lambda k: retry_delay_ms(k, initial, most, factor))
    return F.when(attempts <= 1, F.lit(0).cast("bigint")).otherwise(F.aggregate(waits, F.lit(0).cast("bigint"), lambda a, w: a + w))


def label(*parts: Column | str) -> Column:
    return F.concat_ws(".", *[F.lit(p) if isinstance(p, str) else p for p in parts])


def epoch_us(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp without zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), ts)


def epoch_ms(ts: Column) -> Column:
    return F.floor(epoch_us(ts) / 1000).cast("bigint")


def truncated(unit: str, ts: Column) -> Column:
    return F.date_trunc(unit, ts).cast("timestamp_ntz")


def ns_to_us(ns: Column) -> Column:
    return F.floor(ns / F.lit(1000).cast("decimal(20,0)")).cast("bigint")  # doubles can't hold nanoseconds since 1970


def ns_to_ms(ns: Column) -> Column:
    return F.floor(ns / F.lit(1_000_000).cast("decimal(20,0)")).cast("bigint")


def time_in(text: Column) -> Column:
    """The number behind time= in a text; null without one."""
    return F.nullif(F.regexp_extract(text, "time=([0-9]+)", 1), F.lit("")).cast("bigint")


def command_words(line: Column) -> Column:
    """A command line's words, by single spaces after trimming."""
    return F.split(F.trim(line), " ")
