"""Retry schedules, dead letters and error rings."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rivulet.functions.scalar import total_backoff_ms


@dataclass(frozen=True)
class RetryPolicy:
    """How often, how long apart, and after which errors (all, if none is named) an event is tried again."""

    attempts: int = 3
    initial_ms: int = 5
    most_ms: int = 100
    factor: float = 2.0
    errors: tuple[type[BaseException], ...] = (RuntimeError,)

    def again(self, error: BaseException, attempt: int) -> bool:
        return attempt < self.attempts and (not self.errors or isinstance(error, self.errors))

    def delay_ms(self, attempt: int) -> int:
        return min(self.most_ms, int(self.initial_ms * self.factor ** (attempt - 1)))


def attempted(events: DataFrame, function: Callable[[object], object], value: str, result: str, policy: RetryPolicy = RetryPolicy()) -> DataFrame:  # noqa: B008
    """events with result (of the named type), attempts and error: function of each value, tried in place under the policy.

    Batches and streams alike. Each event is tried for itself, so those before a failing one aren't seen twice. An event that has used up its
    attempts, or fails with another error, has a null result and its error (``dead_letters`` takes these); the next one goes on.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            results, attempts, errors = [], [], []
            for v in f[value]:
                attempt, out, error = 1, None, None
                while True:
                    try:
                        out, error = function(v), None
                        break
                    except Exception as e:
                        out, error = None, f"{type(e).__name__}: {e}"
                        if not policy.again(e, attempt):
                            break
                        time.sleep(policy.delay_ms(attempt) / 1000)
                        attempt += 1
                results.append(out)
                attempts.append(attempt)
                errors.append(error)
            yield f.assign(result=results, attempts=attempts, error=errors)

    columns = ", ".join(f"`{n}` {t}" for n, t in events.dtypes)
    return events.mapInPandas(run, f"{columns}, result {result}, attempts int, error string")


def retrying(handler: Callable[[DataFrame, int], None], dead: Callable[[DataFrame, int], None], policy: RetryPolicy = RetryPolicy()) -> Callable[[DataFrame, int], None]:  # noqa: B008
    """A function for foreachBatch that tries the handler on each batch under the policy; a batch that is given up goes to dead, with error and
    severity, and the stream goes on."""

    def write(batch: DataFrame, batch_id: int) -> None:
        for attempt in range(1, policy.attempts + 1):
            try:
                return handler(batch, batch_id)
            except Exception as e:
                if not policy.again(e, attempt):
                    return dead(batch.withColumn("error", F.lit(f"{type(e).__name__}: {e}")).withColumn("severity", F.lit("ERROR")), batch_id)
                time.sleep(policy.delay_ms(attempt) / 1000)

    return write


def schedule(events: DataFrame, failures: Column, attempts: int = 3, initial: int = 5, most: int = 100, factor: float = 2.0) -> DataFrame:
    """attempts, dropped, backoff_ms of events whose first failures attempts fail, under a policy of at most so many attempts."""
    tried = F.least(failures + 1, F.lit(attempts)).cast("bigint")
    return events.withColumn("attempts", tried).withColumn("dropped", failures >= attempts).withColumn("backoff_ms", total_backoff_ms(F.col("attempts"), initial, most, factor))


def dead_letters(tried: DataFrame) -> DataFrame:
    """Of ``schedule`` the dropped events, of ``attempted`` those with an error, as errors."""
    return tried.where("dropped" if "dropped" in tried.columns else "error is not null").withColumn("severity", F.lit("ERROR"))


def ring(errors: DataFrame, by: str, order: str = "event_id", keep: int = 16) -> DataFrame:
    """The last keep errors of each key, newest first by rn. A rank limit lets Spark drop the rest before the shuffle."""
    newest = Window.partitionBy(by).orderBy(F.col(order).desc())
    return errors.withColumn("rn", F.row_number().over(newest)).where(F.col("rn") <= keep).withColumn("rn", F.col("rn").cast("bigint"))


def recent(errors: DataFrame, limit: int = 100, order: str = "event_id") -> DataFrame:
    """The newest limit errors; none for a limit of zero or less."""
    return errors.orderBy(F.col(order).desc()).limit(max(limit, 0))
