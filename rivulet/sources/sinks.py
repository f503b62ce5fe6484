"""Sinks of streaming queries."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from rivulet.exceptions import ConfigurationError, PublishError

POLICIES = ("CONTINUE", "FAIL_FAST", "RETRY_THEN_DROP")


def text_sink(events: DataFrame, path: str, line: Column, checkpoint: str) -> DataStreamWriter:
    """A line for each event; nulls are dropped."""
    return events.select(line.cast("string").alias("value")).where("value is not null").writeStream.format("text").option("path", path).option("checkpointLocation", checkpoint)


def memory_sink(events: DataFrame, name: str) -> DataStreamWriter:
    """For tests: rows are held by the driver; nulls (rows without any value) are dropped."""
    return events.dropna("all").writeStream.format("memory").queryName(name)


def once_per_batch(path: str) -> Callable[[DataFrame, int], None]:
    """A target for foreachBatch that a batch can come to twice: it writes a folder of its own for each batch, in place of an earlier one."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def pipe(events: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """A sink that is another query's source: read it with ``stream_log``."""
    return events.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)


def audit_sink(records: DataFrame, path: str, checkpoint: str, ts: str = "ts") -> DataStreamWriter:
    """Captured records by processor and day, so that old days can be dropped as folders."""
    return records.withColumn("day", F.to_date(ts)).writeStream.format("parquet").partitionBy("processor", "day").option("path", path).option("checkpointLocation", checkpoint)


@dataclass
class Breaker:
    """Keeps a target that has failed so often in a row from being tried for cool_s seconds; then one attempt decides."""

    failures: int = 5
    cool_s: float = 30.0
    clock: Callable[[], float] = time.monotonic
    failed: dict[str, int] = field(default_factory=dict)
    until: dict[str, float] = field(default_factory=dict)

    def closed(self, name: str) -> bool:
        return self.clock() >= self.until.get(name, float("-inf"))

    def told(self, name: str, ok: bool) -> None:
        self.failed[name] = 0 if ok else self.failed.get(name, 0) + 1
        if self.failed[name] >= self.failures:
            self.until[name] = self.clock() + self.cool_s


def fan_out(targets: dict[str, Callable[[DataFrame, int], None]], policy: str = "CONTINUE", attempts: int = 3, wait_s: float = 0.005, on_error: Callable[[str, Exception], None] | None = None, breaker: Breaker | None = None) -> Callable[[DataFrame, int], None]:
    """A function for foreachBatch that writes each batch to every target.

    CONTINUE: a failing target doesn't keep the others from the batch; FAIL_FAST: the batch fails; RETRY_THEN_DROP: so many attempts for each target.
    With a breaker, a target that is open is left out and reported. Targets should be idempotent by batch id (``once_per_batch``): a batch may
    come again after a restart.
    """
    if policy not in POLICIES:
        raise ConfigurationError(f"unknown policy {policy}")
    report = on_error or (lambda name, e: None)

    def attempt(name: str, batch: DataFrame, batch_id: int) -> None:
        for k in range(1, (attempts if policy == "RETRY_THEN_DROP" else 1) + 1):
            if breaker and not breaker.closed(name):
                report(name, PublishError(f"{name} is open"))
                return
            try:
                targets[name](batch, batch_id)
            except Exception as e:
                report(name, e)
                if breaker:
                    breaker.told(name, False)
                if policy == "FAIL_FAST":
                    raise PublishError(f"{name}: {e}") from e
                time.sleep(wait_s * 2 ** (k - 1))
            else:
                if breaker:
                    breaker.told(name, True)
                return

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            for name in targets:
                attempt(name, batch, batch_id)
        finally:
            batch.unpersist()

    return write
