"""Live counters and latencies of the engine's queries, from what Spark reports after each micro-batch."""

from __future__ import annotations

import threading
from collections import Counter, deque

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from rivulet.functions.scalar import LATENCY_CEILING
from rivulet.model import COUNTER, COUNTER_SNAPSHOT, LATENCY_SNAPSHOT
from rivulet.operators.metrics import RING


class Counters:
    """Counters and gauges by label; equal labels are one."""

    def __init__(self):
        self._values: dict[str, int] = {}
        self._ring: deque[tuple[int, dict[str, int]]] = deque(maxlen=RING)
        self._lock = threading.Lock()

    def increment(self, label: str, by: int = 1) -> None:
        with self._lock:
            self._values[label] = self._values.get(label, 0) + by

    def set(self, label: str, value: int) -> None:
        with self._lock:
            self._values[label] = value

    def get(self, label: str) -> int:
        return self._values.get(label, 0)

    def every(self) -> dict[str, int]:
        with self._lock:
            return dict(self._values)

    def snapshot(self, now_ms: int) -> None:
        """Keeps the values as of now; the newest RING snapshots stay."""
        self._ring.append((now_ms, self.every()))

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(sorted(self.every().items()), COUNTER)

    def snapshots(self, spark: SparkSession) -> DataFrame:
        """The ring, as ``metrics.ring_delta`` takes it."""
        return spark.createDataFrame([(t, label, v) for t, values in self._ring for label, v in values.items()], COUNTER_SNAPSHOT)


class Latencies:
    """Counts of latencies (ms) by processor and node since the last reading."""

    def __init__(self):
        self.enabled = True
        self._counts: dict[tuple[str, str], Counter] = {}
        self._lock = threading.Lock()

    def record(self, processor: str, node: str, ms: int) -> None:
        if self.enabled and ms >= 0:
            with self._lock:
                self._counts.setdefault((processor, node), Counter())[min(ms, LATENCY_CEILING)] += 1

    def reset(self) -> None:
        with self._lock:
            self._counts = {}

    def read(self, spark: SparkSession) -> DataFrame:
        """A row for each processor and node; the next interval begins."""
        with self._lock:
            counts, self._counts = self._counts, {}
        rows = []
        for (processor, node), c in sorted(counts.items()):
            n, at, seen = sum(c.values()), [], 0
            want = [-(-n * p // 1000) for p in (500, 900, 990, 999)]
            for value in sorted(c):
                seen += c[value]
                while len(at) < len(want) and seen >= want[len(at)]:
                    at.append(value)
            rows.append((processor, node, n, *at, max(c)))
        return spark.createDataFrame(rows, LATENCY_SNAPSHOT)


class Monitor(StreamingQueryListener):
    """Counts by label: ``processor.p.events``, ``feed.f.published`` (as the processor that has seen most of it), ``group.g.processed`` and
    ``group.g.idleCycles`` (micro-batches with and without rows); latencies of whole micro-batches and of their parts."""

    def __init__(self):
        super().__init__()
        self.counters, self.latencies = Counters(), Latencies()

    @staticmethod
    def observed(events: DataFrame, feed: str) -> DataFrame:
        return events.observe(f"feed.{feed}", F.count(F.lit(1)).alias("events"))

    def onQueryStarted(self, event) -> None:
        self.counters.set(f"service.{event.name}.up", 1)

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        if not progress.name or "." not in progress.name:
            return
        group, processor = progress.name.split(".", 1)
        self.counters.increment(f"group.{group}.{'processed' if progress.numInputRows else 'idleCycles'}")
        for name, row in (progress.observedMetrics or {}).items():
            if name.startswith("feed."):
                self.counters.increment(f"processor.{processor}.events", row["events"])
                self.counters.increment(f"{name}.processor.{processor}", row["events"])
                seen = [v for k, v in self.counters.every().items() if k.startswith(f"{name}.processor.")]
                self.counters.set(f"{name}.published", max(seen))
        for node, ms in (progress.durationMs or {}).items():
            self.latencies.record(processor, node, int(ms))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
