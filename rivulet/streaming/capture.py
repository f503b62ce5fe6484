"""Capture of what processors receive, as tables by processor and day."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rivulet.exceptions import CommandError
from rivulet.operators.introspect import audit_list
from rivulet.sources.sinks import audit_sink


class Capture:
    def __init__(self, spark: SparkSession, root: str, ts: str = "ts"):
        self.spark, self.root, self.ts = spark, root.rstrip("/"), ts
        self._streams: dict[str, Callable[[], DataFrame]] = {}
        self._queries: dict[str, StreamingQuery] = {}

    def attach(self, processor: str, stream: Callable[[], DataFrame]) -> None:
        self._streams[processor] = stream

    def start(self, processor: str) -> StreamingQuery:
        """Starts recording, or goes on: a second start changes nothing. A processor that isn't attached is refused."""
        if processor not in self._streams:
            raise CommandError(f"no processor {processor} is attached to the capture")
        if not self.recording(processor):
            records = self._streams[processor]().withColumn("processor", F.lit(processor))
            path = f"{self.root}/records/{processor}"
            self._queries[processor] = audit_sink(records, path, f"{self.root}/checkpoints/{processor}", self.ts).queryName(f"audit.{processor}").start()
        return self._queries[processor]

    def stop(self, processor: str) -> None:
        query = self._queries.pop(processor, None)
        if query:
            query.stop()

    def stop_all(self) -> None:
        for processor in list(self._queries):
            self.stop(processor)

    def recording(self, processor: str) -> bool:
        return processor in self._queries and self._queries[processor].isActive

    def listing(self) -> DataFrame:
        """processor, size_bytes, files, last_write_at, path, is_live: captures on disk and live ones, live first, then by the last write."""
        live = [p for p in self._queries if self.recording(p)]
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/records")
        if place.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(place):
            files = self.spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(f"{self.root}/records")
        else:
            files = self.spark.createDataFrame([], "path string, modificationTime timestamp, length bigint")
        own = files.select(F.regexp_extract("path", "/records/([^/]+)/", 1).alias("processor"), "modificationTime", "length")
        sizes = own.groupBy("processor").agg(F.sum("length").alias("size_bytes"), F.count("*").alias("files"), F.max("modificationTime").alias("last_write_at"))
        recording = self.spark.createDataFrame([(p,) for p in live], "processor string").join(sizes, "processor", "left")
        return audit_list(sizes, recording).withColumn("path", F.concat(F.lit(f"{self.root}/records/"), "processor"))
