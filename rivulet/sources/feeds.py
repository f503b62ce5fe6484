"""Feeds as tables and streams."""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession


def feed_table(spark: SparkSession, path: str, feed: str = "feed", format: str = "parquet", **options) -> DataFrame:
    """A table of events as a feed table; feed names the column that tells feeds apart."""
    table = spark.read.format(format).options(**options).load(path)
    return table if feed == "feed" else table.withColumnRenamed(feed, "feed")


def write_log(published: DataFrame, path: str, feed: str = "feed") -> None:
    """Appends published events to a log, partitioned by feed, so that subscribers read only their feeds."""
    published.write.mode("append").partitionBy(feed).parquet(path)


def stream_log(spark: SparkSession, path: str, schema: str, files_per_trigger: int | None = None) -> DataFrame:
    """The log as a stream: first what is there, then what comes. files_per_trigger bounds what one batch admits."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


class OfferedFeed:
    """A feed that a program offers rows to. Offered rows are staged and drained together, as one file of a spool folder that ``stream`` reads;
    ``publish_now`` goes past the stage. None is ignored. The stage is the driver's: what comes in bulk belongs into a table."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path, schema
        self._staged: list[tuple] = []
        self._lock = threading.Lock()

    def offer(self, row: tuple | None) -> None:
        if row is not None:
            with self._lock:
                self._staged.append(row)

    def publish_now(self, row: tuple | None) -> None:
        if row is not None:
            self._write([row])

    def drain(self) -> int:
        """Publishes all that is staged, in order; how many."""
        with self._lock:
            rows, self._staged = self._staged, []
        if rows:
            self._write(rows)
        return len(rows)

    def stream(self, spark: SparkSession) -> DataFrame:
        return stream_log(spark, self.path, self.schema)

    def _write(self, rows: list[tuple]) -> None:
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(self.path)
