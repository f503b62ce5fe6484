"""Where intermediate tables go, and how they are written."""

from __future__ import annotations

import atexit
import contextlib
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``; where that is unset, under the warehouse, which driver and executors share as well."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.sql.warehouse.dir")
    path = f"{root.rstrip('/')}/rivulet-{uuid.uuid4().hex}"
    atexit.register(_drop, spark, path)
    return path


@contextlib.contextmanager
def passing(spark: SparkSession):
    """A folder for tables that are read no more once the block has ended."""
    path = scratch(spark)
    try:
        yield path
    finally:
        _drop(spark, path)


def _drop(spark: SparkSession, path: str) -> None:
    """At the driver's end, if not before; until then results may read the tables."""
    with contextlib.suppress(Exception):
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def materialize(df: DataFrame, path: str) -> DataFrame:
    """Writes df as Parquet and reads it back: cuts the lineage, survives lost executors and keeps column pruning."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
