"""Folders that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``, or under the warehouse where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/rivulet-{uuid.uuid4().hex}"
