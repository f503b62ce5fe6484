"""Health rollups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivulet.functions.scalar import VERDICT_RANK, verdict_of, verdict_rank


def rollup(checks: DataFrame, by: str = "service") -> DataFrame:
    """The worst verdict of each service's enabled checks; UNKNOWN without any."""
    worst = F.max(F.when(F.col("enabled"), verdict_rank(F.col("verdict"))))
    return checks.groupBy(by).agg(F.coalesce(worst, F.lit(VERDICT_RANK["UNKNOWN"])).alias("_rank")).select(by, verdict_of(F.col("_rank")).alias("verdict"))
