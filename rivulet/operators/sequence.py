"""Numbers, carried and neighbouring values along a total order, without one task for each key.

A window over a feed puts all of the feed in one task. Here the order column's quantiles cut every key into lots of bounded size; windows
run inside lots, and only a row for each key and lot is combined along the order. A table of one lot takes the plain window, with equal results.

Keys may be null, and nulls are one key. Rows whose order is null come first, as in Spark's windows; they are one lot.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rivulet.functions.scalar import epoch_us

ROWS_PER_LOT = 1_000_000


def _number(df: DataFrame, order: str) -> Column:
    """The order as a double. Rounding never turns the order around, so neighbours beyond 2**53 at most share a lot."""
    kind = dict(df.dtypes)[order]
    return (epoch_us(F.col(order)) if kind == "timestamp_ntz" else F.col(order)).cast("double")


def with_lots(df: DataFrame, order: str, rows_per_lot: int = ROWS_PER_LOT) -> DataFrame | None:
    """df with _lot, which never falls along the order (numbers or times); None if one lot is enough."""
    lots = df.count() // rows_per_lot
    if lots <= 1:
        return None
    numbers = df.withColumn("_order", _number(df, order))
    cuts = sorted(set(numbers.approxQuantile("_order", [i / lots for i in range(1, lots)], 0.1 / lots)))
    if not cuts:
        return None
    dealt = Bucketizer(splits=[float("-inf"), *cuts, float("inf")], inputCol="_order", outputCol="_lot", handleInvalid="keep").transform(numbers)
    return dealt.withColumn("_lot", F.when(F.col("_order").isNull(), -1.0).otherwise(F.col("_lot"))).drop("_order")


def by_lot(dealt: DataFrame, table: DataFrame, by: list[str]) -> DataFrame:
    """dealt with the columns of a table that has a row for each key and lot. Null keys meet null keys."""
    keys = [*by, "_lot"]
    right = table.select(*[F.col(c).alias(f"_key_{c}") for c in keys], *[c for c in table.columns if c not in keys])
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_key_{c}")) for c in keys])
    return dealt.join(right if by else F.broadcast(right), same).drop(*[f"_key_{c}" for c in keys])  # without a key, a row for each lot


def numbered(df: DataFrame, by: list[str], order: str, name: str = "seq", rows_per_lot: int = ROWS_PER_LOT) -> DataFrame:
    """df with name: 1, 2, ... for each key along the order."""
    dealt = with_lots(df, order, rows_per_lot)
    if dealt is None:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(order)).cast("bigint"))
    sizes = dealt.groupBy(*by, "_lot").agg(F.count("*").alias("_n"))
    before = sizes.select(*by, "_lot", (F.sum("_n").over(Window.partitionBy(*by).orderBy("_lot")) - F.col("_n")).alias("_before"))
    inside = dealt.withColumn(name, F.row_number().over(Window.partitionBy(*by, "_lot").orderBy(order)).cast("bigint"))
    return by_lot(inside, before, by).withColumn(name, F.col(name) + F.col("_before")).drop("_lot", "_before")


def carried(df: DataFrame, by: list[str], order: str, value: str, name: str, rows_per_lot: int = ROWS_PER_LOT) -> DataFrame:
    """df with name: the last value that isn't null, up to and with each row."""
    dealt = with_lots(df, order, rows_per_lot)
    rows = Window.unboundedPreceding, 0
    if dealt is None:
        return df.withColumn(name, F.last(value, ignorenulls=True).over(Window.partitionBy(*by).orderBy(order).rowsBetween(*rows)))
    place = F.struct(F.col(order).isNotNull(), F.col(order))
    lots = dealt.groupBy(*by, "_lot").agg(F.max_by(value, F.when(F.col(value).isNotNull(), place)).alias("_last"))
    earlier = Window.partitionBy(*by).orderBy("_lot").rowsBetween(Window.unboundedPreceding, -1)
    entering = lots.select(*by, "_lot", F.last("_last", ignorenulls=True).over(earlier).alias("_entering"))
    inside = Window.partitionBy(*by, "_lot").orderBy(order).rowsBetween(*rows)
    return by_lot(dealt.withColumn(name, F.last(value, ignorenulls=True).over(inside)), entering, by).withColumn(name, F.coalesce(name, "_entering")).drop("_lot", "_entering")


def neighbour(df: DataFrame, by: list[str], order: str, value: str, name: str, after: bool = False, rows_per_lot: int = ROWS_PER_LOT) -> DataFrame:
    """df with name: the value of the row before (or after) each row along its key's order; null at the end."""
    dealt = with_lots(df, order, rows_per_lot)
    step = F.lead if after else F.lag
    if dealt is None:
        return df.withColumn(name, step(value).over(Window.partitionBy(*by).orderBy(order)))
    place = F.struct(F.col(order).isNotNull(), F.col(order))
    edge = (F.min_by if after else F.max_by)(F.struct(value), place)  # the row of each lot that its neighbour lot looks at
    lots = dealt.groupBy(*by, "_lot").agg(edge.alias("_edge"))
    across = lots.select(*by, "_lot", step("_edge").over(Window.partitionBy(*by).orderBy("_lot"))[value].alias("_across"))
    inside = Window.partitionBy(*by, "_lot").orderBy(order)
    own = dealt.withColumn("_has", step(F.lit(True)).over(inside)).withColumn(name, step(value).over(inside))
    return by_lot(own, across, by).withColumn(name, F.when(F.col("_has"), F.col(name)).otherwise(F.col("_across"))).drop("_lot", "_has", "_across")
