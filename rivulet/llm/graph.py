"""Connected components of links between documents, by joins and aggregates only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivulet.llm.workspace import materialize


def components(links: DataFrame, path: str, rounds: int = 60) -> DataFrame:
    """links (a, b) -> node, component (the least node reachable), for every node with a link.

    Large-star and small-star steps alternate until every node hangs on its component's least node: each keeps the components
    and at most doubles what a node can see, so rounds are logarithmic in a component's diameter.
    """
    edges = materialize(links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{path}/edges0")
    for k in range(1, rounds + 1):
        # large star: every node's larger neighbours move to the least of its neighbours and itself
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: a node and its smaller neighbours move to the least of these
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v"))).distinct()
        new = materialize(small, f"{path}/edges{k}")
        sums = new.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        before = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first() if k == 1 else before
        edges = new
        if sums == before:
            break
        before = sums
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
