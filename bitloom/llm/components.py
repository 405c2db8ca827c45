"""Connected components of a link table, by alternating star contraction on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

MAX_ROUNDS = 60


def _with_least(edges: DataFrame) -> DataFrame:
    """(u, v) of a symmetric edge table with m, the least of u and its neighbours. The minimum is
    pre-aggregated before the shuffle, and Spark splits the join where one u has many edges."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    return edges.join(least, "u")


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root for every node that has a link, root being its component's least node. Each round
    hangs larger neighbours on the least one and then flattens; the edge count and an order-free
    checksum tell when nothing changes. Rounds are written tables, so lineage stays short."""
    edges = stored(links.where(f"{a} <> {b}").select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "links")
    before = None
    if edges.isEmpty():
        return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    for _ in range(MAX_ROUNDS):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(joined.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges = stored(small, "links")
        now = edges.agg(F.count("*"), F.expr("sum(cast(xxhash64(u, v) as decimal(38,0)))"), F.countDistinct("u")).first()
        if now == before and now[0] == now[2]:
            break
        before = now
    else:
        raise RuntimeError(f"the components have not settled after {MAX_ROUNDS} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
