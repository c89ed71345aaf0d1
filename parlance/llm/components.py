"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, partitions


def components(edges: DataFrame) -> DataFrame:
    """node and root (its component's smallest node) for every node of edges (x, y) that is not itself a root.

    Each round hangs larger neighbours on a node's smallest one, then smaller ones; rounds grow as the logarithm of the
    longest path. Smallest neighbours are pre-aggregated before the shuffle and edges stay in tables of the shared folder.
    Edges are far fewer than what they were found in, so an eighth of the partitions does."""
    few = max(2, partitions(edges.sparkSession) // 8)
    e = cut(edges.where("x <> y").select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct().coalesce(few))
    mark = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").coalesce(few)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("s")).select("s.*")
        e = cut(small.where("u <> v").coalesce(few).distinct().coalesce(few))
        now = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == mark:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = now
