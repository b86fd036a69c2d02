"""Connected components by alternating star contraction, all state in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from asofkit.llm.text import checkpointed


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (columns a, b of longs); the root is the component's smallest node.

    Each round links every node's larger neighbours, then its smaller ones, to the
    smallest of them; rounds go on until the edges form stars and no longer change.
    Groups are reduced by minima only, so a node may have any number of links.
    """
    e = checkpointed(edges.select("a", "b").where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct())
    before = None
    while True:
        both = e.select(F.col("v").alias("x"), F.col("u").alias("y")).union(e.select(F.col("u").alias("x"), F.col("v").alias("y")))
        low = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = both.where("y > x").join(low, "x").select(F.col("y").alias("v"), F.col("m").alias("u")).distinct()
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(low, "v").select(F.when(F.col("u") == F.col("m"), F.col("v")).otherwise(F.col("u")).alias("v"), F.col("m").alias("u")).where("v <> u")
        e = checkpointed(small.distinct())
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == before:
            break
        before = now
    roots = e.groupBy("v").agg(F.min("u").alias("root")).select(F.col("v").alias("node"), "root")
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())
