"""Connected components of a table of links, by alternating stars; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import stored


def components(links: DataFrame, name: str) -> DataFrame:
    """(node, root) for every node with a link; root is the smallest id reachable. ``links`` has a, b.

    Each round hangs larger neighbours, then smaller ones, onto the smallest neighbour of a node; the table
    is written to the shared folder after every round, so a lost executor costs one round at most.
    """
    stars = stored(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name)
    known = None
    while True:
        both = stars.union(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(
            F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v"))
        )).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        stars = stored(small, name)
        state = stars.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == known:
            return stars.select(F.col("u").alias("node"), F.col("v").alias("root"))
        known = state
