"""Connected components of links, by alternating large-star and small-star steps on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxloom.llm.common import staged


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root): for each node of the links (a, b), the least node that can be reached from it.

    Each round replaces the links by links to least neighbours; links are staged between rounds, and nothing but their count and
    checksum comes to the driver. Rounds end when the links no longer change. Hubs are joined, never gathered into one row, so
    that Spark can split a skewed join. Links from a node to itself and repeated links don't matter; nulls link nothing."""
    edges = staged(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "links")
    before = None
    for _ in range(most_rounds):
        at = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if at == before or not at[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", "v").distinct())
        before = at
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = staged(small.union(least).distinct(), "links")
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
