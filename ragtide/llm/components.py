"""Connected components of an edge table, by alternating large-star and small-star rounds.

Every round is a few aggregations and joins and is written to the shared
folder; only a row count and a checksum come to the driver. The stars end with
every node pointing at the smallest node of its component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragtide.llm.common import written


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the smallest node around it."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them."""
    down = edges.select(F.col("b").alias("u"), F.col("a").alias("v"))  # a < b
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v != m").select(F.col("m").alias("a"), F.col("v").alias("b"))
    return moved.union(least.select(F.col("m").alias("a"), F.col("u").alias("b"))).distinct()


def components(links: DataFrame, tag: str) -> DataFrame:
    """(node, root) for every node of ``links`` (a < b); root is the smallest node of its component."""
    edges = written(links.select("a", "b").where("a < b").distinct(), tag)
    state = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now[0] == 0 or (now[0], now[1]) == state:
            break
        state = (now[0], now[1])
        edges = written(_small_star(_large_star(edges)), tag)
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).union(
        edges.select("a", "a").distinct())
