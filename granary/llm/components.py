"""Connected components of a table of links, by alternating star contraction (large star, small star).

Every round is a grouped minimum and a join on the links; nothing but two numbers a round comes to the driver. A node
with very many links is one key of that join, whose side of links Spark splits where it is skewed (the minimum's side
has one row a node). Links with a null end or of a node to itself join nothing; no links give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (a > b). Large: each node's larger neighbours move to its least neighbour. Small: the smaller ones do."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        both = both.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = both.join(least, "u")
    if large:
        moved = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        moved = joined.where("v != m").select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return moved.where("a != b").distinct()


def components(links: DataFrame, rounds: int = 100) -> DataFrame:
    """node, root (the smallest node of its component) of every node that has a link. links: a, b."""
    edges = written(links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    for _ in range(rounds):
        edges = written(_star(_star(edges, large=True), large=False), "links")
        # the links are a forest of stars once a round changes none of them
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
        before = tuple(now)
    raise RuntimeError(f"links have not settled after {rounds} rounds")
