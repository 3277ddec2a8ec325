"""Connected components of a table of links, as joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearsay.llm import shared


def connected(links: DataFrame) -> DataFrame:
    """links (a, b) of longs -> node, root: the smallest node that links lead to. Only linked nodes are in it.

    Large-star and small-star steps in turn, until nothing changes: a number of rounds like the logarithm of the
    longest path. A node's neighbours are never gathered: its smallest is an aggregate that is joined back, so a hub
    is pre-aggregated by the map tasks and split by adaptive joins. Each round is cut from its lineage.
    """
    edges = shared.cut(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    while True:
        # large star: every larger neighbour of a node is linked to the node's smallest
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: every smaller neighbour of a node, and the node, is linked to the smallest of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        edges = shared.cut(small.unionAll(least.select("a", F.col("m").alias("b"))).distinct())
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    # each node now links to its root alone
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
