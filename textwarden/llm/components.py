"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textwarden.runtime import shared_dir

#: Links (16 bytes each) up to which the minima of a round are broadcast; beyond, a shuffle join.
BROADCAST_LINKS = 1_000_000


def components(links: DataFrame) -> DataFrame:
    """``node``, ``root``: the smallest node reachable, for every node of ``links`` (``a``, ``b``, longs).

    Each round points the larger neighbours of a node (large star), then the smaller ones (small
    star), to the smallest, until nothing changes; rounds grow with the logarithm of the number
    of nodes. Each round is checkpointed in the shared folder. Links to itself and nulls are ignored.
    """
    shared_dir(links.sparkSession)
    edges = links.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct().checkpoint()
    seen = None
    while True:
        size, mark = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if (size, mark) == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", "v").distinct())
        seen = size, mark
        near = (lambda df: F.broadcast(df)) if size <= BROADCAST_LINKS else (lambda df: df)
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(near(least), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(near(least), "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = small.union(least.select("u", "m")).filter("u != v").distinct().checkpoint()
