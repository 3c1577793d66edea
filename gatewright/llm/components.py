"""Connected components of a link table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatewright.session import materialise


def _large(links: DataFrame) -> DataFrame:
    """Tie every larger neighbour of a node to the smallest node around it."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return (
        both.filter("v > u").join(least, "u").filter("v <> m")
        .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    )


def _small(links: DataFrame) -> DataFrame:
    """Tie a node and its smaller neighbours to the smallest of them."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = links.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for each node with a link; root is the smallest node that it reaches.

    `links` has bigint columns u and v; direction, repeats, loops and nulls don't matter.
    The number of rounds is about the logarithm of the longest path. Each round is a
    checkpoint in the shared folder. The rows of a node that many others point to are
    only met by a join, which Spark can split.
    """
    links = links.filter("u <> v").select(
        F.greatest("u", "v").cast("bigint").alias("u"), F.least("u", "v").cast("bigint").alias("v")
    ).distinct()
    links = materialise(links)
    before = None
    while True:
        mark = links.agg(
            F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")
        ).first()
        if mark == before or not mark.n:
            break
        before = mark
        links = materialise(_small(_large(links)))
    roots = links.select(F.col("v").alias("node")).distinct().withColumn("root", F.col("node"))
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
