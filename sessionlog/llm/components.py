"""Connected components of links, by alternating large and small stars.

Each round is two grouped minima and joins over the links; the links are cut to
stored tables, and the driver sees only their number and checksum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import cut


def _checksum(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """links: u, v long. Returns (node, component) of every node that has a link; component is its smallest node.

    Rounds grow with the logarithm of a component's size; where they don't suffice that is an error, never a partial result.
    """
    stars = cut(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v").distinct())
    seen = _checksum(stars)
    for _ in range(rounds):
        if not seen[0]:
            break
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = cut(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        stars = cut(small.unionByName(least.withColumnRenamed("m", "v")).distinct())
        now = _checksum(stars)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components are not complete after {rounds} rounds")
    ends = stars.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return ends.unionByName(stars.select(F.col("v").alias("node"), F.col("v").alias("component"))).groupBy("node").agg(F.min("component").alias("component"))
