"""Connected components of a link table, by alternating large-star and
small-star rounds (each a grouping and a join; the links are written to the
shared folder after every round). Nothing is gathered on the driver but a
count and a checksum a round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablelens.llm.common import stored


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = stored(both.groupBy("u").agg(F.min("v").alias("m")), "least")   # written, so that a hub's join can be split
    return both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.least("u", "m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v")))


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node that has a link; the root is the smallest
    node of its component and has no row of its own."""
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter(F.col("u") != F.col("v")).distinct()
    edges, before = stored(edges, "links"), None
    while True:
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if not now[0] or now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now
        large = _large_star(edges).filter(F.col("u") != F.col("v")).distinct()
        edges = stored(_small_star(large).distinct(), "links")
