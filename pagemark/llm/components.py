"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise


def connected_components(edges: DataFrame, name: str = "cc") -> DataFrame:
    """(node, root) for every node of ``edges(u, v)``; root is the smallest node reachable.

    Each round hangs every node's neighbours on the smallest one; rounds needed grow with the
    logarithm of the number of nodes. Minima are combined before the shuffle, and joins back on
    a hub's key can be split, so no task gathers a hub's neighbours. Only one number a round
    reaches the driver. Self-links and repeats are ignored; null ends are dropped.
    """
    spark = edges.sparkSession
    star = (
        edges.where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )
    star = materialise(star, name)
    mark = _mark(star)
    while True:
        both = star.union(star.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(low.select("u", F.col("m").alias("v"))).distinct()
        new = materialise(small, name)
        now = _mark(new)
        discard(spark, star)
        star = new
        if now == mark:
            break
        mark = now
    roots = star.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return star.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)


def _mark(star: DataFrame) -> tuple:
    """A fingerprint of the edge set, equal only if a round changed nothing (up to 2^-64)."""
    row = star.agg(F.count(F.lit(1)).alias("n"), F.expr("bit_xor(xxhash64(u, v))").alias("x"), F.expr("sum(cast(u as decimal(20,0)))").alias("s"), F.expr("sum(cast(v as decimal(20,0)))").alias("t")).first()
    return tuple(row)
