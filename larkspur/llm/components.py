"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import forget, written

#: A node's links are dealt over so many tasks: the centre of a large star is one key.
SALTS = 8


def _beside(edges: DataFrame, low: DataFrame) -> DataFrame:
    """edges with m, the value that low has for u. low is repeated for each salt, so that no task holds all links of a node."""
    salted = low.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return edges.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int")).join(salted, ["u", "salt"]).drop("salt")


def components(links: DataFrame) -> DataFrame:
    """links: x, y. node and component (the smallest node it reaches) for each node that is not the smallest of its own."""
    edges = written(links.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).where("u <> v").distinct(), "links")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = _beside(both, low).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = _beside(large, low).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        before, edges = edges, written(small.where("u <> v").distinct(), "links")
        forget(before)
        if edges.select(F.col("v").alias("u")).join(edges.select("u"), "u", "left_semi").isEmpty():
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
