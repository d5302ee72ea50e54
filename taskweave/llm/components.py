"""Connected components of a large graph by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored


def _minima(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """Edges ``a, b`` (longs) -> ``node, root`` for every node that has an edge; the root is its component's least node.

    Each round stores its edges, so lineage doesn't grow.  Minima are pre-aggregated before the shuffle and joined back on
    the node, where Spark splits a node with very many edges.  The rounds end when the edges are stars around the least
    nodes; their number grows with the logarithm of the largest component.  Loops and repeated edges are allowed.
    """
    now = stored(spark, edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = _state(now)
    while before[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = both.join(_minima(both), "a").where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()
        joined = large.join(_minima(large), "a")
        small = (joined.where("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))
                 .unionByName(joined.select("a", F.col("least").alias("b"))).distinct())
        now = stored(spark, small, "edges")
        after = _state(now)
        if after == before:
            break
        before = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
