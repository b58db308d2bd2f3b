"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetwatch.session import cut


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("b", "a")).toDF("u", "v")
    least = both.groupBy(F.col("u").alias("__u")).agg(F.min("v").alias("__m"))
    return (
        both.where(F.col("v") > F.col("u"))
        .join(least, F.col("u") == F.col("__u"))
        .select(F.col("v").alias("a"), F.least("u", "__m").alias("b"))
        .where(F.col("a") != F.col("b"))
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy(F.col("u").alias("__u")).agg(F.min("v").alias("__m"))
    return (
        down.join(least, F.col("u") == F.col("__u"))
        .select(F.explode(F.array("v", "u")).alias("a"), F.col("__m").alias("b"))
        .where(F.col("a") != F.col("b"))
        .distinct()
    )


def _print(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node that an edge (a, b) names; the component is its smallest node.

    Each round is stored, so the lineage stays short. The least neighbour of a node is combined on the map side,
    and Spark splits the partition of a node with many neighbours.
    """
    now = cut(edges.select("a", "b").where(F.col("a") != F.col("b")).distinct(), "edges")
    seen = _print(now)
    while True:
        now = cut(_small_star(_large_star(now)), "edges")
        found = _print(now)
        if found == seen:
            break
        seen = found
    roots = now.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
