"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askgrid.plans.shared import written


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array(
        F.struct(F.col("a").alias("u"), F.col("b").alias("v")),
        F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e")).select("e.*")


def _large_star(edges: DataFrame) -> DataFrame:
    near = _both_ways(edges)
    low = near.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return near.where("v > u").join(low, "u").select(F.col("m").alias("a"), F.col("v").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    below = edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    low = below.groupBy("u").agg(F.min("v").alias("m"))
    moved = below.join(low, "u").select(F.col("m").alias("a"), F.col("v").alias("b"))
    kept = low.select(F.col("m").alias("a"), F.col("u").alias("b"))
    return moved.unionByName(kept).where("a <> b")


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")))
                 .first())


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` of every node that has an edge; the root is the smallest id of its component.

    ``edges`` has ``a, b``; direction and repeats do not matter. Large-star and small-star steps
    alternate until nothing changes, which takes about the logarithm of the node count in rounds.
    Each round is written, so lineage stays short; no group is ever held in one row.
    """
    current = written(
        edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct())
    mark = _mark(current)
    while mark[0]:
        current = written(_small_star(_large_star(current).distinct()).distinct())
        after = _mark(current)
        if after == mark:
            break
        mark = after
    leaves = current.select(F.col("b").alias("node"), F.col("a").alias("root"))
    return leaves.unionByName(
        current.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
