"""Connected components of a graph given as edges, by alternating star contractions on Spark.

Large star: every node passes its larger neighbours to its smallest one. Small star: every node passes its smaller
neighbours, and itself, to the smallest. Both only ever take a minimum per node, which is pre-aggregated before it is
shuffled, and keep the number of edges within nodes plus edges, so a hub of any degree is no hot group. The rounds end when
only stars are left; chains of length n take about log n rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.shared import Scratch


def _smallest(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    """``edges`` (u > v); gives (larger neighbour, smallest of the neighbourhood)."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    best = _smallest(both).select("u", F.least("u", "m").alias("m"))
    # Only neighbours larger than the node are passed on, which are the edges as stored, seen from their smaller end.
    larger = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
    return larger.join(best, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """``edges`` (u > v); gives (smaller neighbour or the node itself, smallest)."""
    best = _smallest(edges)
    passed = edges.join(best, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return passed.where("u <> v").unionByName(best.select("u", F.col("m").alias("v")))


def _has_settled(edges: DataFrame) -> bool:
    """Whether all edges are stars: each node points to one root, and no root points anywhere."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into"))
    roots = edges.select(F.col("v").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("into"))
    roles = ends.unionByName(roots).groupBy("node").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
    return roles.where("out > 1 OR out = 1 AND into = 1").isEmpty()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) of every node that has an edge: root is the smallest node it reaches. ``edges``: longs u, v."""
    ordered = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = scratch.write(ordered)
    while not _has_settled(now):
        after = scratch.write(_small_star(_large_star(now).where("u <> v").distinct()).distinct())
        scratch.drop(now)
        now = after
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
