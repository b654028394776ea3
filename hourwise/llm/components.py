"""Connected components of a link table by alternating star contraction, in Spark joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourwise.llm.common import staged


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of u moves to the smallest of u's neighbourhood."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(low, "a").select(F.col("b").alias("x"), F.col("m").alias("y"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every neighbour not above u, and u itself, moves to the smallest of them. ``edges``: (x, y) with y <= x."""
    low = edges.groupBy("x").agg(F.min("y").alias("m"))
    moved = edges.join(low, "x").select(F.col("y").alias("x"), F.col("m").alias("y"))
    return moved.unionByName(low.select("x", F.col("m").alias("y")))


def _stars(edges: DataFrame) -> bool:
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("root")).unionByName(
        edges.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("root"))
    )
    bad = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("root").alias("root")).where("up > 1 or up + root > 1")
    return not bad.take(1)


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable, for every node that has a link.

    ``links`` holds unordered pairs of any comparable type; self links, nulls and repeats are ignored.  Each round
    is two min-aggregates and two joins; a hot node is split by AQE, since only joins meet its raw links.  Every round
    is staged.  The loop ends when the edges are stars: no node has two roots, and no root has one itself.
    """
    e = staged(links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a <> b").distinct())
    while not _stars(e):
        step = _small_star(_large_star(e)).where("x <> y").distinct()
        e = staged(step.select(F.col("x").alias("a"), F.col("y").alias("b")))
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
