"""Connected components of an edge table, for graphs of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainframe.llm import common


def _stars(edges: DataFrame, larger: bool) -> DataFrame:
    """Ties the neighbours of every node to the smallest of them: the larger ones only, or the smaller ones and the node itself."""
    if larger:
        both = edges.select("a", "b").union(edges.select("b", "a"))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    tied = both.join(least, "a")
    if larger:
        return tied.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    return tied.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def components(edges: DataFrame, scratch: common.Scratch) -> DataFrame:
    """(a, b) -> doc, comp: every node of an edge with the smallest node that it is connected to.

    Large-star and small-star steps in turn until nothing changes; the number of steps grows with
    the logarithm of the longest path, and no node's neighbours are gathered. Loops are left out. The
    result reads tables of ``scratch``.
    """
    edges = scratch.table(edges.where("a <> b").distinct())
    before = None
    while True:
        edges = scratch.table(_stars(_stars(edges, True), False))
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("doc"), F.col("b").alias("comp")).union(edges.select("b", "b").distinct())
