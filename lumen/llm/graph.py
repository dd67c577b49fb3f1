"""Connected components of an edge table by distributed joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumen.llm.common import materialize


def _digest(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"),
                    F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], row["s"]


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b); root is the smallest node
    of its component.

    Union-find as alternating star contractions (large-star, small-star): each
    round hangs the neighbours of a node on its smallest neighbour, by an
    aggregation and an equi-join; the number of rounds is logarithmic and no node's
    neighbour list is ever gathered. Equal ends and repeated edges are harmless.
    """
    e = materialize(edges.where(F.col("a") != F.col("b")).select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = _digest(e)
    while before[0]:
        both = e.union(e.select("v", "u")).toDF("x", "y")
        low = both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"))
        large = both.join(low, "x").where(F.col("y") > F.col("x")).select(
            F.col("y").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(least, "u")
        e = materialize(hung.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
                        .union(hung.select("u", F.col("m").alias("v"))).distinct())
        after = _digest(e)
        if after == before:
            break
        before = after
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        e.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
