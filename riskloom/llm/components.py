"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import materialise


def _star(pairs: DataFrame, small: bool) -> DataFrame:
    """Each node's neighbours point to the smallest of them and the node.

    pairs: (u, v) in both directions. Small star: only neighbours below the node, and the node itself; large star: those above.
    """
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = pairs.join(least, "u")
    if small:
        below = joined.where("v < u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        own = least.select(F.col("u").alias("a"), F.col("m").alias("b"))
        made = below.unionByName(own)
    else:
        made = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return made.where("a <> b").distinct()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): every node that has an edge to another, with the smallest node reachable.

    The edge set goes through the shared folder after each round, so executors may be lost. Rounds grow with the logarithm of the
    longest path; a hub's edges are one join key, which Spark's skew handling may split.
    """
    now = materialise(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct(), "edges")
    mark = None
    while True:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = materialise(_star(both, small=False), "large")
        # for the small star every node needs only its smaller neighbours, which are b of (a, b)
        now = materialise(_star(large.select(F.col("a").alias("u"), F.col("b").alias("v")), small=True), "small")
        told = now.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if (told["n"], told["x"]) == mark or not told["n"]:
            break
        mark = (told["n"], told["x"])
    roots = now.groupBy("b").agg(F.count(F.lit(1)).alias("n")).select(F.col("b").alias("node"), F.col("b").alias("component"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
