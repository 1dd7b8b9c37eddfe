"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import Scratch


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b longs); component is the smallest node reachable.

    Each step links the neighbours of a node to the smallest of them: the large star
    those above the node, the small star those below it. Neither makes more edges
    than there were, and a path shrinks to a star in a logarithmic number of rounds.
    The edges of a round are written to the shared folder, so a lost executor costs
    one round at most, and a node with very many neighbours only meets them as rows
    of a join, which AQE splits.
    """
    scratch = Scratch(edges.sparkSession)
    pairs = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    now, step = scratch.keep(pairs, "edges-0"), 0
    state = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .unionByName(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct())
        step += 1
        after = scratch.keep(small, f"edges-{step}")
        seen = after.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x"),
                         F.sum(F.pmod(F.xxhash64("b", "a"), F.lit(2**31))).alias("s")).first()
        scratch.drop(f"edges-{step - 1}")
        if state == seen:
            break
        now, state = after, seen
    stars = after.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionByName(after.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
