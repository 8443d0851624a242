"""Connected components of an edge table, without a driver-side graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(edges: DataFrame) -> DataFrame:
    """``node, label`` for every end of ``edges`` (``a``, ``b`` longs): nodes share a label iff connected.

    Random-order contraction: each round gives every node a hashed rank,
    takes the lowest rank within two steps as its new name, and rewrites the
    edges to new names. A round shrinks a path by a constant factor in
    expectation and a star to one node, whatever the order of the ids, so the
    rounds grow with the logarithm of the largest group. Each round is cut, so
    lost executors cost one round at most. The number of edges only falls.
    """
    here = cut(edges.select("a", "b").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    named = None
    turn = 0
    while not here.isEmpty():
        turn += 1
        both = here.union(here.select("b", "a")).toDF("u", "v")
        rank = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(turn)).alias("r"), F.col(c).alias("id"))  # noqa: E731, B023
        one = both.groupBy("u").agg(F.least(F.min(rank("v")), F.min(rank("u"))).alias("low"))
        seen = both.join(one.select(F.col("u").alias("v"), "low"), "v").groupBy("u").agg(F.min("low").alias("low"))
        step = cut(seen.select(F.col("u").alias("old"), F.col("low.id").alias("new")))
        named = (
            step.toDF("node", "label")
            if named is None
            else named.join(step, named["label"] == step["old"], "left").select("node", F.coalesce("new", "label").alias("label"))
        )
        named = cut(named)
        ends = here.join(step.toDF("a", "x"), "a").join(step.toDF("b", "y"), "b").where("x <> y")
        here = cut(ends.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    if named is None:
        return here.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return named
