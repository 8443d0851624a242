"""Connected parts of a table of pairs, by stars that grow and merge."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import shared


def components(pairs: DataFrame) -> DataFrame:
    """``node, label`` for every end of ``pairs`` (``a, b`` of one type): the label is the least node of its part.

    Every round links each node's larger neighbours to its least one, then its
    smaller ones, until every part is a star around its least node. Rounds
    grow with the logarithm of a part's size; each is written to the shared
    folder, and no node's neighbours are ever collected.
    """
    links = shared.cut(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    before = None
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.where("v > u").join(least.select("u", F.least("u", "m").alias("m")), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = shared.cut(large.distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = shared.cut(small.unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        # Sums of hashes tell whether a round changed anything, without the pairs themselves.
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return links.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
