"""Prototype similarity over embedding arrays."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


COPIED = 10_000


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 for a zero vector."""
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def prototypes(vectors: DataFrame, label: str, vector: str) -> DataFrame:
    """Mean vector per label, dimension by dimension: sums meet map-side, so a large label is no large task."""
    cells = vectors.select(label, F.posexplode(vector).alias("i", "x")).groupBy(label, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return cells.groupBy(label).agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("c")).select(label, F.transform("c", lambda c: c["x"]).alias("prototype"))


def assign(vectors: DataFrame, protos: DataFrame, label: str, vector: str, identifier: str, threshold: float | None = None) -> DataFrame:
    """Similarity of each vector with each prototype; with a threshold, those at or above it.

    Prototypes (one per label) are copied to every task, ``COPIED`` at a time
    where they are more.
    """
    blocks = 1 + protos.count() // COPIED
    parts = []
    for k in range(blocks):
        part = protos if blocks == 1 else protos.where(F.pmod(F.xxhash64(label), F.lit(blocks)) == k)
        out = vectors.select(identifier, vector).crossJoin(F.broadcast(part)).select(identifier, label, cosine(F.col(vector), F.col("prototype")).alias("similarity"))
        parts.append(out if threshold is None else out.where(F.col("similarity") >= threshold))
    return reduce(DataFrame.union, parts)
