"""Calendar gaps of an index series: forward, linear and benchmark-scaled filling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import timeseries

METHODS = ("forward", "linear", "benchmark")


def fill(days: DataFrame, start: str, end: str, method: str, columns: Sequence[str], benchmark: DataFrame | None = None, before: str | None = None) -> DataFrame:
    """``days`` with a row for every missing day, values of ``columns`` filled, flagged by ``is_imputed`` and ``impute_method``.

    ``benchmark`` (``day, bench``) lends its shape to the first column, scaled
    to the last observed value before the first gap; without it, or where it
    has no value, the series is filled linearly or carried. ``before`` limits
    filling to earlier days.
    """
    if method not in METHODS:
        raise ValueError(f"unknown method {method}")
    gaps = timeseries.missing_days(days, start, end)
    if before is not None:
        gaps = gaps.where(F.col("day") < F.lit(before).cast("date"))
    rows = days.withColumns({"is_imputed": F.lit(False), "impute_method": F.lit("none")}).unionByName(
        gaps.withColumns({"is_imputed": F.lit(True), "impute_method": F.lit(method)}), allowMissingColumns=True
    )
    if method == "linear" or (method == "benchmark" and benchmark is None):
        for c in columns:
            rows = timeseries.interpolate(rows, c, c)
        return rows
    main = columns[0]
    if method == "benchmark":
        # One anchor row: the last observed day before the first gap, or the last of all.
        observed = days.select("day", F.col(main).alias("_m"))
        first_gap = gaps.agg(F.min("day").alias("_g"))
        anchor = observed.crossJoin(first_gap).agg(
            F.coalesce(F.max_by(F.struct("day", "_m"), F.when(F.col("day") < F.col("_g"), F.col("day"))), F.max_by(F.struct("day", "_m"), "day")).alias("a")
        )
        scale = anchor.select(F.col("a.day").alias("day"), F.col("a._m").alias("_m")).join(benchmark, "day").select((F.col("_m") / F.col("bench")).alias("_scale"))
        lent = benchmark.crossJoin(scale).select("day", (F.col("bench") * F.col("_scale")).alias("_lent"))
        rows = rows.join(lent, "day", "left")
    rows = rows.withColumns({c: timeseries.forward_fill(c) for c in columns})
    if method == "benchmark":
        rows = rows.withColumn(main, F.when(F.col("is_imputed"), F.coalesce("_lent", main)).otherwise(F.col(main))).drop("_lent")
    return rows


def rescale(rows: DataFrame, columns: Sequence[str], cut: str | None = None) -> DataFrame:
    """Columns scaled so that the first has mean 100 (over the later era only, if the cut splits the days)."""
    rows = timeseries.with_scope(rows, cut)
    mean = F.avg(F.when(F.col("_era") != "warmup", F.col(columns[0]))).over(Window.partitionBy())
    factor = F.when((F.col("_era") != "warmup") & (mean > 0), 100.0 / mean).otherwise(1.0)
    rows = rows.withColumn("_f", factor)
    return rows.withColumns({c: F.col(c) * F.col("_f") for c in columns}).drop("_f", "_era")
