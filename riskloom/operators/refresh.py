"""The incremental path: which days changed, rescoring just those, and normalising the whole series again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import readers, writers
from . import rollup, scoring, tables, timeseries

LOOKBACK = 14


def score_start(requested: Column, product: str, warmup: str) -> Column:
    """The first day of a batch: a request before the product start may reach back to the warm-up, a later one not before the product start."""
    product_day, warmup_day = F.lit(product).cast("date"), F.lit(warmup).cast("date")
    return F.when(requested < product_day, F.greatest(requested, warmup_day)).otherwise(F.greatest(requested, product_day))


def dirty_days(articles: DataFrame, saved: DataFrame) -> DataFrame:
    """``day``: days whose articles the saved series (``day, total_articles``) lacks or counts otherwise."""
    now = articles.groupBy("day").agg(F.count("*").alias("_now"))
    before = saved.select("day", F.col("total_articles").alias("_before"))
    return now.join(before, "day", "left").where(~F.col("_now").eqNullSafe(F.col("_before"))).select("day")


def missing_days(articles: DataFrame, saved: DataFrame, end: Column, product: str, lookback: int = LOOKBACK) -> DataFrame:
    """``day``: days with articles and no saved row, in the ``lookback`` days up to ``end`` and not before the product start."""
    first = F.greatest(F.date_sub(end, lookback), F.lit(product).cast("date"))
    return articles.where(F.col("day").between(first, end)).select("day").distinct().join(saved.select("day"), "day", "left_anti")


def rescore(articles: DataFrame, saved: DataFrame, dirty: DataFrame, start: str, end: str, cut: str | None = None) -> DataFrame:
    """The index of the saved series with the dirty days rolled up anew.

    Only articles of dirty days are scored (on a table by day the semi join
    prunes partitions); the saved days come in as sums. All days are
    normalised again, since one day alone would always be at its own mean.
    """
    fresh = rollup.daily(scoring.score_articles(articles.join(F.broadcast(dirty), "day", "left_semi")))  # one row a day
    merged = rollup.ensure_ratios(tables.replace_days(saved, fresh.select(*[c for c in saved.columns if c in fresh.columns])))
    return timeseries.index_series(merged, start, end, cut=cut)


def export_days(articles: DataFrame, path: str) -> None:
    """Articles as a table by day, after the integrity gate: an article without an identifier or a day stops the export."""
    checked = tables.gate(articles, (F.col("id").isNotNull(), "an article without an identifier"), (F.col("day").isNotNull(), "an article without a day"))
    writers.by_day(checked, path)


def score_exported(spark, path: str, start: str, end: str, base: tuple[str, str], cut: str | None = None) -> DataFrame:
    """The index of the exported days between two dates, in one batch."""
    days = rollup.daily(scoring.score_articles(readers.days(spark, path, start, end)))
    return timeseries.index_series(days, *base, cut=cut)
