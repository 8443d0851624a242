"""Rollups of scored articles by day, month, country, category and route."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import bands
from ..functions import constants as C


def positive() -> Column:
    return F.col("risk_score") > C.POSITIVE_ABOVE


def _sum(value: Column) -> Column:
    return F.coalesce(F.sum(value), F.lit(0.0))


def daily(scored: DataFrame) -> DataFrame:
    """One row a day: counts, sums over positives, component means, ratios over all articles, category sums over all rows.

    One partial and one final aggregation; the shuffle carries a row per day and task.
    """
    pos = positive()
    score = F.when(pos, F.col("risk_score"))
    measures = [
        F.count("*").alias("total_articles"),
        F.count_if(F.col("risk_score") > 0).alias("candidate_count"),
        F.count_if(pos).alias("positive_count"),
        _sum(score).alias("risk_sum"),
        _sum(F.when(F.col("risk_type") == "act", score)).alias("acts_sum"),
        _sum(F.when(F.col("risk_type").isin("threat", "context"), score)).alias("threats_sum"),
        F.coalesce(F.avg(score), F.lit(0.0)).alias("mean_score"),
        *[F.coalesce(F.avg(F.when(pos, F.col(c))), F.lit(0.0)).alias(f"mean_{c}") for c in ("theme_score", "tone_score", "dim_score")],
        *[_sum(F.when(F.col("category") == c, F.col("risk_score"))).alias(f"sum_{c}") for c in C.CATEGORY_NAMES],
    ]
    total = F.col("total_articles")
    return (
        scored.groupBy("day")
        .agg(*measures)
        .withColumns(
            {
                "positive_share": bands.ratio(F.col("positive_count"), total),
                "raw_ratio": bands.ratio(F.col("risk_sum"), total),
                "acts_ratio": bands.ratio(F.col("acts_sum"), total),
                "threats_ratio": bands.ratio(F.col("threats_sum"), total),
            }
        )
    )


def category_pivot(scored: DataFrame) -> DataFrame:
    """Sums by day and category, one column a category; absent ones are 0."""
    return scored.groupBy("day").pivot("category", list(C.CATEGORY_NAMES)).agg(F.sum("risk_score")).na.fill(0.0)


def by_group(scored: DataFrame, keys: Column, name: str) -> DataFrame:
    """``day, <name>, risk_sum, total_articles, raw_ratio``: positives exploded over an array of keys, against all articles of the day.

    Articles are read once: each also stands for itself, so that totals come
    out of the same aggregate. A null key among the keys belongs to no group.
    """
    own = F.array(F.struct(F.lit(True).alias("own"), F.lit(None).cast("string").alias("key")))
    each = F.transform(F.coalesce(keys, F.array().cast("array<string>")), lambda k: F.struct(F.lit(False).alias("own"), k.alias("key")))
    marked = F.when(positive(), F.concat(own, each)).otherwise(own)
    sums = scored.select("day", "risk_score", F.explode(marked).alias("_k")).groupBy("day", F.col("_k.own").alias("_own"), F.col("_k.key").alias(name)).agg(F.sum("risk_score").alias("risk_sum"), F.count("*").alias("_n"))
    total = F.max(F.when(F.col("_own"), F.col("_n"))).over(Window.partitionBy("day"))
    told = sums.withColumn("total_articles", total).where(~F.col("_own") & F.col(name).isNotNull()).drop("_n", "_own")
    return told.withColumn("raw_ratio", bands.ratio(F.col("risk_sum"), F.col("total_articles")))


def group_index(grouped: DataFrame, name: str, start: str, end: str) -> DataFrame:
    """``raw_ratio`` as a percentage of each group's mean over the baseline days (1 where that is 0 or missing)."""
    over = Window.partitionBy(name)
    base = F.avg(F.when(F.col("day").between(F.lit(start).cast("date"), F.lit(end).cast("date")), F.col("raw_ratio"))).over(over)
    return grouped.withColumn("group_index", F.col("raw_ratio") / F.coalesce(F.when(base != 0, base), F.lit(1.0)) * 100.0)


def monthly(days: DataFrame, *columns: str) -> DataFrame:
    """Means by calendar month, with counts of days and, where flagged, imputed days."""
    more = [F.count_if("is_imputed").alias("imputed_days")] if "is_imputed" in days.columns else []
    return days.groupBy(F.date_format("day", "yyyy-MM").alias("year_month")).agg(*[F.avg(c).alias(c) for c in columns], *more, F.count("*").alias("total_days"))


def ensure_ratios(days: DataFrame) -> DataFrame:
    """Missing ratios rebuilt from sums; all 0 on days without articles."""
    total = F.coalesce(F.col("total_articles").cast("double"), F.lit(0.0))
    pairs = (("raw_ratio", "risk_sum"), ("acts_ratio", "acts_sum"), ("threats_ratio", "threats_sum"))
    rebuilt = {r: F.when(total <= 0, 0.0).otherwise(F.coalesce(F.nanvl(F.col(r), F.lit(None).cast("double")), F.coalesce(F.col(s), F.lit(0.0)) / total)) for r, s in pairs}
    return days.withColumns(rebuilt)
