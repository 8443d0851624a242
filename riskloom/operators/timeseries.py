"""Series operators: moving windows, index transforms, filling, gaps, autocorrelation, event studies.

Series here have one row per day (per key), so windows without a partition key
run over thousands of rows, not over articles; everything article-sized is
aggregated by day first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions import constants as C
from .stats import correlation


def ordered(keys: Sequence[str] = (), by: str = "day") -> WindowSpec:
    return (Window.partitionBy(*keys) if keys else Window.partitionBy()).orderBy(by)


def moving_mean(value: str, n: int, keys: Sequence[str] = (), by: str = "day") -> Column:
    """Mean of up to ``n`` rows that end here; fewer at the start."""
    return F.avg(value).over(ordered(keys, by).rowsBetween(1 - n, 0))


def full_window(value: Column, n: int, how, keys: Sequence[str] = (), by: str = "day") -> Column:
    """An aggregate of the last ``n`` rows, null until ``n`` of them have values."""
    over = ordered(keys, by).rowsBetween(1 - n, 0)
    return F.when(F.count(value).over(over) == n, how(value).over(over))


def forward_window(value: Column, n: int, how, keys: Sequence[str] = (), by: str = "day") -> Column:
    """An aggregate of the next ``n`` rows, null where fewer follow."""
    over = ordered(keys, by).rowsBetween(1, n)
    return F.when(F.count(value).over(over) == n, how(value).over(over))


def era(day: str, cut: str) -> Column:
    return F.when(F.col(day) < F.lit(cut).cast("date"), "warmup").otherwise("product")


def with_scope(days: DataFrame, cut: str | None, day: str = "day") -> DataFrame:
    """``days`` with ``_era`` (its own era if both sides of the cut have days, else ``all``)."""
    if cut is None:
        return days.withColumn("_era", F.lit("all"))
    each = era(day, cut)
    both = F.size(F.collect_set(each).over(Window.partitionBy())) > 1
    return days.withColumn("_era", F.when(both, each).otherwise("all"))


def transform(days: DataFrame, ratio: str, out: str, keys: Sequence[str], exponent: float = C.TAIL_EXPONENT, stretch: float = C.UPPER_STRETCH) -> DataFrame:
    """Power of the ratio to its mean, scaled to mean 100, upper half stretched, scaled again; all 0 where the mean is 0."""
    over = Window.partitionBy(*keys)
    mean = F.avg(ratio).over(over)
    days = days.withColumn("_rel", F.when(mean == 0, 0.0).otherwise(F.pow(F.col(ratio) / mean, F.lit(exponent))))
    days = days.withColumn("_idx", F.coalesce(F.try_divide(F.col("_rel"), F.avg("_rel").over(over)) * 100.0, F.lit(0.0)))
    days = days.withColumn("_mid", F.median("_idx").over(over))
    days = days.withColumn("_str", F.when(F.col("_idx") >= F.col("_mid"), F.col("_idx") * stretch).otherwise(F.col("_idx")))
    return days.withColumn(out, F.coalesce(F.try_divide(F.col("_str"), F.avg("_str").over(over)) * 100.0, F.lit(0.0))).drop("_rel", "_idx", "_mid", "_str")


def baseline(value: str, start: str, end: str, keys: Sequence[str], day: str = "day") -> Column:
    """Mean over the baseline days of the scope, over all its days if there is none, 1 if that isn't positive."""
    over = Window.partitionBy(*keys)
    inside = F.col(day).between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    mean = F.coalesce(F.avg(F.when(inside, F.col(value))).over(over), F.avg(value).over(over))
    return F.when(mean > 0, mean).otherwise(1.0)


RATIOS = (("raw_ratio", "risk_index"), ("acts_ratio", "acts_index"), ("threats_ratio", "threats_index"))


def index_series(days: DataFrame, start: str, end: str, cut: str | None = None, ratios: Sequence[tuple[str, str]] = RATIOS) -> DataFrame:
    """Ratios over their baselines as indices of mean 100, with 7- and 30-row means.

    With ``cut``, days on both sides of it are normalised apart, and only the
    later ones have moving means.
    """
    days = with_scope(days, cut)
    for ratio, out in ratios:
        days = days.withColumn("_r", F.col(ratio) / baseline(ratio, start, end, ["_era"]))
        days = transform(days, "_r", out, ["_era"]).drop("_r")
    first = ratios[0][1]
    late = F.col("_era") != "warmup"
    for n in (7, 30):
        days = days.withColumn(f"ma{n}", F.when(late, moving_mean(first, n, ["_era"])))
    return days.drop("_era")


def calendar(spark, start: str, end: str) -> DataFrame:
    """All days from ``start`` to ``end``, both included; an error if they are reversed."""
    if start > end:
        raise ValueError(f"{start} is after {end}")
    return spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("day"))


def missing_days(days: DataFrame, start: str, end: str) -> DataFrame:
    """Calendar days without a row."""
    return calendar(days.sparkSession, start, end).join(days.select("day").distinct(), "day", "left_anti")


def islands(days: DataFrame) -> DataFrame:
    """Runs of consecutive days: ``first_day, last_day, n_days``."""
    numbered = days.select("day").distinct().withColumn("_k", F.date_sub("day", F.row_number().over(Window.partitionBy().orderBy("day"))))
    return numbered.groupBy("_k").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count("*").alias("n_days")).drop("_k")


def forward_fill(value: str, keys: Sequence[str] = (), by: str = "day") -> Column:
    return F.last(value, ignorenulls=True).over(ordered(keys, by).rowsBetween(Window.unboundedPreceding, 0))


def interpolate(days: DataFrame, value: str, out: str, keys: Sequence[str] = (), by: str = "day") -> DataFrame:
    """Linear by position between known values; the last one carries on; leading nulls stay."""
    w = ordered(keys, by)
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    at = F.when(F.col(value).isNotNull(), F.col("_n"))
    days = days.withColumn("_n", F.row_number().over(w))
    days = days.withColumns(
        {
            "_lv": F.last(value, True).over(back),
            "_ln": F.last(at, True).over(back),
            "_rv": F.first(value, True).over(ahead),
            "_rn": F.first(at, True).over(ahead),
        }
    )
    share = F.try_divide(F.col("_n") - F.col("_ln"), F.col("_rn") - F.col("_ln"))
    between = F.col("_lv") + (F.col("_rv") - F.col("_lv")) * share
    filled = F.coalesce(F.col(value), F.when(F.col("_rv").isNull(), F.col("_lv")).when(F.col("_lv").isNotNull(), between))
    return days.withColumn(out, filled).drop("_n", "_lv", "_ln", "_rv", "_rn")


def autocorrelation(days: DataFrame, value: str, lag: int, by: str = "day") -> DataFrame:
    """Pearson correlation of a series, nulls dropped, with itself ``lag`` rows before."""
    known = days.where(F.col(value).isNotNull()).select(F.col(value).alias("x"), F.lag(value, lag).over(Window.partitionBy().orderBy(by)).alias("y"))
    return known.where("y is not null").agg(correlation("x", "y").alias("autocorr"))


def event_z(series: DataFrame, events: DataFrame, value: str, keys: Sequence[str] = (), window: int = 3, before: int = 30) -> DataFrame:
    """Mean around each event against mean and deviation of the days before, by calendar distance.

    Each event is spelt out to its ``before + window + 1`` days, so series and
    events of any number meet by an equi-join on the day.
    """
    near, prior = F.col("_off") >= -window, F.col("_off") < -window
    spelt = events.withColumn("_off", F.explode(F.sequence(F.lit(-before), F.lit(window)))).withColumn("day", F.date_add("event_day", F.col("_off")))
    band = series.join(spelt, "day")
    group = [*events.columns, *keys]
    measured = band.groupBy(*group).agg(
        F.avg(F.when(near, F.col(value))).alias("event_mean"),
        F.avg(F.when(prior, F.col(value))).alias("prior_mean"),
        F.stddev_samp(F.when(prior, F.col(value))).alias("prior_std"),
        F.count(F.when(prior, F.col(value))).alias("prior_n"),
    )
    usable = (F.col("prior_n") >= 2) & (F.col("prior_std") > 0)
    return measured.withColumn("z", F.when(usable, (F.col("event_mean") - F.col("prior_mean")) / F.col("prior_std")))


def latest(rows: DataFrame, keys: Sequence[str], by: str) -> DataFrame:
    """The newest row per key (all columns), by a map-side aggregate rather than a sort."""
    rest = [c for c in rows.columns if c not in keys]
    picked = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), by).alias("_r"))
    return picked.select(*keys, "_r.*").select(*rows.columns)


def tail(rows: DataFrame, n: int, by: str, keys: Sequence[str] = ()) -> DataFrame:
    """The last ``n`` rows per key."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(by)))).where(F.col("_n") <= n).drop("_n")
