"""Market features, forward windows, regimes, analogs and the joint signal."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import bands
from . import timeseries
from .joins import as_of

WINDOWS = (5, 22, 66)
YEAR = 252
ANNUAL = 252.0


def returns(prices: DataFrame, price: str = "close") -> DataFrame:
    """``lr``: log return to the row before; null without one or for prices that aren't positive."""
    known = F.when(F.col(price) > 0, F.ln(price))
    return prices.withColumn("lr", known - F.lag(known, 1).over(timeseries.ordered()))


def realized_vol(n: int) -> Column:
    """Annualised percent deviation of the last ``n`` returns, null until there are ``n``."""
    return timeseries.full_window(F.col("lr"), n, F.stddev_samp) * F.sqrt(F.lit(ANNUAL)) * 100.0


def forward_vol(h: int) -> Column:
    """The same of the next ``h`` returns, null in the last rows."""
    return timeseries.forward_window(F.col("lr"), h, F.stddev_samp) * F.sqrt(F.lit(ANNUAL)) * 100.0


def forward_return(h: int) -> Column:
    return timeseries.forward_window(F.col("lr"), h, F.sum) * 100.0


def market_features(prices: DataFrame, price: str = "close", windows: Sequence[int] = WINDOWS) -> DataFrame:
    """Trailing vol and return per window, their ratio, and the drawdown from the year's high."""
    rows = returns(prices, price)
    rows = rows.withColumns(
        {f"rv{n}": realized_vol(n) for n in windows} | {f"ret{n}": timeseries.full_window(F.col("lr"), n, F.sum) * 100.0 for n in windows}
    )
    high = timeseries.full_window(F.col(price), YEAR, F.max)
    return rows.withColumns({"rv_ratio": F.try_divide(F.col(f"rv{windows[0]}"), F.col(f"rv{windows[1]}")), "drawdown": (F.col(price) / high - 1) * 100.0})


def index_features(days: DataFrame, columns: Sequence[str], windows: Sequence[int] = WINDOWS) -> DataFrame:
    """Log level, moving means, spike over the month's mean, and changes, per index column."""
    out = days
    for c in columns:
        level = F.ln(F.col(c) + 1)
        out = out.withColumn(f"log_{c}", level)
        x = F.col(f"log_{c}")
        w = timeseries.ordered()
        out = out.withColumns(
            {f"{c}_ma{n}": timeseries.full_window(x, n, F.avg) for n in windows}
            | {f"{c}_spike": x - timeseries.full_window(x, windows[1], F.avg)}
            | {f"{c}_chg{k}": x - F.lag(x, k).over(w) for k in (1, 5)}
        )
    return out


def balanced(features: DataFrame, threats: str, acts: str) -> DataFrame:
    """``threats_minus_acts``: log level of what is feared less that of what happened."""
    return features.withColumn("threats_minus_acts", F.col(f"log_{threats}") - F.col(f"log_{acts}"))


def assemble(market: DataFrame, index: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    """Market rows with the index features as of each day, complete rows only."""
    return as_of(market, index, "day", columns).na.drop(subset=[*columns, target])


def geo_regime(days: DataFrame, value: str = "risk_index") -> DataFrame:
    """One row on the last day: level, z-score, regime, 7-row change, percentile among all days."""
    w = timeseries.ordered()
    rows = days.where(F.col(value).isNotNull()).select(
        "day", F.col(value).alias("v"), F.lag(value, 7).over(w).alias("before"), timeseries.moving_mean(value, 7).alias("ma7"), timeseries.moving_mean(value, 30).alias("ma30")
    )
    last = rows.agg(F.max_by(F.struct(*rows.columns), "day").alias("l")).select("l.*")
    counts = rows.select(F.col("v").alias("h")).crossJoin(last.select(F.col("v").alias("now"))).agg(  # one row on the right
        F.count("*").alias("index_days"), (F.avg(F.when(F.col("h") <= F.col("now"), 1.0).otherwise(0.0)) * 100.0).alias("geo_percentile")
    )
    z = bands.z_score(F.col("v"))
    return last.crossJoin(counts).select(
        F.col("day").alias("as_of"), F.col("v").alias("level"), "ma7", "ma30", z.alias("z"), bands.regime(z).alias("regime"),
        F.when(F.col("before") != 0, (F.col("v") / F.col("before") - 1) * 100.0).alias("change_7"), "geo_percentile", "index_days",
    )


def trailing_vol_signal(prices: DataFrame, price: str = "close", n: int = 22, history: int = YEAR) -> DataFrame:
    """The rule that stands in for a model: trailing vol against the median and upper quartile of the last year."""
    rows = returns(prices, price).withColumn("rv", realized_vol(n)).where("rv is not null")
    recent = timeseries.tail(rows.select("day", "rv"), history, "day")
    sums = recent.agg(
        F.max_by("rv", "day").alias("trailing"), F.max("day").alias("as_of"), F.percentile("rv", F.lit(0.5)).alias("median"),
        F.percentile("rv", F.lit(0.75)).alias("q75"), F.count("*").alias("n"), F.collect_list("rv").alias("h"),  # at most ``history`` numbers
    )
    share = F.size(F.filter("h", lambda x: x <= F.col("trailing"))) / F.size("h") * 100.0
    q75 = F.when(F.col("n") >= n, F.col("q75")).otherwise(F.col("trailing"))
    probability = F.when(F.col("trailing") >= q75, 0.55).when(F.col("trailing") >= F.col("median"), 0.25).otherwise(0.08)
    return sums.select("as_of", "trailing", "median", q75.alias("q75"), probability.alias("high_vol_prob"), bands.vol_regime(probability).alias("regime"), share.alias("vol_percentile"))


def joint(geo: DataFrame, vol: DataFrame) -> DataFrame:
    """Composite of two one-row signals."""
    g, v = F.col("geo_percentile"), F.col("vol_percentile")
    score = bands.stress(g, v)
    return geo.select("geo_percentile").crossJoin(vol.select("vol_percentile")).select(
        score.alias("stress_score"), bands.stress_regime(score).alias("stress_regime"), bands.stress_story(score, g, v).alias("story"), bands.quadrant(g, v).alias("quadrant"), "geo_percentile", "vol_percentile"
    )


def analog(days: DataFrame, prices: DataFrame, value: str, tolerance: float = 10.0, horizon: int = 5, price: str = "close") -> DataFrame:
    """Median forward vol and return of the days whose level is within the tolerance of the last one."""
    market = returns(prices, price).select("day", forward_vol(horizon).alias("fwd_vol"), forward_return(horizon).alias("fwd_ret"))
    now = days.where(F.col(value).isNotNull()).agg(F.max_by(value, "day").alias("now"))
    known = days.select("day", F.col(value).alias("v")).join(market, "day").na.drop()
    near = known.crossJoin(now).where(F.abs(F.col("v") - F.col("now")) <= tolerance)  # one row on the right
    return near.agg(F.count("*").alias("sample_days"), F.median("fwd_vol").alias("vol_median"), F.median("fwd_ret").alias("return_median"))


def notable(days: DataFrame, months: dict[str, str]) -> DataFrame:
    """Labels of the known months among the days."""
    known = days.sparkSession.createDataFrame(list(months.items()), "year_month string, label string")
    return days.select(F.date_format("day", "yyyy-MM").alias("year_month")).distinct().join(F.broadcast(known), "year_month").select("label")


def walk_forward(rows: DataFrame, horizon: int, min_train: int, step: int) -> DataFrame:
    """Each row's position, the fold that predicts it (null before ``min_train``), and the last position that fold may train on."""
    at = F.row_number().over(Window.partitionBy().orderBy("day")) - 1
    rows = rows.withColumn("position", at)
    fold = F.when(F.col("position") >= min_train, F.floor((F.col("position") - min_train) / step))
    return rows.withColumn("fold", fold).withColumn("train_until", F.when(fold.isNotNull(), fold * step + min_train - horizon - 1))
