"""Route risk: hits, dense panel, normalisation and exposure channels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import bands, text
from ..functions import constants as C
from . import timeseries
from .rollup import positive


def registry(spark: SparkSession, routes: dict[str, dict] = C.ROUTES) -> DataFrame:
    """``route, name, category, energy, goods``: one row per known route."""
    rows = [(k, v["name"], v["category"], v["energy"], v["goods"]) for k, v in routes.items()]
    return spark.createDataFrame(rows, "route string, name string, category string, energy double, goods double")


def mask_of(scored: DataFrame, routes: str) -> Column:
    """The routes of a row as a mask (see ``text.route_mask``), from a mask or an array of ids."""
    if not dict(scored.dtypes)[routes].startswith("array"):
        return F.col(routes)
    bits = [F.when(F.array_contains(routes, r), F.lit(1 << i)).otherwise(0).cast("long") for i, r in enumerate(C.ROUTES)]
    return reduce(lambda a, b: a.bitwiseOR(b), bits)


def hits(scored: DataFrame, routes: str = "routes") -> DataFrame:
    """One row per positive article and route."""
    found = text.masked_routes(mask_of(scored, routes))
    return scored.where(positive()).select("day", F.explode(found).alias("route"), "risk_score", "category", "risk_type")


def panel_of_hits(found: DataFrame, days: DataFrame, members: DataFrame) -> DataFrame:
    """The panel from saved hits (``day, route, risk_score``) and saved day totals (``total_articles, positive_articles, matched_positive_articles``)."""
    sums = found.groupBy("day", "route").agg(F.sum("risk_score").alias("risk_sum"), F.count("*").alias("hit_count"))
    grid = days.crossJoin(F.broadcast(members.select("route")))
    out = grid.join(sums, ["day", "route"], "left").na.fill(0, ["risk_sum", "hit_count"])
    return out.withColumn("raw_ratio", bands.ratio(F.col("risk_sum"), F.col("total_articles")))


def by_mask(scored: DataFrame, routes: str = "routes") -> DataFrame:
    """``day, mask, n, positives, risk_sum``: articles by day and the routes of positive ones, in one pass and one shuffle of small rows."""
    pos = positive()
    mask = F.when(pos, mask_of(scored, routes)).otherwise(0)
    return scored.groupBy("day", mask.alias("mask")).agg(F.count("*").alias("n"), F.count_if(pos).alias("positives"), F.sum(F.when(pos, F.col("risk_score")).otherwise(0.0)).alias("risk_sum"))


def day_totals(scored: DataFrame, routes: str = "routes") -> DataFrame:
    """``day, total_articles, positive_articles, matched_positive_articles``: what the panel divides by, to be saved beside the hits."""
    pos = positive()
    return scored.groupBy("day").agg(F.count("*").alias("total_articles"), F.count_if(pos).alias("positive_articles"), F.count_if(pos & (mask_of(scored, routes) != 0)).alias("matched_positive_articles"))


def panel(scored: DataFrame, members: DataFrame, routes: str = "routes") -> DataFrame:
    """Day by route: sums and counts of hits, zeros where none, against the day's articles.

    Articles are read and tagged once: everything is made from the sums by day
    and mask, of which there are as many as combinations of routes.
    """
    sums = by_mask(scored, routes)
    whole = Window.partitionBy("day")
    days = {
        "total_articles": F.sum("n").over(whole),
        "positive_articles": F.sum("positives").over(whole),
        "matched_positive_articles": F.sum(F.when(F.col("mask") != 0, F.col("positives")).otherwise(0)).over(whole),
    }
    told = sums.withColumns(days)
    # Each day's totals go to every route once, with the day's first mask; hits go to the routes of their masks.
    first = F.row_number().over(whole.orderBy("mask")) == 1
    every = F.array(*[F.struct(F.lit(r).alias("route"), F.lit(0.0).alias("s"), F.lit(0).cast("long").alias("c")) for r in C.ROUTES])
    own = F.transform(text.masked_routes(F.col("mask")), lambda r: F.struct(r.alias("route"), F.col("risk_sum").alias("s"), F.col("positives").alias("c")))
    rows = told.withColumn("_first", first).select("day", *days, F.inline(F.concat(own, F.when(F.col("_first"), every).otherwise(F.slice(every, 1, 0)))))
    out = rows.groupBy("day", "route").agg(*[F.first(c).alias(c) for c in days], F.sum("s").alias("risk_sum"), F.sum("c").alias("hit_count"))
    return out.join(F.broadcast(members.select("route")), "route", "left_semi").withColumn("raw_ratio", bands.ratio(F.col("risk_sum"), F.col("total_articles")))


def normalise(days: DataFrame, members: DataFrame, start: str, end: str, cut: str | None = None) -> DataFrame:
    """Threat index (0 to 100) per route, exposure channels, the larger of them as risk, and its moving means."""
    days = timeseries.with_scope(days, cut)
    keys, over = ["route", "_era"], Window.partitionBy("route", "_era")
    inside = F.col("day").between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    hit_days = F.count_if(inside & (F.col("hit_count") > 0)).over(Window.partitionBy("route"))
    any_base = F.count_if(inside).over(Window.partitionBy("route")) > 0
    base = F.coalesce(F.avg(F.when(inside, F.col("raw_ratio"))).over(over), F.when(~any_base, F.avg("raw_ratio").over(over)), F.lit(0.0))
    days = days.withColumns({"_hits": hit_days, "_base": base}).withColumn("_r", F.coalesce(F.try_divide(F.col("raw_ratio"), F.when(F.col("_base") > 0, F.col("_base"))), F.lit(0.0)))
    days = timeseries.transform(days, "_r", "_t", keys, C.ROUTE_TAIL_EXPONENT, C.ROUTE_UPPER_STRETCH)
    ok = (F.col("_hits") >= C.MIN_HIT_DAYS) & ((F.col("_base") > 0) | (F.col("_era") != "all"))
    days = days.withColumns(
        {"score_status": F.when(ok, "ok").otherwise("insufficient_history"), "threat_index": F.when(ok & (F.col("_base") > 0), bands.clip(F.col("_t"))).otherwise(0.0)}
    ).join(F.broadcast(members.select("route", "name", "energy", "goods")), "route")
    days = days.withColumns({"energy_risk": bands.clip(F.col("threat_index") * F.col("energy")), "goods_risk": bands.clip(F.col("threat_index") * F.col("goods"))})
    days = days.withColumn("route_risk", F.greatest("energy_risk", "goods_risk"))
    late = F.col("_era") != "warmup"
    days = days.withColumns({f"ma{n}": F.when(late, timeseries.moving_mean("route_risk", n, keys)) for n in (7, 30)})
    return days.drop("_hits", "_base", "_r", "_t", "_era")
