"""The validation report: the checks of every producer in one table, their tallies, tiles and the fallback.

A producer takes day series or one-row figures, never articles, and returns
``id, category, tier, freshness, value, threshold, status``. A check without a
value doesn't apply (``na``), but for a statistical property, which then fails.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import labels
from . import stats, timeseries

COLUMNS = ("id", "category", "tier", "freshness", "value", "threshold", "status")
#: The literature's ranges of an index, and the days from which lag 90 replaces lag 1.
PROPERTIES = {
    "mean": "x BETWEEN 90 AND 110", "std": "x BETWEEN 35 AND 70", "skewness": "x > 0.5", "p01": "x > 0", "p25": "x BETWEEN 50 AND 90",
    "median": "x BETWEEN 90 AND 115", "p75": "x BETWEEN 120 AND 160", "p99": "x BETWEEN 200 AND 400",
    "autocorr_lag1": "x > 0.45", "autocorr_lag90": "x > 0.5", "positive_share": "x BETWEEN 0.1 AND 0.25",
}
LONG_SAMPLE = 1000
BENCHMARK_TIERS = {"ma30": "headline", "ma7": "detail", "raw_daily": "informational"}
BENCHMARK_PASS = "x > 0.5"
EVENT_PASS = "x > 1"
LEAKAGE = 0.95
NLP_PASS = "x >= 95"


def records(rows: DataFrame, identifier: Column, category: str, tier: Column | str, freshness: Column | str, value: Column, threshold: str, status: Column | None = None) -> DataFrame:
    """One check a row; by default n/a without a value, else whether ``threshold`` (a rule on ``x``) holds."""
    of = lambda c: c if isinstance(c, Column) else F.lit(c)
    out = rows.select(identifier.alias("id"), F.lit(category).alias("category"), of(tier).alias("tier"), of(freshness).alias("freshness"), value.cast("double").alias("x"), F.lit(threshold).alias("threshold"), *([] if status is None else [status.alias("status")]))
    if status is None:
        out = out.withColumn("status", F.when(F.col("x").isNull(), "na").when(F.expr(threshold), "pass").otherwise("fail"))
    return out.withColumnRenamed("x", "value").select(*COLUMNS)


def properties(days: DataFrame, value: str = "risk_index", share: str = "positive_share") -> DataFrame:
    """Moments, quantiles, autocorrelation (lag 90 from 1,000 days on, else lag 1) and mean positive share."""
    w = timeseries.ordered()
    known = days.where(F.col(value).isNotNull()).select("day", F.col(value).alias("v"), F.col(share).alias("s"))
    lagged = known.withColumns({"p1": F.lag("v", 1).over(w), "p90": F.lag("v", 90).over(w)})
    one = lagged.agg(
        F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), stats.skew("v").alias("skewness"), *[stats.quantile("v", q).alias(n) for n, q in (("p01", 0.01), ("p25", 0.25), ("median", 0.5), ("p75", 0.75), ("p99", 0.99))],
        stats.correlation("v", "p1").alias("autocorr_lag1"), stats.correlation("v", "p90").alias("autocorr_lag90"), F.avg("s").alias("positive_share"), (F.datediff(F.max("day"), F.min("day")) + 1).alias("span"),
    )
    ok = {m: F.coalesce(F.expr(rule.replace("x ", f"{m} ")), F.lit(False)) for m, rule in PROPERTIES.items()}
    parts = F.array(*[F.struct(F.lit(f"index_stat_{m}").alias("id"), F.col(m).cast("double").alias("value"), F.lit(PROPERTIES[m]).alias("threshold"), F.when(ok[m], "pass").otherwise("fail").alias("status")) for m in PROPERTIES])
    other = F.when(F.col("span") >= LONG_SAMPLE, "index_stat_autocorr_lag1").otherwise("index_stat_autocorr_lag90")
    checked = one.select(F.inline(F.filter(parts, lambda c: c["id"] != other))).withColumns({"category": F.lit("index"), "tier": F.lit("detail"), "freshness": F.lit("offline")})
    return checked.select(*COLUMNS)


def benchmark(days: DataFrame, bench: DataFrame, least: int = 30) -> DataFrame:
    """Correlation with the benchmark, raw and of both sides' moving means; none of under ``least`` common days."""
    theirs = bench.select("day", F.col("bench").alias("b"), timeseries.moving_mean("bench", 7).alias("b7"), timeseries.moving_mean("bench", 30).alias("b30"))
    both = days.join(theirs, "day")
    pairs = {"raw_daily": ("risk_index", "b"), "ma30": ("ma30", "b30"), "ma7": ("ma7", "b7")}
    figures = [F.struct(F.lit(k).alias("comparison"), stats.correlation(x, y).alias("r"), F.count_if(F.col(x).isNotNull() & F.col(y).isNotNull()).alias("overlap")) for k, (x, y) in pairs.items()]
    return both.agg(F.array(*figures).alias("f")).select(F.inline("f")).where(F.col("overlap") >= least)


def benchmark_checks(compared: DataFrame) -> DataFrame:
    """Checks of ``benchmark``'s rows; an unknown correlation fails."""
    tier = F.create_map(*[F.lit(x) for kv in BENCHMARK_TIERS.items() for x in kv])
    status = F.when(F.coalesce(F.col("r") > 0.5, F.lit(False)), "pass").otherwise("fail")
    return records(compared, F.concat(F.lit("index_benchmark_"), "comparison"), "index", F.coalesce(F.try_element_at(tier, F.col("comparison")), F.lit("detail")), "offline", F.col("r"), BENCHMARK_PASS, status)


def slug(label: Column) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(label), "[^a-z0-9]+", "_"), "^_+|_+$", ""), 1, 40)


def event_spikes(days: DataFrame, events: DataFrame) -> DataFrame:
    """Known events (``event_day, label``) against the index's days before."""
    z = timeseries.event_z(days.select("day", "risk_index"), events, "risk_index").select("event_day", "label", "z")
    return records(events.join(z, ["event_day", "label"], "left"), F.concat(F.lit("index_event_spike_"), slug(F.col("label"))), "index", "detail", "offline", F.col("z"), EVENT_PASS)


def route_events(panel: DataFrame, events: DataFrame) -> DataFrame:
    """Known events (``event_day, event_route, label``): the target's z and its lead over the strongest other route.

    Routes with equal series tie, so leads are compared to nine digits.
    """
    z = timeseries.event_z(panel.select("day", "route", "threat_index"), events, "threat_index", keys=["route"])
    target = F.col("route") == F.col("event_route")
    best = z.groupBy("event_day", "event_route", "label").agg(F.max(F.when(target, F.col("z"))).alias("z"), F.max(F.when(~target, F.col("z"))).alias("other"))
    return events.join(best, ["event_day", "event_route", "label"], "left").withColumn("lead", F.round(F.col("z") - F.col("other"), 9))


def route_event_checks(measured: DataFrame) -> DataFrame:
    name = slug(F.col("label"))
    response = records(measured, F.concat(F.lit("route_event_"), name), "route", "detail", "offline", F.col("z"), EVENT_PASS)
    return response.unionByName(records(measured, F.concat(F.lit("route_lead_"), name), "route", "detail", "offline", F.col("lead"), "x > 0"))


def leakage(panel: DataFrame, days: DataFrame) -> DataFrame:
    """Per route: correlation with the parent index, and whether it stays under the limit (a constant route does)."""
    both = panel.select("day", "route", "threat_index").join(days.select("day", "risk_index"), "day")
    return both.groupBy("route").agg(stats.correlation("threat_index", "risk_index").alias("r")).withColumn("ok", F.coalesce(F.abs("r") <= LEAKAGE, F.lit(True)))


def leakage_check(measured: DataFrame) -> DataFrame:
    """The pass rate of all routes, in percent; no check without routes."""
    one = measured.agg(F.count_if("ok").alias("passed"), F.count("*").alias("n")).where("n > 0")
    return records(one, F.lit("route_parent_leakage"), "route", "headline", "offline", 100.0 * F.col("passed") / F.col("n"), "x = 100")


def imputation(rows: DataFrame) -> DataFrame:
    """Days that were filled; filling is declared, so the check passes, and there is none without such days."""
    one = rows.agg(F.count_if("is_imputed").alias("n")).where("n > 0")
    return records(one, F.lit("index_gap_imputation"), "index", "informational", "offline", F.col("n"), "x > 0")


def market(one: DataFrame) -> DataFrame:
    """Of ``market_only, market_plus_index, live``: both areas, and what the index adds; figures that aren't live are only shown."""
    fresh, more = F.when(F.col("live"), "live").otherwise("offline"), F.round("market_plus_index", 3) - F.round("market_only", 3)
    adds = F.when(F.col("live") & (more > 0), "pass").when(F.col("live") & more.isNotNull(), "warn").otherwise("na")
    shown = [records(one, F.lit(f"market_vol_{c}"), "market", "informational", fresh, F.round(c, 3), "shown", F.lit("na")) for c in ("market_only", "market_plus_index")]
    return shown[0].unionByName(shown[1]).unionByName(records(one, F.lit("market_vol_index_adds"), "market", F.when(F.col("live"), "headline").otherwise("informational"), fresh, F.round(more, 3), "x > 0", adds))


def rank_areas(rows: DataFrame, scores: Sequence[str], label: str) -> DataFrame:
    """One row with the area under the ROC curve of each score, ties by mean ranks. For series: a row a day."""
    stacked = rows.select(F.col(label).alias("l"), F.inline(F.array(*[F.struct(F.lit(s).alias("score"), F.col(s).cast("double").alias("s")) for s in scores]))).where("l is not null and s is not null")
    ranked = stats.average_rank(stacked, "s", "r", ["score"])
    p, n = F.count_if(F.col("l") == 1), F.count_if(F.col("l") != 1)
    areas = ranked.groupBy("score").agg(F.try_divide(F.sum(F.when(F.col("l") == 1, F.col("r"))) - p * (p + 1) / 2.0, p * n).alias("area"))
    return areas.agg(*[F.max(F.when(F.col("score") == s, F.col("area"))).alias(s) for s in scores])


def pipeline(one: DataFrame) -> DataFrame:
    """Of ``healthy, sources, ingested, fetched, complete, tiered, passed, cases``: source health, yield, tag coverage, fixtures."""
    pct = lambda a, b: F.round(F.try_divide(100.0 * F.col(a), F.col(b)), 1)
    failing = F.col("sources") - F.col("healthy")
    health = F.when(failing > 0, "fail").when(F.col("sources") > 0, "pass").otherwise("na")
    parts = [
        records(one, F.lit("pipeline_source_health"), "pipeline", "headline", "live", pct("healthy", "sources"), "x = 100", health),
        records(one, F.lit("pipeline_ingest_yield"), "pipeline", "detail", "live", pct("ingested", "fetched"), "shown", F.lit("na")),
        records(one, F.lit("pipeline_tag_coverage"), "pipeline", "headline", "live", pct("complete", "tiered"), NLP_PASS),
        records(one, F.lit("tag_route_fixtures"), "tagging", "headline", "live", pct("passed", "cases"), "x = 100"),
    ]
    return reduce(DataFrame.unionByName, parts)


def union(producers: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, producers)


def stale(checks: DataFrame, artefacts: Column, live: Column) -> DataFrame:
    """Headline checks from artefacts older than the live index: stale, and a pass is a warning."""
    old = F.coalesce(artefacts < live, F.lit(False)) & (F.col("freshness") == "offline") & (F.col("tier") == "headline")
    status = labels.staled(F.col("status"), F.col("freshness"), F.col("tier"), artefacts, live)
    return checks.withColumns({"status": status, "freshness": F.when(old, "stale").otherwise(F.col("freshness"))})


def summary(checks: DataFrame) -> DataFrame:
    """Tallies of all checks and of the headline ones that apply, each with its overall status; with none to tell of, a warning."""
    head = (F.col("tier") == "headline") & (F.col("status") != "na")
    of = lambda s: F.col("status") == s
    one = checks.agg(
        F.count("*").alias("total"), *[F.count_if(of(s)).alias(s) for s in ("pass", "fail", "warn", "na")],
        F.count_if(head).alias("headline_total"), *[F.count_if(head & of(s)).alias(f"headline_{s}") for s in ("pass", "fail", "warn")],
    )
    overall = lambda p: F.when(F.col(f"{p}fail") > 0, "fail").when(F.col(f"{p}warn") > 0, "warn").when(F.col(f"{p}pass") > 0, "pass").otherwise("warn")
    return one.withColumns({"overall": overall(""), "headline_overall": overall("headline_")})


def tiles(summary: DataFrame, figures: DataFrame, routes: int) -> DataFrame:
    """Four tiles of a summary and of ``articles, index_days`` (none of them in a fallback, then 0)."""
    one = summary.crossJoin(F.broadcast(figures.agg(F.coalesce(F.max("articles"), F.lit(0)).alias("articles"), F.coalesce(F.max("index_days"), F.lit(0)).alias("index_days"))))  # one row on the right
    tile = lambda k, t, v, s=None: F.struct(F.lit(k).alias("id"), F.lit(t).alias("label"), v.cast("string").alias("value"), (F.lit(None).cast("string") if s is None else s).alias("status"))
    keys = F.concat_ws("/", "headline_pass", "headline_total")
    return one.select(F.inline(F.array(tile("articles", "Articles indexed", F.col("articles")), tile("index_days", "Days of risk data", F.col("index_days")), tile("routes", "Trade routes", F.lit(routes)), tile("checks_passing", "Key checks passing", keys, F.col("headline_overall")))))


def coverage(days: DataFrame, filled: DataFrame, start: str, end: str, lag: int = 90) -> DataFrame:
    """``metric, value, days``: autocorrelation of the observed and the filled series, article counts, and days that are there, missing and expected.

    A correlation needs more than ``lag`` values; ``start`` to ``end``, both included, are the days expected.
    """
    w, expected = timeseries.ordered(), F.datediff(F.lit(end).cast("date"), F.lit(start).cast("date")) + 1
    inside = F.col("day").between(F.lit(start).cast("date"), F.lit(end).cast("date"))

    def lagged(rows: DataFrame, *columns: str) -> DataFrame:
        return rows.where(inside).select("day", "risk_index", *columns).withColumn("p", F.lag("risk_index", lag).over(w))

    auto = lambda: F.when(F.count("risk_index") > lag, stats.correlation("risk_index", "p"))
    n = F.count("*")
    seen = lagged(days.where("risk_index is not null"), "total_articles").agg(
        auto().alias("autocorr_observed"), F.avg("total_articles").alias("articles_mean"), F.stddev_samp("total_articles").alias("articles_std"),
        F.min("total_articles").alias("articles_min"), F.max("total_articles").alias("articles_max"), n.alias("observed_days"), (expected - n).alias("missing_days"), expected.alias("expected_days"),
    )
    whole = lagged(filled.where("risk_index is not null")).agg(auto().alias("autocorr_filled"), n.alias("filled_days"))
    one = seen.crossJoin(F.broadcast(whole))  # one row each
    of = {"autocorr_observed": "observed_days", "autocorr_filled": "filled_days", **{f"articles_{k}": "observed_days" for k in ("mean", "std", "min", "max")}, "missing_days": "missing_days", "observed_days": "expected_days", "expected_days": "expected_days"}
    parts = [F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"), F.col(d).cast("long").alias("days")) for m, d in of.items()]
    return one.select(F.inline(F.array(*parts)))
