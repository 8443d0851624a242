"""The validation report's producers on small series, and what happens at their edges."""

import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskloom.operators import signal, tagging, validation

DAY = datetime.date(2024, 1, 1)


def series(spark, values, share=0.2):
    rows = [(DAY + datetime.timedelta(days=i), None if v is None else float(v), share, float(10 + i), i + 5) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "day date, risk_index double, positive_share double, ma7 double, total_articles long").withColumn("ma30", F.col("ma7") * 2)


def status(checks):
    return {r["id"]: r["status"] for r in checks.collect()}


@pytest.mark.parametrize("n,lag", [(60, 1), (1100, 90)])
def test_properties_equal_pandas_and_choose_the_lag_by_the_span(spark, n, lag):
    x = pd.Series(100 + 40 * np.sin(np.arange(n) / 9) + np.random.default_rng(n).normal(0, 5, n))
    got = {r["id"].removeprefix("index_stat_"): r for r in validation.properties(series(spark, x)).collect()}
    wanted = {"mean": x.mean(), "std": x.std(), "skewness": x.skew(), "p01": x.quantile(0.01), "p75": x.quantile(0.75), f"autocorr_lag{lag}": x.autocorr(lag), "positive_share": 0.2}
    for k, v in wanted.items():
        assert got[k]["value"] == pytest.approx(v, abs=1e-9)
    assert f"autocorr_lag{91 - lag}" not in got and len(got) == 10
    assert got["mean"]["status"] == "pass" and got["p99"]["status"] == "fail"


def test_properties_of_nothing_fail(spark):
    assert set(status(validation.properties(series(spark, []).limit(0))).values()) == {"fail"}
    assert status(validation.properties(series(spark, [None, 5.0])))["index_stat_std"] == "fail"


def test_benchmark_needs_enough_common_days(spark):
    days = series(spark, range(40))
    bench = days.select("day", (F.col("risk_index") * 3 + 1).alias("bench"), F.lit("x").alias("risk_index_2"))
    found = status(validation.benchmark_checks(validation.benchmark(days, bench)))
    assert found == {f"index_benchmark_{k}": "pass" for k in ("raw_daily", "ma30", "ma7")}
    assert validation.benchmark(days, bench.limit(29)).count() == 0
    flat = bench.withColumn("bench", F.lit(1.0))
    assert set(status(validation.benchmark_checks(validation.benchmark(days, flat))).values()) == {"fail"}


def test_events_out_of_range_do_not_apply(spark):
    days = series(spark, [10 + i % 3 for i in range(20)] + [60] * 10)
    events = spark.createDataFrame([(datetime.date(2024, 1, 24), "A  Shock!"), (datetime.date(2030, 1, 1), "later")], "event_day date, label string")
    assert status(validation.event_spikes(days, events)) == {"index_event_spike_a_shock": "pass", "index_event_spike_later": "na"}


def test_route_events_leads_and_leakage(spark):
    quiet, loud = [1 + i % 3 for i in range(30)], [1 + i % 3 for i in range(20)] + [50] * 10
    panel = series(spark, quiet).select("day", F.lit("a").alias("route"), F.col("risk_index").alias("threat_index")).unionByName(
        series(spark, loud).select("day", F.lit("b").alias("route"), F.col("risk_index").alias("threat_index")))
    events = spark.createDataFrame([(datetime.date(2024, 1, 24), "b", "hit"), (datetime.date(2024, 1, 24), "a", "miss"), (datetime.date(2024, 1, 24), "none", "gone")], "event_day date, event_route string, label string")
    assert status(validation.route_event_checks(validation.route_events(panel, events))) == {
        "route_event_hit": "pass", "route_lead_hit": "pass", "route_event_miss": "fail", "route_lead_miss": "fail", "route_event_gone": "na", "route_lead_gone": "na"}
    found = {r["route"]: r["ok"] for r in validation.leakage(panel, series(spark, loud)).collect()}
    assert found == {"a": True, "b": False}
    one = validation.leakage_check(validation.leakage(panel, series(spark, loud))).first()
    assert one["value"] == 50.0 and one["status"] == "fail"
    assert validation.leakage_check(validation.leakage(panel.limit(0), series(spark, loud))).count() == 0


def test_market_figures_that_are_not_live_are_only_shown(spark):
    one = lambda live, a, b: validation.market(spark.createDataFrame([(a, b, live)], "market_only double, market_plus_index double, live boolean"))
    assert status(one(False, 0.83, 0.815))["market_vol_index_adds"] == "na"
    assert status(one(True, 0.83, 0.815))["market_vol_index_adds"] == "warn"
    assert status(one(True, 0.8, 0.815))["market_vol_index_adds"] == "pass"
    assert status(one(True, None, 0.815))["market_vol_index_adds"] == "na"


def test_rank_areas_equal_pairs_counted_by_hand(spark):
    rng = np.random.default_rng(1)
    rows = [(float(a), float(b), int(l)) for a, b, l in zip(rng.integers(0, 6, 80), rng.normal(size=80), rng.integers(0, 2, 80))]
    got = validation.rank_areas(spark.createDataFrame(rows, "a double, b double, l int"), ("a", "b"), "l").first()
    for i, name in enumerate("ab"):
        pairs = [(x[i] > y[i]) + (x[i] == y[i]) / 2 for x in rows if x[2] for y in rows if not y[2]]
        assert got[name] == pytest.approx(sum(pairs) / len(pairs))
    assert validation.rank_areas(spark.createDataFrame([], "a double, l int"), ("a",), "l").first()["a"] is None


def test_pipeline_without_anything_does_not_apply(spark):
    fields = "healthy sources ingested fetched complete tiered passed cases".split()
    none = spark.createDataFrame([[0] * 8], ", ".join(f"{f} long" for f in fields))
    assert set(status(validation.pipeline(none)).values()) == {"na"}
    some = spark.createDataFrame([[3, 4, 1, 2, 96, 100, 5, 5]], ", ".join(f"{f} long" for f in fields))
    assert status(validation.pipeline(some)) == {"pipeline_source_health": "fail", "pipeline_ingest_yield": "na", "pipeline_tag_coverage": "pass", "tag_route_fixtures": "pass"}


def test_stale_headlines_warn_and_tallies(spark):
    rows = [("a", "x", "headline", "offline", 1.0, "", "pass"), ("b", "x", "detail", "offline", 1.0, "", "pass"), ("c", "x", "headline", "live", 1.0, "", "pass"), ("d", "x", "headline", "offline", None, "", "na")]
    checks = spark.createDataFrame(rows, "id string, category string, tier string, freshness string, value double, threshold string, status string")
    at = lambda d: F.lit(d).cast("date")
    old = validation.stale(checks, at("2024-01-01"), at("2024-01-02"))
    assert status(old) == {"a": "warn", "b": "pass", "c": "pass", "d": "na"}
    assert {r["id"] for r in old.where("freshness = 'stale'").collect()} == {"a", "d"}
    assert status(validation.stale(checks, F.lit(None).cast("date"), at("2024-01-02"))) == status(checks)
    told = validation.summary(old).first()
    assert (told["total"], told["warn"], told["headline_total"], told["headline_pass"], told["overall"]) == (4, 1, 2, 1, "warn")
    none = validation.summary(checks.limit(0))
    assert none.first()["overall"] == "warn" and none.first()["headline_overall"] == "warn"
    shown = validation.tiles(none, spark.createDataFrame([], "articles long, index_days long"), 12)
    assert {r["id"]: r["value"] for r in shown.collect()} == {"articles": "0", "index_days": "0", "routes": "12", "checks_passing": "0/0"}


def test_coverage_of_long_and_short_series(spark):
    x = pd.Series(np.random.default_rng(3).normal(size=120).cumsum())
    days = series(spark, x)
    got = {r["metric"]: (r["value"], r["days"]) for r in validation.coverage(days.where("day <> '2024-02-01'"), days, "2024-01-01", "2024-04-29").collect()}
    assert got["autocorr_filled"][0] == pytest.approx(x.autocorr(90)) and got["observed_days"] == (119.0, 120) and got["missing_days"] == (1.0, 1)
    short = {r["metric"]: r["value"] for r in validation.coverage(days, days, "2024-01-01", "2024-01-31").collect()}
    assert short["autocorr_observed"] is None and short["observed_days"] == 31.0
    empty = {r["metric"]: r["value"] for r in validation.coverage(days.limit(0), days.limit(0), "2024-01-01", "2024-01-31").collect()}
    assert empty["observed_days"] == 0.0 and empty["missing_days"] == 31.0 and empty["articles_mean"] is None


def test_theme_hits_warn_of_low_coverage(spark):
    rows = [(i, "terror;TERROR; x" if i < 35 else None) for i in range(400)]
    shares, top = tagging.theme_hits(spark.createDataFrame(rows, "id long, themes string"))
    found = {r["tier"]: (r["articles"], r["low_coverage"]) for r in shares.collect()}
    assert found == {"tier1": (0, None), "tier2": (35, None), "tier3": (0, None), "any": (35, True)}
    assert [tuple(r) for r in top.collect()] == [("tier2", "TERROR", 35)]
    shares, top = tagging.theme_hits(spark.createDataFrame(rows[:100], "id long, themes string"))
    assert shares.where("tier = 'any'").first()["low_coverage"] is False
    assert tagging.theme_hits(spark.createDataFrame([], "themes string"))[1].count() == 0


def test_route_coverage_tells_seldom_routes_from_lost_ones(spark):
    schema = "mask long, blocks boolean, n long"
    rows = spark.createDataFrame([(0b11, True, 1), (0b1, False, 299)], schema)
    found = {(r["kind"], r["route"]): (r["matches"], r["status"]) for r in tagging.route_coverage(rows).collect()}
    assert found["route", "strait_of_hormuz"] == (300, "pass") and found["route", "red_sea_suez"] == (1, "pass")
    assert found["route", "strait_of_malacca"] == (0, "fail") and found["route", "imec"] == (0, "seldom") and found["blocks", ""] == (1, "warn")
    noted = {r["route"]: r["status"] for r in tagging.route_coverage(rows, advisory=True).collect()}
    assert noted["strait_of_malacca"] == "note" and noted[""] == "note"
    assert tagging.route_coverage(spark.createDataFrame([], schema)).count() == 0


def test_features_equal_pandas(spark):
    x = pd.Series(np.abs(np.random.default_rng(5).normal(100, 30, 90)))
    days = series(spark, x).select("day", F.col("risk_index").alias("threats"), (F.col("risk_index") / 2).alias("acts"))
    got = signal.balanced(signal.index_features(days, ["threats", "acts"]), "threats", "acts").orderBy("day").toPandas()
    s = np.log1p(x)
    for name, wanted in {"threats_ma66": s.rolling(66).mean(), "threats_spike": s - s.rolling(22).mean(), "threats_chg5": s.diff(5), "threats_minus_acts": s - np.log1p(x / 2)}.items():
        np.testing.assert_allclose(got[name].astype(float), wanted, atol=1e-9)
