"""Queries of the validation report, coverage, calibration reports and the full feature matrix."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import text
from ..operators import feed, gaps, routes, signal, tables, tagging, timeseries, validation
from ..sources import shared, writers
from . import articles as A
from .registry import query
from .reports import CORRIDOR_EVENTS
from .risk import BENCH_SQL, FILL_DAYS, INDEX_SQL, OBSERVED_SQL, RISK_SQL, W, bench, indexed, r6
from .series import LEVEL_SQL, LR_SQL, VOL, _ahead, _full
from .texts import FIXTURES, _sets

# --- the report

INDEX_EVENTS = (("2024-01-14", "First event"), ("2024-01-26", "second: event!"), ("2025-06-01", "Out of range"))
_rest = INDEX_SQL[len(A.SCORED_SQL) + 1 :].lstrip(", \n") + ", " + OBSERVED_SQL[len(INDEX_SQL) + 1 :].lstrip(", \n")
_week = "event_time > (SELECT max(event_time) FROM scored) - INTERVAL 7 DAY"
_near, _prior = "p.day BETWEEN d - 3 AND d + 3", "p.day BETWEEN d - 30 AND d - 4"
_z = f"avg(v) FILTER (WHERE {_near}) AS m, avg(v) FILTER (WHERE {_prior}) AS b, stddev_samp(v) FILTER (WHERE {_prior}) AS s, count(*) FILTER (WHERE {_prior}) AS n"
_slug = "substr(regexp_replace(regexp_replace(lower(label), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 40)"
_index_events = ", ".join(f"(DATE '{d}', '{n}')" for d, n in INDEX_EVENTS)
_route_events = ", ".join(f"(DATE '{d}', '{r}', '{n}')" for d, r, n in CORRIDOR_EVENTS)
_figures = {"mean": "avg(v)", "std": "stddev_samp(v)", "skewness": "skewness(v)", "p01": "quantile_cont(v, 0.01)", "p25": "quantile_cont(v, 0.25)", "median": "median(v)", "p75": "quantile_cont(v, 0.75)", "p99": "quantile_cont(v, 0.99)", "autocorr_lag1": "corr(v, p1)", "autocorr_lag90": "corr(v, p90)", "positive_share": "avg(positive_share)"}
_lag = f"CASE WHEN (SELECT max(day) - min(day) + 1 FROM indexed) >= {validation.LONG_SAMPLE} THEN metric <> 'autocorr_lag1' ELSE metric <> 'autocorr_lag90' END"
_stats = " UNION ALL ".join(f"SELECT '{m}' AS metric, x, coalesce({validation.PROPERTIES[m]}, FALSE) AS ok FROM (SELECT {sql} AS x FROM lagged)" for m, sql in _figures.items())
_pairs = {"raw_daily": ("risk_index", "b"), "ma30": ("ma30", "b30"), "ma7": ("ma7", "b7")}
_compared = " UNION ALL ".join(f"SELECT '{k}' AS comparison, corr({x}, {y}) AS r, count(*) FILTER (WHERE {x} IS NOT NULL AND {y} IS NOT NULL) AS n FROM indexed JOIN theirs USING (day)" for k, (x, y) in _pairs.items())
_tier = "CASE comparison " + " ".join(f"WHEN '{k}' THEN '{t}'" for k, t in validation.BENCHMARK_TIERS.items()) + " END"
_rule = lambda cond: f"CASE WHEN x IS NULL THEN 'na' WHEN {cond} THEN 'pass' ELSE 'fail' END"
_rv22 = f"{_full(VOL, 'lr', 22, 'stddev_samp')}"
FACTS_SQL = f"""seen AS (SELECT s.id, any_value(k) AS k, coalesce(list(route) FILTER (WHERE route IS NOT NULL), []) AS found FROM scored s LEFT JOIN tagged t ON t.id = s.id GROUP BY s.id),
runs AS (SELECT user_id % 20 AS feed, event_time AS at_, event_type <> 'error' AS good FROM scored), feeds AS (SELECT feed, max(at_) FILTER (WHERE good) AS ls FROM runs GROUP BY feed),
facts AS (SELECT count(*) AS articles, count(*) FILTER (WHERE user_id % 3 <> 0) AS tiered, count(*) FILTER (WHERE user_id % 3 <> 0 AND event_type <> 'view') AS complete, count(*) FILTER (WHERE {_week}) AS fetched, count(*) FILTER (WHERE {_week} AND event_type <> 'error') AS ingested,
  (SELECT count(*) FROM seen WHERE list_has_all(found, {_sets(0)}) AND NOT list_has_any(found, {_sets(1)})) AS passed, (SELECT count(*) FROM feeds) AS sources,
  (SELECT count(*) FROM feeds f WHERE NOT EXISTS (SELECT 1 FROM runs r WHERE r.feed = f.feed AND NOT good AND (ls IS NULL OR at_ > ls))) AS healthy FROM scored)"""
AREAS_SQL = f"""{LR_SQL}, {LEVEL_SQL}, mk0 AS (SELECT day, {_rv22} AS rv, {_ahead(VOL, 'lr', 5, 'stddev_samp')} AS fv FROM lr_), mk1 AS (SELECT day, rv, fv, v FROM mk0 JOIN lev USING (day) WHERE rv IS NOT NULL AND fv IS NOT NULL),
mk2 AS (SELECT rv AS a, percent_rank() OVER (ORDER BY rv) + percent_rank() OVER (ORDER BY v) AS b, fv >= (SELECT quantile_cont(fv, 0.75) FROM mk1) AS l FROM mk1),
mk3 AS (SELECT l, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2 AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2 AS rb FROM mk2),
areas AS (SELECT round((sum(ra) FILTER (WHERE l) - p * (p + 1) / 2) / (p * n), 3)::DOUBLE AS a, round((sum(rb) FILTER (WHERE l) - p * (p + 1) / 2) / (p * n), 3)::DOUBLE AS b FROM mk3, (SELECT count(*) FILTER (WHERE l) AS p, count(*) FILTER (WHERE NOT l) AS n FROM mk3) GROUP BY p, n)"""
OFFLINE_SQL = f"""{RISK_SQL}, {_rest}, {BENCH_SQL}, theirs AS (SELECT day, bench AS b, avg(bench) OVER (ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS b7, avg(bench) OVER (ORDER BY day ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS b30 FROM bench),
lagged AS (SELECT risk_index AS v, positive_share, lag(risk_index) OVER (ORDER BY day) AS p1, lag(risk_index, 90) OVER (ORDER BY day) AS p90 FROM indexed), props AS ({_stats}), compared AS ({_compared}),
ie AS (SELECT * FROM (VALUES {_index_events}) AS t(d, label)), iz AS (SELECT label, {_z} FROM ie JOIN (SELECT day, risk_index AS v FROM indexed) p ON {_near} OR {_prior} GROUP BY label),
re AS (SELECT * FROM (VALUES {_route_events}) AS t(d, target, label)), rz0 AS (SELECT label, target, route, {_z} FROM re JOIN (SELECT day, route, threat_index AS v FROM route_days) p ON {_near} OR {_prior} GROUP BY label, target, route),
rz AS (SELECT label, max(z) FILTER (WHERE route = target) AS z, max(z) FILTER (WHERE route <> target) AS other FROM (SELECT *, CASE WHEN n >= 2 AND s > 0 THEN (m - b) / s END AS z FROM rz0) GROUP BY label),
leaks AS (SELECT route, coalesce(CASE WHEN stddev_pop(threat_index) > 0 THEN abs(corr(threat_index, risk_index)) <= {validation.LEAKAGE} END, TRUE) AS ok FROM route_days JOIN (SELECT day, risk_index FROM indexed) USING (day) GROUP BY route),
offline AS (SELECT 'index_benchmark_' || comparison AS id, 'index' AS category, {_tier} AS tier, 'offline' AS freshness, r AS value, CASE WHEN coalesce(r > 0.5, FALSE) THEN 'pass' ELSE 'fail' END AS status FROM compared WHERE n >= 30
 UNION ALL SELECT 'index_stat_' || metric, 'index', 'detail', 'offline', x, CASE WHEN ok THEN 'pass' ELSE 'fail' END FROM props WHERE {_lag}
 UNION ALL SELECT 'index_event_spike_' || {_slug}, 'index', 'detail', 'offline', x, {_rule('x > 1')} FROM (SELECT label, CASE WHEN n >= 2 AND s > 0 THEN (m - b) / s END AS x FROM ie LEFT JOIN iz USING (label))
 UNION ALL SELECT 'index_gap_imputation', 'index', 'informational', 'offline', n, 'pass' FROM (SELECT count(*) AS n FROM rows_ WHERE is_imputed) WHERE n > 0
 UNION ALL SELECT 'route_parent_leakage', 'route', 'headline', 'offline', x, {_rule('x = 100')} FROM (SELECT 100.0 * count(*) FILTER (WHERE ok) / count(*) AS x FROM leaks HAVING count(*) > 0)
 UNION ALL SELECT 'route_event_' || {_slug}, 'route', 'detail', 'offline', x, {_rule('x > 1')} FROM (SELECT label, z AS x FROM re LEFT JOIN rz USING (label))
 UNION ALL SELECT 'route_lead_' || {_slug}, 'route', 'detail', 'offline', x, {_rule('x > 0')} FROM (SELECT label, round(z - other, 9) AS x FROM re LEFT JOIN rz USING (label)))"""
REPORT_SQL = f"""{OFFLINE_SQL}, {FACTS_SQL}, {AREAS_SQL}, report AS (SELECT * FROM offline
 UNION ALL SELECT 'market_vol_market_only', 'market', 'informational', 'live', a, 'na' FROM areas UNION ALL SELECT 'market_vol_market_plus_index', 'market', 'informational', 'live', b, 'na' FROM areas
 UNION ALL SELECT 'market_vol_index_adds', 'market', 'headline', 'live', round(b - a, 3), CASE WHEN b > a THEN 'pass' WHEN b - a IS NOT NULL THEN 'warn' ELSE 'na' END FROM areas
 UNION ALL SELECT 'pipeline_source_health', 'pipeline', 'headline', 'live', round(100.0 * healthy / sources, 1)::DOUBLE, CASE WHEN healthy < sources THEN 'fail' WHEN sources > 0 THEN 'pass' ELSE 'na' END FROM facts
 UNION ALL SELECT 'pipeline_ingest_yield', 'pipeline', 'detail', 'live', round(100.0 * ingested / fetched, 1)::DOUBLE, 'na' FROM facts
 UNION ALL SELECT 'pipeline_tag_coverage', 'pipeline', 'headline', 'live', x, {_rule('x >= 95')} FROM (SELECT round(100.0 * complete / tiered, 1)::DOUBLE AS x FROM facts)
 UNION ALL SELECT 'tag_route_fixtures', 'tagging', 'headline', 'live', x, {_rule('x = 100')} FROM (SELECT round(100.0 * passed / articles, 1)::DOUBLE AS x FROM facts))"""
_shown = "id, category, tier, freshness, round(CAST(value AS DOUBLE) + 1e-9, 6) AS value, status"
ARTEFACT_DAY = "2024-01-20"
_old = f"DATE '{ARTEFACT_DAY}' < (SELECT max(day) FROM indexed) AND freshness = 'offline' AND tier = 'headline'"
STALE_SQL = f"staled AS (SELECT id, tier, CASE WHEN {_old} THEN 'stale' ELSE freshness END AS freshness, CASE WHEN {_old} AND status = 'pass' THEN 'warn' ELSE status END AS status FROM report)"


def _overall(p: str) -> str:
    return f"CASE WHEN {p}fail > 0 THEN 'fail' WHEN {p}warn > 0 THEN 'warn' WHEN {p}pass > 0 THEN 'pass' ELSE 'warn' END AS {p}overall"


def _summary(source: str) -> str:
    head = "tier = 'headline' AND status <> 'na'"
    counts = [f"count(*) FILTER (WHERE status = '{s}') AS {s}" for s in ("pass", "fail", "warn", "na")] + [f"count(*) FILTER (WHERE {head}) AS headline_total"]
    counts += [f"count(*) FILTER (WHERE {head} AND status = '{s}') AS headline_{s}" for s in ("pass", "fail", "warn")]
    return f"tallied AS (SELECT count(*) AS total, {', '.join(counts)} FROM {source}), summed AS (SELECT *, {_overall('')}, {_overall('headline_')} FROM tallied)"


class Inputs:
    """What the producers read: the day series, made once and cut, and one-row figures."""

    def __init__(self, spark, sf_dir):
        self.index = shared.cut(indexed(spark, sf_dir).select("day", "total_articles", "positive_share", "risk_index", "acts_index", "ma7", "ma30"))
        members = routes.registry(spark)
        panel = routes.normalise(routes.panel(A.routed(spark, sf_dir), members), members, A.BASE_START, A.BASE_END)
        self.panel = shared.cut(panel.select("day", "route", "threat_index"))
        self.spark, self.sf_dir = spark, sf_dir

    def offline(self) -> list:
        spark = self.spark
        events = spark.createDataFrame(list(INDEX_EVENTS), "d string, label string").select(F.to_date("d").alias("event_day"), "label")
        on_routes = spark.createDataFrame(list(CORRIDOR_EVENTS), "d string, r string, label string").select(F.to_date("d").alias("event_day"), F.col("r").alias("event_route"), "label")
        observed = self.index.select("day", "risk_index", "acts_index").where(FILL_DAYS.replace("DATE '", "date'"))
        filled = gaps.fill(observed, "2024-01-01", "2024-01-31", "forward", ["risk_index", "acts_index"])
        return [
            validation.benchmark_checks(validation.benchmark(self.index, bench(spark, self.sf_dir))), validation.properties(self.index), validation.event_spikes(self.index, events), validation.imputation(filled),
            validation.leakage_check(validation.leakage(self.panel, self.index)), validation.route_event_checks(validation.route_events(self.panel, on_routes)),
        ]

    def areas(self):
        """How well trailing volatility, alone and with the index, ranks the days of high volatility ahead (``vol_experiment`` fits trees)."""
        market = signal.returns(A.daily_prices(self.spark, self.sf_dir)).select("day", signal.realized_vol(22).alias("rv"), signal.forward_vol(5).alias("fv"))
        levels = A.table(self.spark, self.sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg((F.count("*") * 10.0).alias("v"))
        rows = market.join(levels, "day").where("rv is not null and fv is not null")
        high = rows.agg(F.percentile("fv", F.lit(0.75)).alias("q"))
        both = F.percent_rank().over(timeseries.ordered(by="rv")) + F.percent_rank().over(timeseries.ordered(by="v"))
        ranked = rows.crossJoin(high).select(F.col("rv").alias("market_only"), both.alias("market_plus_index"), (F.col("fv") >= F.col("q")).cast("int").alias("l"))  # one row on the right
        return validation.rank_areas(ranked, ("market_only", "market_plus_index"), "l").withColumn("live", F.lit(True))

    def facts(self):
        a = A.routed(self.spark, self.sf_dir)
        k, tiered = F.col("k") % 5, F.col("user_id") % 3 != 0
        listed = lambda n: A.cases(k, [(i, text.strings(f[n]) if f[n] else F.array().cast("array<string>")) for i, f in enumerate(FIXTURES)])
        passed = feed.label_sets(listed(0), listed(1), text.masked_routes(F.col("routes")))
        last = a.agg(F.max("event_time").alias("last"))
        week = F.col("event_time") > F.col("last") - F.expr("INTERVAL 7 DAYS")
        one = a.crossJoin(F.broadcast(last)).agg(  # one row on the right
            F.count("*").alias("articles"), F.count_if(tiered).alias("tiered"), F.count_if(tiered & (F.col("event_type") != "view")).alias("complete"),
            F.count_if(week).alias("fetched"), F.count_if(week & (F.col("event_type") != "error")).alias("ingested"), F.count_if(passed).alias("passed"), F.count("*").alias("cases"),
        )
        runs = A.articles(self.spark, self.sf_dir).select((F.col("user_id") % 20).alias("feed"), F.col("event_time").alias("at"), (F.col("event_type") != "error").alias("ok"))
        health = tables.health(runs).agg(F.count("*").alias("sources"), F.count_if(F.col("failures") == 0).alias("healthy"))
        return one.crossJoin(F.broadcast(health))  # one row each

    def report(self, facts=None):
        return validation.union([*self.offline(), validation.market(self.areas()), validation.pipeline(self.facts() if facts is None else facts)])


def _columns(checks):
    return checks.select("id", "category", "tier", "freshness", *r6("value"), "status")


@query(f"{W}{REPORT_SQL} SELECT {_shown} FROM report")
def validation_report(spark, sf_dir):
    """Every producer's checks: benchmark, properties, event spikes, imputation, leakage, route events, discrimination, market, pipeline, fixtures."""
    return _columns(Inputs(spark, sf_dir).report())


@query(f"{W}{REPORT_SQL}, {STALE_SQL}, {_summary('staled')} SELECT * FROM summed")
def validation_summary(spark, sf_dir):
    """Tallies once checks from artefacts older than the live index are stale."""
    got = Inputs(spark, sf_dir)
    live = got.index.agg(F.max("day").alias("live"))
    checks = got.report().crossJoin(F.broadcast(live))  # one row on the right
    return validation.summary(validation.stale(checks, F.lit(ARTEFACT_DAY).cast("date"), F.col("live")))


_tiles = f"SELECT 'articles' AS id, 'Articles indexed' AS label, CAST((SELECT articles FROM facts) AS VARCHAR) AS value, NULL AS status UNION ALL SELECT 'index_days', 'Days of risk data', CAST((SELECT count(*) FROM indexed) AS VARCHAR), NULL UNION ALL SELECT 'routes', 'Trade routes', '{len(C.ROUTES)}', NULL UNION ALL SELECT 'checks_passing', 'Key checks passing', headline_pass || '/' || headline_total, headline_overall FROM summed"


@query(f"{W}{REPORT_SQL}, {_summary('report')} {_tiles}")
def coverage_tiles(spark, sf_dir):
    got = Inputs(spark, sf_dir)
    facts = got.facts()
    figures = facts.select("articles").crossJoin(F.broadcast(got.index.agg(F.count("*").alias("index_days"))))  # one row each
    return validation.tiles(validation.summary(got.report(facts)), figures, len(C.ROUTES))


@query(f"{W}{OFFLINE_SQL}, {_summary('offline')} SELECT 'check' AS kind, id, status FROM offline UNION ALL SELECT 'tile', id, value FROM ({_tiles.replace('(SELECT articles FROM facts)', '0').replace('(SELECT count(*) FROM indexed)', '0')})")
def fallback_report(spark, sf_dir):
    """The report when live figures can't be had: offline checks, and tiles of zeros."""
    checks = validation.union(Inputs(spark, sf_dir).offline())
    none = spark.createDataFrame([], "articles long, index_days long")
    shown = validation.tiles(validation.summary(checks), none, len(C.ROUTES))
    return checks.select(F.lit("check").alias("kind"), "id", "status").unionByName(shown.select(F.lit("tile").alias("kind"), "id", F.col("value").alias("status")))


@query(f"""{W}{OFFLINE_SQL}, {FACTS_SQL}, {AREAS_SQL} SELECT 'ingestion' AS block, round(100.0 * ingested / fetched, 1)::DOUBLE AS first, sources::DOUBLE AS second FROM facts
 UNION ALL SELECT 'tagging', round(100.0 * complete / tiered, 1)::DOUBLE, (tiered - complete)::DOUBLE FROM facts UNION ALL SELECT 'index', (SELECT round(r, 3) FROM compared WHERE comparison = 'ma30' AND n >= 30), (SELECT n::DOUBLE FROM compared WHERE comparison = 'ma30' AND n >= 30)
 UNION ALL SELECT 'routes', round(100.0 * count(*) FILTER (WHERE ok) / count(*), 1)::DOUBLE, count(*)::DOUBLE FROM leaks UNION ALL SELECT 'volatility', a, round(b - a, 3) FROM areas""")
def accuracy_bundle(spark, sf_dir):
    """Five blocks of figures as JSON payloads, two figures of each read back."""
    got = Inputs(spark, sf_dir)
    facts, pct = shared.cut(got.facts()), lambda a, b: F.round(F.try_divide(100.0 * F.col(a), F.col(b)), 1)
    ma30 = validation.benchmark(got.index, bench(spark, sf_dir)).agg(F.max(F.when(F.col("comparison") == "ma30", F.round("r", 3))).alias("first"), F.max(F.when(F.col("comparison") == "ma30", F.col("overlap"))).alias("second"))
    leaks = validation.leakage(got.panel, got.index).agg(F.round(100.0 * F.count_if("ok") / F.count("*"), 1).alias("first"), F.count("*").alias("second"))
    areas = got.areas().select(F.round("market_only", 3).alias("first"), F.round(F.round("market_plus_index", 3) - F.round("market_only", 3), 3).alias("second"))
    blocks = {"ingestion": facts.select(pct("ingested", "fetched").alias("first"), F.col("sources").alias("second")), "tagging": facts.select(pct("complete", "tiered").alias("first"), (F.col("tiered") - F.col("complete")).alias("second")), "index": ma30, "routes": leaks, "volatility": areas}
    whole = validation.union([rows.select(F.lit(b).alias("block"), F.col("first").cast("double"), F.col("second").cast("double")) for b, rows in blocks.items()])
    read = lambda c: F.get_json_object("payload", f"$.{c}").cast("double").alias(c)
    return writers.payload(whole, "block").select("block", read("first"), read("second"))


# --- coverage and calibration reports

_span = "DATE '2024-01-01' AND DATE '2024-02-05'"
_lagged = lambda source: f"SELECT *, lag(risk_index, 7) OVER (ORDER BY day) AS p FROM {source} WHERE day BETWEEN {_span} AND risk_index IS NOT NULL"
_cover = {"autocorr_observed": ("CASE WHEN count(*) > 7 THEN corr(risk_index, p) END", "count(*)"), "articles_mean": ("avg(total_articles)", "count(*)"), "articles_std": ("stddev_samp(total_articles)", "count(*)"), "articles_min": ("min(total_articles)", "count(*)"), "articles_max": ("max(total_articles)", "count(*)"), "missing_days": ("36 - count(*)", "36 - count(*)"), "observed_days": ("count(*)", "max(36)"), "expected_days": ("max(36)", "max(36)")}
_cells = " UNION ALL ".join(f"SELECT '{m}' AS metric, round(({v})::DOUBLE + 1e-9, 6) AS value, ({d})::BIGINT AS days FROM o" for m, (v, d) in _cover.items())


@query(f"{W}{INDEX_SQL}, ob AS (SELECT * FROM indexed WHERE {FILL_DAYS}), cal AS (SELECT CAST(unnest(generate_series(DATE '2024-01-01', DATE '2024-02-05', INTERVAL 1 DAY)) AS DATE) AS day), fl AS (SELECT cal.day, last_value(risk_index IGNORE NULLS) OVER (ORDER BY cal.day ROWS UNBOUNDED PRECEDING) AS risk_index FROM cal LEFT JOIN ob ON ob.day = cal.day), o AS ({_lagged('ob')}), f AS ({_lagged('fl')}) {_cells} UNION ALL SELECT 'autocorr_filled', round(CASE WHEN count(*) > 7 THEN corr(risk_index, p) END + 1e-9, 6), count(*) FROM f")
def coverage_report(spark, sf_dir):
    """Observed against expected days, article counts, and the correlation with the week before of the series as observed and as filled."""
    days = shared.cut(indexed(spark, sf_dir).select("day", "risk_index", "total_articles").where(FILL_DAYS.replace("DATE '", "date'")))
    filled = gaps.fill(days.select("day", "risk_index"), "2024-01-01", "2024-02-05", "forward", ["risk_index"])
    return validation.coverage(days, filled, "2024-01-01", "2024-02-05", lag=7).select("metric", *r6("value"), "days")


_tier_codes = {f"tier{i}": codes for i, (codes, _) in enumerate(C.TIER_WEIGHTS, 1)}
_known = ", ".join(f"('{t}', '{c}')" for t, codes in _tier_codes.items() for c in codes)
_any = "t1 + t2 + t3 > 0"


@query(f"""{W}{A.SCORED_SQL}, s AS (SELECT * FROM scored WHERE event_type <> 'purchase'), h AS (SELECT 'tier1' AS tier, count(*) FILTER (WHERE t1 > 0) AS n, count(*) AS total FROM s UNION ALL SELECT 'tier2', count(*) FILTER (WHERE t2 > 0), count(*) FROM s UNION ALL SELECT 'tier3', count(*) FILTER (WHERE t3 > 0), count(*) FROM s UNION ALL SELECT 'any', count(*) FILTER (WHERE {_any}), count(*) FROM s),
c AS (SELECT code, count(*) AS n FROM (SELECT DISTINCT id, trim(unnest(string_split(upper(themes), ';'))) AS code FROM s) GROUP BY code)
SELECT 'tier' AS kind, tier, '' AS code, n, CASE WHEN tier = 'any' THEN n < 30 OR n < 0.1 * total END AS low_coverage FROM h UNION ALL (SELECT 'code', tier, code, n, NULL FROM c JOIN (VALUES {_known}) AS v(tier, code) USING (code) ORDER BY n DESC, tier, code LIMIT 15)""")
def theme_hit_report(spark, sf_dir):
    """Articles by tier with a warning of low coverage, and the most frequent known codes with their tiers."""
    shares, top = tagging.theme_hits(A.articles(spark, sf_dir).where("event_type <> 'purchase'"))
    one = shares.select(F.lit("tier").alias("kind"), "tier", F.lit("").alias("code"), F.col("articles").alias("n"), "low_coverage")
    return one.unionByName(top.select(F.lit("code").alias("kind"), "tier", "code", "n", F.lit(None).cast("boolean").alias("low_coverage")))


_every = ", ".join(f"('{r}', {'TRUE' if r in tagging.SELDOM else 'FALSE'})" for r in C.ROUTES)


@query(f"""{W}{A.ROUTES_SQL}, n AS (SELECT count(*) AS total, count(*) FILTER (WHERE len(list_filter(string_split(locations, ';'), lambda e: starts_with(e, '4#'))) > 0) AS blocks FROM scored), m AS (SELECT route, count(*) AS c FROM tagged GROUP BY route)
SELECT 'route' AS kind, v.route, coalesce(c, 0) AS matches, round(coalesce(c, 0) / total, 6)::DOUBLE AS share, CASE WHEN coalesce(c, 0) > 0 THEN 'pass' WHEN seldom THEN 'seldom' ELSE 'fail' END AS status FROM (VALUES {_every}) AS v(route, seldom) LEFT JOIN m USING (route) CROSS JOIN n
UNION ALL SELECT 'blocks', '', blocks, round(blocks / total, 6)::DOUBLE, CASE WHEN blocks = 0 THEN 'fail' WHEN blocks < 0.01 * total THEN 'warn' ELSE 'pass' END FROM n""")
def route_coverage_report(spark, sf_dir):
    """Matches per route with unexpected zeros, and the share of articles with a place block."""
    has = F.exists(F.split(F.coalesce("locations", F.lit("")), ";"), lambda e: F.startswith(e, F.lit("4#")))
    sums = A.routed(spark, sf_dir).groupBy(F.col("routes").alias("mask"), has.alias("blocks")).agg(F.count("*").alias("n"))
    return tagging.route_coverage(sums).select("kind", "route", "matches", F.round("share", 6).alias("share"), "status")


# --- every feature of a market and of an index with its sub-indices

SUBS = ("bench", "threats", "acts")
MARKET = [f"{k}{n}" for n in signal.WINDOWS for k in ("rv", "ret")] + ["rv_ratio", "drawdown"]
_sub = "lv0 AS (SELECT date_trunc('month', l_shipdate)::DATE AS day, avg(l_quantity) AS bench, avg(l_quantity) FILTER (WHERE l_linestatus = 'O') AS threats, avg(l_discount) * 100 AS acts FROM lineitem GROUP BY 1), lv AS (SELECT day, round(bench, 6) AS bench, round(coalesce(threats, 0), 6) AS threats, round(acts, 6) AS acts FROM lv0)"
_logs = ", ".join(f"ln({c} + 1) AS log_{c}" for c in SUBS)
_per = ", ".join(f"log_{c}, " + ", ".join(_full("", f"log_{c}", n, "avg") + f" AS {c}_ma{n}" for n in (2, 3, 6)) + f", log_{c} - {_full('', f'log_{c}', 3, 'avg')} AS {c}_spike, log_{c} - lag(log_{c}) OVER (ORDER BY day) AS {c}_chg1, log_{c} - lag(log_{c}, 5) OVER (ORDER BY day) AS {c}_chg5" for c in SUBS)
INDEX_COLUMNS = [f for c in SUBS for f in (f"log_{c}", *[f"{c}_ma{n}" for n in (2, 3, 6)], f"{c}_spike", f"{c}_chg1", f"{c}_chg5")] + ["threats_minus_acts"]
_mcols = ", ".join([*(f"{_full(VOL, 'lr', n, 'stddev_samp')} AS rv{n}" for n in signal.WINDOWS), *(f"{_full(' * 100', 'lr', n, 'sum')} AS ret{n}" for n in signal.WINDOWS), f"(close / {_full('', 'close', 252, 'max')} - 1) * 100 AS drawdown", f"{_ahead(VOL, 'lr', 5, 'stddev_samp')} AS target"])


@query(f"{W}{LR_SQL}, {_sub}, lg AS (SELECT day, {_logs} FROM lv), ix AS (SELECT day, {_per}, log_threats - log_acts AS threats_minus_acts FROM lg), mk AS (SELECT *, rv5 / nullif(rv22, 0) AS rv_ratio FROM (SELECT day, {_mcols} FROM lr_)) SELECT mk.day, {', '.join(f'round({c}, 4) AS {c}' for c in (*MARKET, 'target'))}, {', '.join(f'round({c}, 5) AS {c}' for c in INDEX_COLUMNS)} FROM mk ASOF JOIN ix ON mk.day >= ix.day WHERE {' AND '.join(f'{c} IS NOT NULL' for c in (*MARKET, 'target', *INDEX_COLUMNS))}")
def full_features(spark, sf_dir):
    """Both blocks in full: eight market features, and seven of each of a monthly index and its two sub-indices, carried to trading days, with their balance."""
    monthly = A.table(spark, sf_dir, "lineitem").groupBy(F.trunc(F.to_date("l_shipdate"), "MM").alias("day"))
    level = monthly.agg(F.avg("l_quantity").alias("bench"), F.coalesce(F.avg(F.when(F.col("l_linestatus") == "O", F.col("l_quantity"))), F.lit(0.0)).alias("threats"), (F.avg("l_discount") * 100).alias("acts"))
    index = signal.balanced(signal.index_features(level.select("day", *[F.round(c, 6).alias(c) for c in SUBS]), SUBS, (2, 3, 6)), "threats", "acts")
    market = signal.market_features(A.daily_prices(spark, sf_dir)).withColumn("target", signal.forward_vol(5))
    out = signal.assemble(market.select("day", *MARKET, "target"), index, INDEX_COLUMNS, "target").na.drop(subset=MARKET)
    return out.select("day", *[F.round(c, 4).alias(c) for c in (*MARKET, "target")], *[F.round(c, 5).alias(c) for c in INDEX_COLUMNS])
