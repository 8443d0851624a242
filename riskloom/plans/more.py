"""Queries of the remaining rules: reprocessing, precedence, labels, calibration, payloads."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import bands, labels, text
from ..functions import constants as C
from ..operators import gaps, rollup, routes, scoring, tables, timeseries
from . import articles as A
from .registry import query
from .risk import DAYS_SQL, INDEX_SQL, OBSERVED_SQL, RISK_SQL, W, days, index_sql, indexed, observed, r6, route_days, s6


@query(f"{W}{INDEX_SQL}, again AS (SELECT day, risk_sum / total_articles AS raw_ratio, coalesce(risk_sum / total_articles * (acts_index / nullif(risk_index, 0)), risk_sum / total_articles) AS acts_ratio FROM indexed),\n{index_sql('again', (('raw_ratio', 'risk_again'), ('acts_ratio', 'acts_again')), chr(39) + 'all' + chr(39)).replace('indexed AS', 'twice AS').replace('e0', 'x0').replace('a0', 'xa0').replace('b0', 'xb0').replace('c0', 'xc0').replace('d0', 'xd0').replace('f0', 'xf0').replace('a1', 'xa1').replace('b1', 'xb1').replace('c1', 'xc1').replace('d1', 'xd1').replace('f1', 'xf1')} SELECT day, round(risk_again, 6) AS risk_again, round(acts_again, 6) AS acts_again FROM twice")
def reprocess_index(spark, sf_dir):
    """Indices once more from saved sums and sub-indices, without scoring."""
    raw = F.col("risk_sum") / F.col("total_articles")
    acts = F.coalesce(raw * F.try_divide(F.col("acts_index"), F.nullif(F.col("risk_index"), F.lit(0.0))), raw)
    again = indexed(spark, sf_dir).select("day", raw.alias("raw_ratio"), acts.alias("acts_ratio"))
    out = timeseries.index_series(again, A.BASE_START, A.BASE_END, ratios=(("raw_ratio", "risk_again"), ("acts_ratio", "acts_again")))
    return out.select("day", F.round("risk_again", 6).alias("risk_again"), F.round("acts_again", 6).alias("acts_again"))


@query(f"{W}{OBSERVED_SQL} SELECT strftime(day, '%Y-%m') AS year_month, round(avg(risk_index) + 1e-9, 6) AS risk_index, count(*) FILTER (WHERE is_imputed) AS imputed_days, count(*) AS total_days FROM (SELECT day, is_imputed, last_value(risk_index IGNORE NULLS) OVER (ORDER BY day ROWS UNBOUNDED PRECEDING) AS risk_index FROM rows_) GROUP BY 1")
def monthly_continuous(spark, sf_dir):
    rows = gaps.fill(observed(spark, sf_dir), "2024-01-01", "2024-01-31", "forward", ["risk_index"])
    return rollup.monthly(rows, "risk_index").select("year_month", *r6("risk_index"), "imputed_days", "total_days")


@query(f"{W}{OBSERVED_SQL} SELECT day FROM rows_ WHERE is_imputed AND day < DATE '2024-01-10'")
def gap_before_anchor(spark, sf_dir):
    rows = gaps.fill(observed(spark, sf_dir), "2024-01-01", "2024-01-31", "linear", ["risk_index"], before="2024-01-10")
    return rows.where("is_imputed").select("day")


@query(f"{W}{INDEX_SQL} SELECT round(avg(risk_index), 6) AS mean, round(stddev_samp(ma30), 6) AS ma30_std, round(skewness(ma30), 6) AS ma30_skew, round(quantile_cont(ma30, 0.99), 6) AS ma30_p99, count(*) >= 30 AS enough FROM indexed")
def ma30_properties(spark, sf_dir):
    from ..operators import stats

    return indexed(spark, sf_dir).agg(F.round(F.avg("risk_index"), 6).alias("mean"), F.round(F.stddev_samp("ma30"), 6).alias("ma30_std"), F.round(stats.skew("ma30"), 6).alias("ma30_skew"), F.round(stats.quantile("ma30", 0.99), 6).alias("ma30_p99"), (F.count("*") >= 30).alias("enough"))


@query("WITH d AS (SELECT CAST(ts AS DATE) AS day, user_id % 7 AS source, count(*) AS n FROM events WHERE event_id % 3 = 0 GROUP BY 1, 2), e AS (SELECT date_diff('day', min(CAST(ts AS DATE)), max(CAST(ts AS DATE))) + 1 AS days FROM events), l AS (SELECT *, lag(n) OVER (PARTITION BY source ORDER BY day) AS p FROM d) SELECT source, round(avg(n), 6) AS mean, round(stddev_samp(n), 6) AS std, min(n) AS least, max(n) AS most, count(*) AS observed_days, CAST(any_value(days) - count(*) AS BIGINT) AS missing_days, round(corr(n, p), 6) AS autocorr FROM l, e GROUP BY source")
def source_daily_coverage(spark, sf_dir):
    """Volumes by source over the calendar that all sources span, with the correlation to the observed day before."""
    from ..operators import stats

    a = A.articles(spark, sf_dir)
    calendar = a.agg((F.date_diff(F.max("day"), F.min("day")) + 1).alias("days"))
    d = a.where("id % 3 = 0").groupBy("day", (F.col("user_id") % 7).alias("source")).agg(F.count("*").alias("n"))
    told = d.withColumn("p", F.lag("n").over(Window.partitionBy("source").orderBy("day"))).crossJoin(calendar)  # one row on the right
    return told.groupBy("source").agg(
        F.round(F.avg("n"), 6).alias("mean"), F.round(F.stddev_samp("n"), 6).alias("std"), F.min("n").alias("least"), F.max("n").alias("most"), F.count("*").alias("observed_days"),
        (F.max("days") - F.count("*")).alias("missing_days"), F.round(stats.correlation("n", "p"), 6).alias("autocorr"),
    )


@query("SELECT event_id, CASE WHEN a AND b THEN 'oil_rupee,risk_off' WHEN a THEN 'oil_rupee' WHEN b THEN 'risk_off' ELSE '' END AS channels, CASE WHEN a AND b THEN 'alert' WHEN a OR b THEN 'watch' ELSE 'clear' END AS tone FROM (SELECT event_id, value / 100 > 0.3 AND k / 100.0 > 0.05 AS a, k / 50.0 > 0.5 AND value / 100 - 1 < -0.1 AS b FROM (SELECT event_id, value, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events))")
def transmission(spark, sf_dir):
    k, v = F.col("k"), F.col("value")
    active = labels.channels(v / 100, k / 100.0, k / 50.0, v / 100 - 1)
    return A.articles(spark, sf_dir).select(F.col("id").alias("event_id"), F.array_join(active, ",").alias("channels"), labels.channel_tone(active).alias("tone"))


@query(f"{W}{RISK_SQL}, top_ AS (SELECT day, arg_max(route, (round(route_risk, 9), -n)) AS route FROM (SELECT r.*, row_number() OVER (PARTITION BY day ORDER BY route) AS n FROM route_days r) GROUP BY day) SELECT day, CASE WHEN contains(route, 'hormuz') OR contains(route, 'red_sea') THEN 'headwind' ELSE 'mixed' END AS energy, CASE WHEN contains(route, 'lac') OR contains(route, 'pakistan') THEN 'tailwind' ELSE 'mixed' END AS defence_infra, 'tailwind' AS banks FROM top_")
def sector_tilts(spark, sf_dir):
    from ..operators.feed import argmax

    top = argmax(route_days(spark, sf_dir).withColumn("v", F.round("route_risk", 9)), "v", "route", ["day"])
    tilts = F.map_from_entries(labels.sector_tilts(F.lit("LOW"), F.col("route")))
    return top.select("day", *[tilts[s].alias(s) for s in ("energy", "defence_infra", "banks")])


@query("SELECT event_id, CASE WHEN event_type = 'error' THEN 'partial' WHEN g AND v THEN CASE WHEN value > 90 THEN 'both_stressed' ELSE 'elevated' END WHEN g THEN 'headlines_hot' WHEN v THEN 'markets_nervous' ELSE 'normal' END AS verdict FROM (SELECT event_id, event_type, value, value >= 50 AS g, CAST(json_extract_string(props, '$.k') AS INTEGER) >= 50 AS v FROM events)")
def today_verdict(spark, sf_dir):
    q = bands.quadrant(F.col("value"), F.col("k"))
    out = labels.verdict(q, F.col("event_type") != "error", F.when(F.col("value") > 90, "HIGH_STRESS").otherwise("WATCH"))
    return A.articles(spark, sf_dir).select(F.col("id").alias("event_id"), out.alias("verdict"))


@query("SELECT event_id, CASE WHEN event_type = 'error' THEN 'combined' WHEN event_type = 'view' THEN 'headline_led' WHEN user_id % 3 = 0 THEN 'route' WHEN value > 60 THEN 'regime' ELSE 'none' END AS context FROM events")
def portfolio_context(spark, sf_dir):
    stress = F.when(F.col("event_type") == "error", "HIGH").when(F.col("event_type") == "view", "geo")
    context = labels.portfolio_context(stress, F.when(F.col("user_id") % 3 == 0, "imec"), F.when(F.col("value") > 60, "elevated").otherwise("low"))
    return A.articles(spark, sf_dir).select(F.col("id").alias("event_id"), context.alias("context"))


@query("SELECT event_id, CASE WHEN user_id % 2 = 0 THEN CAST(ts AS DATE) < CAST(ts + INTERVAL 330 MINUTE AS DATE) ELSE date_diff('day', CAST(ts AS DATE), CAST(ts + INTERVAL 330 MINUTE AS DATE)) >= 1 END AS stale FROM events")
def quote_staleness(spark, sf_dir):
    stale = labels.quote_stale(F.col("day"), F.col("event_time"), F.col("user_id") % 2 == 0)
    return A.articles(spark, sf_dir).select(F.col("id").alias("event_id"), stale.alias("stale"))


@query("SELECT page_id, contains(url, 'http') AND page_id % 4 <> 0 AS usable FROM pages")
def usable_images(spark, sf_dir):
    url = F.when(F.col("page_id") % 4 == 0, F.concat("url", F.lit(".favicon.ICO"))).otherwise(F.col("url"))
    return A.table(spark, sf_dir, "pages").select("page_id", labels.usable_image(url).alias("usable"))


@query(f"{W}{INDEX_SQL}, f_ AS (SELECT day, risk_index AS t, CASE WHEN day >= DATE '2024-01-20' THEN risk_index + 1 ELSE risk_index + 0.2 END AS c FROM indexed) SELECT day, CASE WHEN abs(t - c) > 0.5 THEN 'file' ELSE 'table' END AS source FROM f_")
def source_precedence(spark, sf_dir):
    other = F.when(F.col("day") >= F.lit("2024-01-20").cast("date"), F.col("risk_index") + 1).otherwise(F.col("risk_index") + 0.2)
    return indexed(spark, sf_dir).select("day", labels.preferred_source(F.col("day"), F.col("risk_index"), F.col("day"), other).alias("source"))


@query("SELECT l_linestatus, CASE WHEN s = 'pass' AND l_linestatus = 'F' THEN 'warn' ELSE s END AS status, count(*) AS n FROM (SELECT l_linestatus, CASE WHEN l_quantity > 25 THEN 'pass' ELSE 'fail' END AS s FROM lineitem) GROUP BY 1, 2")
def staleness_demotion(spark, sf_dir):
    status = F.when(F.col("l_quantity") > 25, "pass").otherwise("fail")
    freshness = F.when(F.col("l_linestatus") == "F", "offline").otherwise("live")
    out = labels.staled(status, freshness, F.lit("headline"), F.lit("2024-01-01").cast("date"), F.lit("2024-01-02").cast("date"))
    return A.table(spark, sf_dir, "lineitem").select("l_linestatus", out.alias("status")).groupBy("l_linestatus", "status").agg(F.count("*").alias("n"))


@query(f"{W}{A.SCORED_SQL} SELECT round(median(theme_score), 6) AS theme_median, round(avg(theme_score), 6) AS theme_mean, round(median(tone_score), 6) AS tone_median, round(avg(CASE WHEN risk_score <= 0.2 THEN 1.0 ELSE 0 END), 6)::DOUBLE AS low_share FROM scored WHERE risk_score > 0")
def calibration_metrics(spark, sf_dir):
    rows = A.scored(spark, sf_dir).where("risk_score > 0")
    return rows.agg(F.round(F.median("theme_score"), 6).alias("theme_median"), F.round(F.avg("theme_score"), 6).alias("theme_mean"), F.round(F.median("tone_score"), 6).alias("tone_median"), F.round(F.avg(F.when(F.col("risk_score") <= 0.2, 1.0).otherwise(0.0)), 6).alias("low_share"))


_PROTO = "c AS (SELECT label, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings), p AS (SELECT label, i, avg(x) AS m FROM c GROUP BY 1, 2), q AS (SELECT label, list(m ORDER BY i) AS proto FROM p GROUP BY 1), s AS (SELECT e.vec_id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.proto), 4) AS sim FROM embeddings e CROSS JOIN q)"


@query(f"WITH {_PROTO}, t AS (SELECT unnest([0.2, 0.25, 0.3, 0.35, 0.4])::DOUBLE AS t) SELECT t AS threshold, count(DISTINCT vec_id) FILTER (WHERE sim >= t) AS covered, count(*) FILTER (WHERE sim >= t) AS hits FROM s CROSS JOIN t GROUP BY t")
def threshold_sweep(spark, sf_dir):
    """Each similarity meets only the thresholds that it reaches."""
    from ..operators import vectors

    rows = A.table(spark, sf_dir, "embeddings")
    sims = vectors.assign(rows, vectors.prototypes(rows, "label", "embedding"), "label", "embedding", "vec_id").select("vec_id", F.round("similarity", 4).alias("sim"))
    grid = F.transform(F.sequence(F.lit(20), F.lit(40), F.lit(5)), lambda x: x / 100.0)
    reached = sims.select("vec_id", F.explode(F.filter(grid, lambda t: F.col("sim") >= t)).alias("t"))
    counts = reached.groupBy(F.round("t", 2).alias("threshold")).agg(F.countDistinct("vec_id").alias("covered"), F.count("*").alias("hits"))
    every = spark.range(1).select(F.explode(grid).alias("t")).select(F.round("t", 2).alias("threshold"))
    return every.join(counts, "threshold", "left").na.fill(0, ["covered", "hits"])


@query(f"{W}{A.ROUTES_SQL} SELECT route, count(*) AS articles, count(*) FILTER (WHERE risk_score > 0.2) AS positives, round(100.0 * count(*) / (SELECT count(*) FROM scored), 6)::DOUBLE AS match_pct FROM tagged JOIN scored USING (id) GROUP BY route")
def route_match_rates(spark, sf_dir):
    pos = F.col("risk_score") > 0.2
    sums = A.routed(spark, sf_dir).groupBy(F.col("routes").alias("mask")).agg(F.count("*").alias("n"), F.count_if(pos).alias("p"))
    # As many rows as combinations of routes: the total and the routes are made of them.
    told = sums.withColumn("total", F.sum("n").over(Window.partitionBy()))
    hits = told.select(F.explode(text.masked_routes(F.col("mask"))).alias("route"), "n", "p", "total").groupBy("route").agg(F.sum("n").alias("articles"), F.sum("p").alias("positives"), F.max("total").alias("total"))
    return hits.select("route", "articles", "positives", F.round(100.0 * F.col("articles") / F.col("total"), 6).alias("match_pct"))


_ENTRIES = ", ".join(f"('{k}', '{v['name']}', '{v['category']}')" for k, v in C.ROUTES.items())


@query(f"{W}{RISK_SQL} SELECT day, route, m.name, m.category, round(route_risk + 1e-9, 6) AS route_risk, row_number() OVER (PARTITION BY day ORDER BY list_position([{A.listed(C.ROUTES)}], route)) AS position FROM route_days JOIN (VALUES {_ENTRIES}) AS m(route, name, category) USING (route)")
def route_metadata(spark, sf_dir):
    """Rows of the board with their routes' metadata, each day in registry order."""
    order = F.array_position(F.array(*[F.lit(r) for r in C.ROUTES]), F.col("route"))
    rows = route_days(spark, sf_dir).select("day", "route", *r6("route_risk")).join(F.broadcast(routes.registry(spark).select("route", "name", "category")), "route")
    return rows.withColumn("position", F.row_number().over(Window.partitionBy("day").orderBy(order)).cast("long"))


@query(f"{W}{RISK_SQL} SELECT day, round(threat_index + 1e-9, 6) AS threat_index, round(route_risk + 1e-9, 6) AS route_risk FROM route_days WHERE route = 'red_sea_suez' AND day >= DATE '2024-01-16' ORDER BY day DESC LIMIT 10")
def corridor_history(spark, sf_dir):
    rows = route_days(spark, sf_dir).where("route = 'red_sea_suez'").where(F.col("day") >= F.greatest(F.lit("2024-01-01"), F.lit(A.CUT)).cast("date"))
    return rows.orderBy(F.desc("day")).limit(10).select("day", *r6("threat_index", "route_risk"))


@query(f"{W}{DAYS_SQL} SELECT count(DISTINCT day) AS n_days, min(day) AS first_day, max(day) AS last_day, count(DISTINCT day) >= least(7, date_diff('day', min(day), max(day)) + 1) AS ready FROM days")
def readiness(spark, sf_dir):
    d = days(spark, sf_dir)
    span = F.datediff(F.max("day"), F.min("day")) + 1
    return d.agg(F.countDistinct("day").alias("n_days"), F.min("day").alias("first_day"), F.max("day").alias("last_day"), (F.countDistinct("day") >= F.least(F.lit(7), span)).alias("ready"))


@query(f"{W}{A.ARTICLES_SQL} SELECT id, event_time >= TIMESTAMP '2024-01-10' AND event_time < TIMESTAMP '2024-01-13' AS inside FROM articles")
def day_bounds(spark, sf_dir):
    """Inclusive dates as half-open bounds of UTC time."""
    start, end = F.lit("2024-01-10").cast("date"), F.date_add(F.lit("2024-01-12").cast("date"), 1)
    return A.articles(spark, sf_dir).select("id", ((F.col("event_time") >= start.cast("timestamp")) & (F.col("event_time") < end.cast("timestamp"))).alias("inside"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderdate >= TIMESTAMP '2000-01-01'")
def range_delete(spark, sf_dir):
    rows = A.table(spark, sf_dir, "orders")
    return tables.delete_before(rows, "o_orderdate", F.lit("2000-01-01").cast("timestamp")).select("o_orderkey", "o_totalprice")


@query("SELECT d.doc_id, d.doc_id // 10 * 10 AS canonical, c.source AS canonical_source FROM documents d JOIN documents c ON c.doc_id = d.doc_id // 10 * 10 WHERE d.doc_id % 10 <> 0")
def duplicate_links(spark, sf_dir):
    """A self-reference resolved by an equi-join."""
    d = A.table(spark, sf_dir, "documents").select("doc_id", (F.floor(F.col("doc_id") / 10) * 10).alias("canonical"))
    c = A.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("canonical"), F.col("source").alias("canonical_source"))
    return d.where("doc_id % 10 <> 0").join(c, "canonical").select("doc_id", "canonical", "canonical_source")


@query(f"{W}{A.PRICES_SQL}, n_ AS (SELECT *, row_number() OVER (ORDER BY day DESC) AS r FROM prices) SELECT day, close, r <= 22 AS in_month FROM n_ WHERE r <= 66")
def history_tail(spark, sf_dir):
    quarter = timeseries.tail(A.daily_prices(spark, sf_dir), 66, "day")
    month = timeseries.tail(quarter, 22, "day").select("day", F.lit(True).alias("m"))
    return quarter.join(month, "day", "left").select("day", "close", F.coalesce("m", F.lit(False)).alias("in_month"))


@query("SELECT n_name, r_name || n_name AS pair, len([r_name, n_name]) AS n FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey < 0")
def empty_result(spark, sf_dir):
    """An empty join keeps its schema."""
    t = lambda n: A.table(spark, sf_dir, n)
    both = t("nation").where("n_nationkey < 0").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return both.select("n_name", F.concat("r_name", "n_name").alias("pair"), F.lit(2).cast("long").alias("n"))


@query(f"{W}{A.SCORED_SQL} SELECT id, {s6('risk_score')} FROM scored WHERE isfinite(risk_score)")
def finite_scores(spark, sf_dir):
    return A.scored(spark, sf_dir).select("id", bands.finite(F.col("risk_score")).alias("risk_score")).where("risk_score is not null").select("id", *r6("risk_score"))


@query(f"{W}raw AS (SELECT event_id, strftime(ts, '%Y%m%d%H%M%S') AS stamp, value FROM events) SELECT CAST(event_id AS VARCHAR) AS identifier, round(value, 2) AS tone_overall, round(abs(value - 50), 2) AS tone_neg, 'ARMEDCONFLICT;TERROR' AS themes FROM raw WHERE event_id % 10 <> 3")
def clean_raw(spark, sf_dir):
    """Raw slot rows from events: every tenth has a broken stamp and goes."""
    e = A.table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    stamp = F.when(F.col("event_id") % 10 == 3, "broken").otherwise(F.date_format("ts", "yyyyMMddHHmmss"))
    tone = F.concat_ws(",", F.col("value").cast("string"), F.lit("x"), (F.col("value") - 50).cast("string"), F.lit(""))
    raw = e.select(stamp.alias("stamp"), F.lit("s").alias("source"), F.col("event_id").cast("string").alias("identifier"), F.lit("ARMEDCONFLICT,12;TERROR,40").alias("themes"), F.lit("").alias("locations"), tone.alias("tone"), F.lit("").alias("dims"))
    return scoring.clean_raw(raw).select("identifier", F.round("tone_overall", 2).alias("tone_overall"), F.round("tone_neg", 2).alias("tone_neg"), "themes")


