"""Queries of the incremental path, saved hits, and of sources and sinks written and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import feed, refresh, rollup, routes, scoring, stats, tables
from ..sources import readers, shared, writers
from . import articles as A
from .registry import query
from .risk import DAYS_SQL, INDEX_SQL, RISK_SQL, W, bench, days, indexed, observed, r6, route_days, s6

WARMUP = "2024-01-05"
LATE = "id % 3 = 0 AND day IN (DATE '2024-01-10', DATE '2024-01-20')"
SAVED_SQL = f"{A.ARTICLES_SQL}, saved AS (SELECT day, count(*) AS total_articles FROM articles WHERE NOT ({LATE}) GROUP BY day)"


def saved_days(spark, sf_dir):
    """The daily series as it was before the late articles of two days came in."""
    early = A.articles(spark, sf_dir).where(f"NOT ({LATE.replace('DATE ', 'date')})")
    return rollup.daily(scoring.score_articles(early))


@query(f"{W}{SAVED_SQL} SELECT a.day FROM (SELECT day, count(*) AS n FROM articles GROUP BY day) a LEFT JOIN saved s ON s.day = a.day WHERE s.day IS NULL OR n <> total_articles")
def dirty_days(spark, sf_dir):
    return refresh.dirty_days(A.articles(spark, sf_dir), saved_days(spark, sf_dir))


@query(f"{W}{INDEX_SQL} SELECT day, total_articles, {s6('risk_sum', 'raw_ratio', 'risk_index', 'acts_index', 'threats_index', 'ma7', 'ma30')} FROM indexed")
def incremental_rescore(spark, sf_dir):
    """Rescoring the dirty days alone gives the series of a full run."""
    rows, saved = A.articles(spark, sf_dir), saved_days(spark, sf_dir)
    out = refresh.rescore(rows, saved, refresh.dirty_days(rows, saved), A.BASE_START, A.BASE_END)
    return out.select("day", "total_articles", *r6("risk_sum", "raw_ratio", "risk_index", "acts_index", "threats_index", "ma7", "ma30"))


@query(f"{W}{A.ARTICLES_SQL}, e AS (SELECT max(day) AS last FROM articles) SELECT DISTINCT day FROM articles, e WHERE day BETWEEN greatest(last - 14, DATE '{A.CUT}') AND last AND dayofmonth(day) % 4 = 1")
def backfill_days(spark, sf_dir):
    rows = A.articles(spark, sf_dir)
    saved = rows.select("day").distinct().where("dayofmonth(day) % 4 <> 1")
    last = rows.agg(F.max("day").alias("last"))
    return refresh.missing_days(rows.crossJoin(last), saved, F.col("last"), A.CUT)  # one row on the right


@query(f"SELECT o_orderkey, CASE WHEN d < DATE '{A.CUT}' THEN greatest(d, DATE '{WARMUP}') ELSE greatest(d, DATE '{A.CUT}') END AS starts FROM (SELECT o_orderkey, DATE '2023-12-20' + CAST(o_orderkey % 60 AS INTEGER) AS d FROM orders)")
def score_start(spark, sf_dir):
    day = F.date_add(F.lit("2023-12-20").cast("date"), (F.col("o_orderkey") % 60).cast("int"))
    return A.table(spark, sf_dir, "orders").select("o_orderkey", refresh.score_start(day, A.CUT, WARMUP).alias("starts"))


@query(f"{W}{RISK_SQL} SELECT day, route, total_articles, positive_articles, matched_positive_articles, hit_count, score_status, {s6('risk_sum', 'threat_index', 'route_risk', 'ma7')} FROM route_days")
def corridor_from_hits(spark, sf_dir):
    """Routes once more from saved hits and saved day totals, to which the hits and totals of later days are added."""
    rows, members = A.routed(spark, sf_dir), routes.registry(spark)
    cut = F.lit(A.CUT).cast("date")
    prior, new = routes.hits(rows.where(F.col("day") < cut)), routes.hits(rows.where(F.col("day") >= cut))
    totals = tables.upsert(routes.day_totals(rows.where(F.col("day") < cut)), routes.day_totals(rows.where(F.col("day") >= cut)), ["day"])
    out = routes.normalise(routes.panel_of_hits(prior.union(new), totals, members), members, A.BASE_START, A.BASE_END)
    return out.select("day", "route", "total_articles", "positive_articles", "matched_positive_articles", "hit_count", "score_status", *r6("risk_sum", "threat_index", "route_risk", "ma7"))


@query(f"{W}{DAYS_SQL.replace('FROM scored GROUP BY day', 'FROM scored WHERE day BETWEEN DATE ' + chr(39) + '2024-01-04' + chr(39) + ' AND DATE ' + chr(39) + '2024-01-27' + chr(39) + ' GROUP BY day')} SELECT day, total_articles, {s6('risk_sum', 'raw_ratio', 'acts_ratio')} FROM days")
def catch_up_range(spark, sf_dir):
    """A range of days exported as a table by day, read back with its bounds, and scored in one batch."""
    path = shared.run_folder(spark, "days") + "/articles"
    refresh.export_days(A.articles(spark, sf_dir).drop("k"), path)
    out = refresh.score_exported(spark, path, "2024-01-04", "2024-01-27", (A.BASE_START, A.BASE_END))
    return out.select("day", "total_articles", *r6("risk_sum", "raw_ratio", "acts_ratio"))


# --- joins on days and months, orders of boards


@query(f"{W}{A.PRICES_SQL}, a AS (SELECT strftime(day, '%Y-%m') AS year_month, avg(close) AS ours FROM prices GROUP BY 1), b AS (SELECT strftime(l_shipdate, '%Y-%m') AS year_month, avg(l_extendedprice) AS bench FROM lineitem GROUP BY 1) SELECT year_month, round(ours + 1e-6, 4) AS ours, round(bench + 1e-6, 4) AS bench FROM a JOIN b USING (year_month)")
def monthly_benchmark(spark, sf_dir):
    """Two series meet on their months, after each is one row a month."""
    ours = A.daily_prices(spark, sf_dir).groupBy(F.date_format("day", "yyyy-MM").alias("year_month")).agg(F.round(F.avg("close") + 1e-6, 4).alias("ours"))
    other = A.table(spark, sf_dir, "lineitem").groupBy(F.date_format("l_shipdate", "yyyy-MM").alias("year_month")).agg(F.round(F.avg("l_extendedprice") + 1e-6, 4).alias("bench"))
    return ours.join(other, "year_month")


@query(f"{W}{INDEX_SQL}, bench AS (SELECT CAST(ts AS DATE) AS day, round(avg(value), 6) AS bench FROM events GROUP BY 1) SELECT day, bench FROM bench WHERE day IN (DATE '2024-01-05', DATE '2024-01-06', DATE '2024-01-17', DATE '2024-01-30') AND day IN (SELECT day FROM indexed)")
def gap_benchmark_days(spark, sf_dir):
    """The benchmark's rows on the days that the observed series lacks."""
    from ..operators import timeseries

    gaps = timeseries.missing_days(observed(spark, sf_dir), "2024-01-01", "2024-01-31")
    return bench(spark, sf_dir).join(gaps, "day", "left_semi")


@query(f"{W}{RISK_SQL} SELECT route, row_number() OVER (ORDER BY round(coalesce(ma7, route_risk), 6) DESC NULLS LAST, route) AS position FROM route_days WHERE day = (SELECT max(day) FROM route_days)")
def board_order(spark, sf_dir):
    from ..operators import timeseries

    last = timeseries.latest(route_days(spark, sf_dir).select("route", "day", "route_risk", "ma7"), ["route"], "day")
    return feed.board(last, F.round(F.coalesce("ma7", "route_risk"), 6), "route").select("route", "position")


@query(f"{W}{INDEX_SQL} SELECT day, round(risk_index + 1e-9, 6) AS risk_index, row_number() OVER (ORDER BY day) AS position FROM (SELECT day, risk_index FROM indexed ORDER BY day DESC LIMIT 10)")
def recent_ascending(spark, sf_dir):
    """The newest rows, handed on in ascending order."""
    newest = indexed(spark, sf_dir).select("day", *r6("risk_index")).orderBy(F.desc("day")).limit(10)
    return feed.board(newest, None, "day")


@query("SELECT event_id FROM events ORDER BY event_id LIMIT 50 OFFSET 100")
def head_sample(spark, sf_dir):
    return A.table(spark, sf_dir, "events").select("event_id").orderBy("event_id").offset(100).limit(50)


# --- regressions


@query(f"{W}{A.PRICES_SQL}, d AS (SELECT *, ln(close) - lag(ln(close)) OVER (ORDER BY day) AS y FROM prices), k AS (SELECT day, y, lag(y) OVER (ORDER BY day) AS x FROM d), c AS (SELECT * FROM k WHERE x IS NOT NULL AND y IS NOT NULL), f AS (SELECT day, x - avg(x) OVER () AS dx, y - regr_intercept(y, x) OVER () - regr_slope(y, x) OVER () * x AS e FROM c), u AS (SELECT day, dx, dx * e AS u FROM f), l AS (SELECT dx, u, {', '.join(f'lag(u, {k}) OVER (ORDER BY day) AS u{k}' for k in range(1, 7))} FROM u) SELECT round(sqrt(sum(u * u) + {' + '.join(f'2.0 * (1 - {k} / 7.0) * sum(u * u{k})' for k in range(1, 7))}) / sum(dx * dx), 8) AS slope_se, count(*) AS n FROM l")
def hac_error(spark, sf_dir):
    """The Newey-West error (6 lags) of a regression of returns on the returns before."""
    from ..operators import signal, timeseries

    rows = signal.returns(A.daily_prices(spark, sf_dir)).withColumn("x", F.lag("lr", 1).over(timeseries.ordered()))
    return stats.ols_hac(rows, "lr", "x", "day").select(F.round("slope_se", 8).alias("slope_se"), "n")


# --- sources and sinks, written and read back


@query(f"{W}{A.PRICES_SQL} SELECT day, close FROM prices")
def prices_from_csv(spark, sf_dir):
    """A price file with broken rows, in two date forms: the good rows come back."""
    good = A.daily_prices(spark, sf_dir)
    form = F.when(F.dayofmonth("day") % 2 == 0, F.date_format("day", "MM/dd/yyyy")).otherwise(F.date_format("day", "yyyy-MM-dd"))
    lines = good.select(form.alias("Date"), F.col("close").cast("string").alias("Close"))
    third = good.where(F.dayofmonth("day") % 3 == 0)
    broken = third.select(F.lit("n/a").alias("Date"), F.lit("1.0").alias("Close")).union(third.select(F.lit("2030-01-01").alias("Date"), F.lit("-").alias("Close")))
    # A first file whose values of every third day a later file corrects.
    path = shared.run_folder(spark, "prices")
    writers.products(path, a_first=third.select(F.date_format("day", "yyyy-MM-dd").alias("Date"), F.lit("99999999.0").alias("Close")), b_prices=lines.union(broken))
    return readers.series(spark, [f"{path}/a_first", f"{path}/b_prices"])


@query("SELECT strftime(o_orderdate, '%Y-%m-%d') AS month, round(avg(o_totalprice) + 1e-6, 4) AS bench FROM orders GROUP BY 1")
def benchmark_table(spark, sf_dir):
    """A benchmark table whose date column is found by its name."""
    rows = A.table(spark, sf_dir, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM-dd").alias("Obs_Date")).agg(F.round(F.avg("o_totalprice") + 1e-6, 4).alias("GPRD"), F.count("*").alias("N"))
    path = shared.run_folder(spark, "benchmark")
    writers.products(path, bench=rows)
    return readers.benchmark(spark, f"{path}/bench", "GPRD").select(F.date_format("day", "yyyy-MM-dd").alias("month"), "bench")


@query("SELECT 'l' || event_id AS link, epoch_us(ts) // 1000 AS at_ms, CASE WHEN event_id % 3 = 0 THEN 's' WHEN event_id % 3 = 1 THEN 'd' ELSE '' END AS body FROM events")
def feed_from_json(spark, sf_dir):
    """Entries as JSON lines: the time is when it was published, else updated; the text the summary, else the description."""
    e = A.table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    third = F.col("event_id") % 3
    lines = e.select(
        F.concat(F.lit("l"), F.col("event_id")).alias("link"),
        F.when(third != 1, F.col("ts")).alias("published"),
        F.when(third == 1, F.col("ts")).otherwise(F.col("ts") + F.expr("INTERVAL 1 DAY")).alias("updated"),
        F.when(third == 0, "s").alias("summary"),
        F.when(third == 1, "d").alias("description"),
    )
    path = shared.run_folder(spark, "feed") + "/entries"
    lines.write.json(path, timestampFormat="yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    return readers.feed_entries(spark, path).select("link", F.unix_millis("event_time").alias("at_ms"), "body")


@query("SELECT CAST(event_id AS VARCHAR) AS identifier, round(value, 2) AS tone_overall FROM events WHERE event_id % 7 <> 0")
def slot_rows(spark, sf_dir):
    """Slot files of 27 columns: every seventh line lacks its stamp and goes."""
    e = A.table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    own = {1: F.when(F.col("event_id") % 7 == 0, "").otherwise(F.date_format("ts", "yyyyMMddHHmmss")), 4: F.col("event_id").cast("string"), 15: F.concat(F.col("value").cast("string"), F.lit(",1,2,3"))}
    lines = e.select(F.concat_ws("\t", *[own.get(i, F.lit("x")) for i in range(readers.SLOT_WIDTH)]).alias("value"))
    path = shared.run_folder(spark, "slots") + "/raw"
    lines.write.text(path)
    return scoring.clean_raw(readers.slots(spark, path)).select("identifier", F.round("tone_overall", 2).alias("tone_overall"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def replaced_table(spark, sf_dir):
    """A table replaced by rows that were read from it."""
    path = shared.run_folder(spark, "replaced") + "/orders"
    A.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus").write.parquet(path)
    old = spark.read.parquet(path)
    writers.replace(old.withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 5 == 0, "X").otherwise(F.col("o_orderstatus"))), path)
    return spark.read.parquet(path)


@query("SELECT l_orderkey, l_linenumber, max(l_quantity) * 2 AS q FROM lineitem WHERE l_linenumber = 1 GROUP BY 1, 2 UNION ALL SELECT l_orderkey, l_linenumber, max(l_quantity) FROM lineitem WHERE l_linenumber <> 1 GROUP BY 1, 2")
def upsert_two_keys(spark, sf_dir):
    old = A.table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("q"))
    return tables.upsert(old, old.where("l_linenumber = 1").withColumn("q", F.col("q") * 2), ["l_orderkey", "l_linenumber"])


@query(f"{W}{A.ARTICLES_SQL} SELECT day, count(*) * 2 AS runs FROM articles GROUP BY day")
def append_log(spark, sf_dir):
    """A log that two runs append to."""
    path = shared.run_folder(spark, "log") + "/runs"
    rows = A.articles(spark, sf_dir).select("day", "id")
    for _ in range(2):
        writers.append(rows, path)
    return spark.read.parquet(path).groupBy("day").agg(F.count("*").alias("runs"))


@query(f"{W}{INDEX_SQL} SELECT day, round(risk_index, 4) AS risk_index, CASE WHEN dayofmonth(day) % 2 = 0 THEN round(ma7, 4) END AS ma7, total_articles FROM indexed WHERE day >= DATE '{A.CUT}' AND dayofmonth(day) % 5 <> 0")
def table_sync(spark, sf_dir):
    """A CSV product into the served table: rows before the product start and rows without an index stay out, blanks become null."""
    path = shared.run_folder(spark, "sync")
    rows = indexed(spark, sf_dir).select("day", F.when(F.dayofmonth("day") % 5 != 0, F.round("risk_index", 4)).alias("risk_index"), F.when(F.dayofmonth("day") % 2 == 0, F.round("ma7", 4)).alias("ma7"), "total_articles")
    writers.products(path, daily=rows)
    served = spark.createDataFrame([], "day date, risk_index double, ma7 double, total_articles long")
    return tables.upsert(served, readers.synced(spark, f"{path}/daily", A.CUT, {"risk_index": "double", "ma7": "double", "total_articles": "long"}, "risk_index"), ["day"])


@query(f"{W}{A.ARTICLES_SQL}, p AS (SELECT day, to_json({{'n': count(*), 'tag': 'h'}}) AS payload FROM articles GROUP BY day) SELECT day, json_extract_string(payload, '$.n') AS n, CASE WHEN dayofmonth(day) % 3 = 0 THEN 'new' ELSE 'old' END AS tag FROM p")
def payload_upsert(spark, sf_dir):
    """JSON payloads by day; a later payload of a day replaces the earlier one."""
    per_day = A.articles(spark, sf_dir).groupBy("day").agg(F.count("*").alias("n"))
    old = writers.payload(per_day.withColumn("tag", F.lit("old")), "day")
    new = writers.payload(per_day.where("dayofmonth(day) % 3 = 0").withColumn("tag", F.lit("new")), "day")
    packed = tables.upsert(old, new, ["day"])
    return packed.select("day", F.get_json_object("payload", "$.n").alias("n"), F.get_json_object("payload", "$.tag").alias("tag"))
