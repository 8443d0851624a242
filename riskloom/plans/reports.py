"""Queries of reports, boards, quotes, watchlists and the tagging batch."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import bands, labels, text
from ..functions import constants as C
from ..operators import feed, gaps, joins, model, routes, signal, stats, timeseries
from ..sources import writers
from . import articles as A
from . import risk as R
from . import texts as T
from .registry import QUERIES, ORACLE_SQL, query
from .risk import INDEX_SQL, OBSERVED_SQL, RISK_SQL, W, indexed, r6, route_days, s6
from .series import LR_SQL, VOL, _ahead, _full


# --- texts and lists

KEYWORDS_SQL = "raw AS (SELECT event_id, CASE WHEN event_type = 'view' THEN 'THEME_A' WHEN event_type = 'click' THEN '' END AS themes, CASE event_id % 5 WHEN 0 THEN '[\"a\", \"k' || event_id || '\", \"\"]' WHEN 1 THEN '{\"x\": 1, \"y\": \"z\"}' WHEN 2 THEN 'plain words' WHEN 3 THEN '[]' END AS kw FROM events)"


@query(f"""{W}{KEYWORDS_SQL} SELECT event_id, coalesce(nullif(themes, ''), CASE WHEN kw LIKE '[%' THEN array_to_string(list_filter(from_json(kw, '["VARCHAR"]'), lambda x: x <> ''), ', ')
  WHEN kw LIKE '{{%' THEN array_to_string(list_transform(json_keys(kw), lambda k: k || ': ' || json_extract_string(kw, '$.' || k)), ', ') ELSE kw END, '') AS shown FROM raw""")
def theme_display(spark, sf_dir):
    five = F.col("event_id") % 5
    kw = F.when(five == 0, F.concat(F.lit('["a", "k'), F.col("event_id"), F.lit('", ""]'))).when(five == 1, '{"x": 1, "y": "z"}').when(five == 2, "plain words").when(five == 3, "[]")
    themes = F.when(F.col("event_type") == "view", "THEME_A").when(F.col("event_type") == "click", "")
    return A.table(spark, sf_dir, "events").select("event_id", text.theme_display(themes, kw).alias("shown"))


@query(f"{W}{A.ARTICLES_SQL}, n AS (SELECT id, list_filter(list_transform(string_split(locations, ';'), lambda e: split_part(e, '#', 2)), lambda x: x <> '') AS names FROM articles) SELECT id, array_to_string(list_filter(names, lambda x, i: list_position(names, x) = i), ' ') AS line FROM n")
def location_text(spark, sf_dir):
    return A.articles(spark, sf_dir).select("id", text.text_of_locations(F.col("locations")).alias("line"))


_gz = ", ".join(f"CASE WHEN regexp_matches(text, '(?i)(^|[^\\p{{L}}\\p{{N}}_])({'|'.join(a)})($|[^\\p{{L}}\\p{{N}}_])') THEN '{b}' END" for _, a, b in sorted(T.GAZETTEER))


@query(
    f"WITH {T.WORDS_SQL} SELECT doc_id, round(coalesce(100.0 * {T._count(T.NEG)} / nullif(len(words), 0), 0), 6)::DOUBLE AS tone_neg, round(coalesce(100.0 * {T._count(T.NEG + T.POS)} / nullif(len(words), 0), 0), 6)::DOUBLE AS tone_polarity, "
    + " || ',' || ".join(f"'{k}:' || printf('%.3f', coalesce(least(1.0, {T._count(v)} / nullif(len(words) * 0.04, 0)), 0) + 1e-9)" for k, v in T.DIMS.items())
    + f" AS dims, concat_ws(';', {_gz}) AS locations, 'words-1+places-2' AS version FROM w"
)
def tagging_batch(spark, sf_dir):
    """Tone, dimensions, places and the extractors' versions of every text, over its whole length."""
    rows = T.docs(spark, sf_dir).select("doc_id", "text", text.tallied(F.col("text"), T.NEG, T.POS, *T.DIMS.values()).alias("w"))
    words, n = F.col("w.found"), F.col("w.n")
    dims = F.concat_ws(",", *[F.format_string(f"{k}:%.3f", text.dimension_density(words, v, total=n) + 1e-9) for k, v in T.DIMS.items()])
    return rows.select(
        "doc_id", F.round(text.density(words, T.NEG, n), 6).alias("tone_neg"), F.round(text.density(words, T.NEG + T.POS, n), 6).alias("tone_polarity"), dims.alias("dims"),
        text.place_blocks(F.col("text"), T.GAZETTEER).alias("locations"), text.extractor_id("words-1", "places-2").alias("version"),
    )


@query("SELECT c_custkey, CASE WHEN list_contains(w, seg) THEN list_filter(w, lambda x: x <> seg) ELSE list_append(w, seg) END AS watched, len(w) AS before FROM (SELECT c_custkey, lower(c_mktsegment) AS seg, CASE c_custkey % 3 WHEN 0 THEN ['building', 'imec'] WHEN 1 THEN ['household'] ELSE [] END AS w FROM customer)".replace("AS watched", "AS watched_").replace("SELECT c_custkey, CASE WHEN list_contains", "SELECT c_custkey, array_to_string(CASE WHEN list_contains", 1).replace("END AS watched_", "END, ',') AS watched", 1))
def watchlist_toggle(spark, sf_dir):
    third, item = F.col("c_custkey") % 3, F.lower("c_mktsegment")
    watched = F.when(third == 0, F.array(F.lit("building"), F.lit("imec"), F.lit("building"))).when(third == 1, F.array(F.lit("household")))
    return A.table(spark, sf_dir, "customer").select("c_custkey", F.array_join(labels.toggled(watched, item), ",").alias("watched"), F.size(F.array_distinct(F.coalesce(watched, F.array().cast("array<string>")))).cast("long").alias("before"))


@query(f"{W}{RISK_SQL} SELECT day, count(*) AS watched, count(*) FILTER (WHERE route_risk >= 50) AS high FROM route_days WHERE route IN ('red_sea_suez', 'strait_of_hormuz', 'india_china_lac') GROUP BY day")
def watchlist_alerts(spark, sf_dir):
    watched = spark.createDataFrame([("red_sea_suez",), ("strait_of_hormuz",), ("india_china_lac",)], "route string")
    rows = route_days(spark, sf_dir).join(F.broadcast(watched), "route", "left_semi")
    return rows.groupBy("day").agg(F.count("*").alias("watched"), F.count_if(F.col("route_risk") >= 50).alias("high"))


_points = ", ".join(f"('{k}', {len(v)}, {v[-1][0]}::DOUBLE, {C.CENTRES[k][1]}::DOUBLE, {C.CENTRES[k][0]}::DOUBLE)" for k, v in C.WAYPOINTS.items())


@query(f"{W}{RISK_SQL}, p AS (SELECT * FROM (VALUES {_points}) AS v(route, n_points, last_lat, lon, lat)) SELECT day, route, n_points, last_lat, lon, lat, CASE WHEN route_risk >= 50 THEN 'error' WHEN route_risk >= 20 THEN 'tertiary' ELSE 'secondary' END AS colour FROM route_days JOIN p USING (route)")
def route_map(spark, sf_dir):
    points, middle = labels.waypoints(F.upper("route")), labels.centre(F.col("route"))
    return route_days(spark, sf_dir).select("day", "route", F.size(points).cast("long").alias("n_points"), F.element_at(points, -1)[0].alias("last_lat"), middle[0].alias("lon"), middle[1].alias("lat"), labels.risk_colour(F.col("route_risk")).alias("colour"))


_cats = " ".join(f"WHEN '{k}' THEN '{v['category']}'" for k, v in C.ROUTES.items())


@query(f"{W}{RISK_SQL} SELECT day, route, CASE WHEN dayofmonth(day) % 7 = 0 THEN 'own' ELSE CASE route {_cats} END END AS category FROM route_days UNION ALL SELECT DISTINCT day, 'elsewhere', 'sea' FROM route_days")
def route_categories(spark, sf_dir):
    rows = route_days(spark, sf_dir).select("day", "route")
    every = rows.union(rows.select("day", F.lit("elsewhere").alias("route")).distinct())
    own = F.when((F.dayofmonth("day") % 7 == 0) & (F.col("route") != "elsewhere"), "own")
    return every.select("day", "route", labels.route_category(F.col("route"), own).alias("category"))


# --- feeds

FULL_SQL = f"{A.ARTICLES_SQL}, full_ AS (SELECT id, CASE WHEN user_id % 4 = 3 THEN NULL ELSE 1 END AS tier, CASE WHEN id % 11 = 0 THEN id - 1 END AS duplicate_of, CASE WHEN id % 5 <> 0 THEN event_time END AS extracted_at, CASE WHEN k % 6 <> 0 THEN tone_neg END AS tone_neg, tone_polarity, CASE WHEN event_type = 'view' THEN '' ELSE dims END AS dims, CASE WHEN id % 7 <> 0 THEN 'v1' END AS version, event_time FROM articles)"


@query(f"{W}{FULL_SQL} SELECT id FROM full_ WHERE tier IS NOT NULL AND duplicate_of IS NULL AND extracted_at IS NOT NULL AND tone_neg IS NOT NULL AND tone_polarity IS NOT NULL AND dims <> '' AND version IS NOT NULL")
def extraction_complete(spark, sf_dir):
    unless = lambda c, column: F.when(c, F.col(column))
    rows = A.articles(spark, sf_dir).select(
        "id", F.when(F.col("user_id") % 4 != 3, 1).alias("tier"), F.when(F.col("id") % 11 == 0, F.col("id") - 1).alias("duplicate_of"), unless(F.col("id") % 5 != 0, "event_time").alias("extracted_at"),
        unless(F.col("k") % 6 != 0, "tone_neg").alias("tone_neg"), "tone_polarity", F.when(F.col("event_type") == "view", "").otherwise(F.col("dims")).alias("dims"), F.when(F.col("id") % 7 != 0, "v1").alias("version"),
    )
    return rows.where(feed.extracted()).select("id")


@query(f"{W}{A.ARTICLES_SQL}, f AS (SELECT unnest(range(0, 45)) AS feed), h AS (SELECT user_id % 40 AS feed, max(event_time) AS a, max(event_time) FILTER (WHERE event_type <> 'error') AS s FROM articles GROUP BY 1), n AS (SELECT max(event_time) AS now FROM articles), j AS (SELECT 1 + f.feed % 2 AS tier, CASE WHEN f.feed % 2 = 0 THEN 420 ELSE 720 END AS w, floor(epoch(now)) - floor(epoch(a)) AS da, floor(epoch(now)) - floor(epoch(s)) AS ds FROM f LEFT JOIN h USING (feed), n) SELECT tier, bool_or(da IS NULL OR da >= w) AS due, count(*) FILTER (WHERE ds IS NULL OR ds > 2 * w) AS stale FROM j GROUP BY tier")
def feeds_due(spark, sf_dir):
    from ..operators import tables

    runs = A.articles(spark, sf_dir).select((F.col("user_id") % 40).alias("feed"), F.col("event_time").alias("at"), (F.col("event_type") != "error").alias("ok"))
    now = runs.agg(F.max("at").alias("now"))
    health = tables.health(runs).select("feed", "last_attempt", "last_success")
    feeds = spark.range(45).select(F.col("id").alias("feed"), (1 + F.col("id") % 2).cast("int").alias("tier")).crossJoin(now)  # one row on the right
    return feed.feeds_due(feeds, health, F.col("now"))


@query(f"{W}{A.ARTICLES_SQL} SELECT id FROM articles WHERE id % 3 = 0 AND k % 2 = 0 ORDER BY event_time DESC NULLS LAST, id LIMIT 60")
def missing_images(spark, sf_dir):
    """The newest articles with a link and no image."""
    rows = A.articles(spark, sf_dir).select("id", "event_time", F.when(F.col("id") % 3 != 0, "https://x/i.png").otherwise("").alias("image"), F.when(F.col("k") % 2 == 0, "https://x").alias("link"))
    lacking = (F.coalesce("image", F.lit("")) == "") & (F.coalesce("link", F.lit("")) != "")
    return feed.newest(rows.where(lacking), 60).select("id")


# --- quotes


@query("SELECT event_id, CASE WHEN fast IS NOT NULL AND CASE WHEN ex THEN op ELSE daily IS NULL OR fast >= daily END THEN 'fast' WHEN (ex AND op OR daily IS NULL OR date_diff('day', daily, DATE '2024-01-15') >= 1) AND k % 3 <> 0 THEN 'intraday' WHEN daily IS NOT NULL THEN 'daily' WHEN fast IS NOT NULL THEN 'fast' END AS source FROM (SELECT event_id, k, user_id % 2 = 0 AS ex, value > 50 AS op, CASE WHEN k % 4 <> 0 THEN DATE '2024-01-10' + CAST(k % 6 AS INTEGER) END AS fast, CASE WHEN k % 5 <> 0 THEN DATE '2024-01-12' + CAST(k % 4 AS INTEGER) END AS daily FROM (SELECT event_id, user_id, value, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events))")
def quote_source(spark, sf_dir):
    k = F.col("k")
    fast = F.when(k % 4 != 0, F.date_add(F.lit("2024-01-10").cast("date"), k % 6))
    daily = F.when(k % 5 != 0, F.date_add(F.lit("2024-01-12").cast("date"), k % 4))
    found = labels.quote_source(F.col("user_id") % 2 == 0, F.col("value") > 50, fast, k % 3 != 0, daily, F.lit("2024-01-15").cast("date"))
    return A.articles(spark, sf_dir).select(F.col("id").alias("event_id"), found.alias("source"))


@query("SELECT event_id, CASE WHEN k % 3 <> 0 THEN CAST(ts + INTERVAL 330 MINUTE AS DATE) WHEN k % 2 = 0 THEN DATE '2024-01-02' ELSE DATE '2024-02-01' END AS as_of FROM (SELECT event_id, ts, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)")
def quote_day(spark, sf_dir):
    seconds = F.when(F.col("k") % 3 != 0, F.unix_seconds("event_time"))
    found = labels.quote_day(seconds, F.when(F.col("k") % 2 == 0, F.lit("2024-01-02").cast("date")), F.lit("2024-02-01").cast("date"))
    return A.articles(spark, sf_dir).select(F.col("id").alias("event_id"), found.alias("as_of"))


@query("WITH w AS (SELECT CAST(ts AS DATE) AS day, avg(value) FILTER (WHERE event_type = 'click') AS click, avg(value) FILTER (WHERE event_type = 'error' AND dayofmonth(ts) % 2 = 0) AS error FROM events GROUP BY 1) SELECT 'click' AS symbol, count(click) AS n, round(arg_max(click, day), 6) AS last, CASE WHEN count(click) = 0 THEN 'no data' END AS problem FROM w UNION ALL SELECT 'error', count(error), round(arg_max(error, day), 6), CASE WHEN count(error) = 0 THEN 'no data' END FROM w UNION ALL SELECT 'unknown', 0, NULL, 'no data'")
def batch_histories(spark, sf_dir):
    """Histories per symbol from one wide batch: rows without a value go, a symbol without any keeps a row with its problem."""
    e = A.articles(spark, sf_dir)
    wide = e.groupBy("day").agg(F.avg(F.when(F.col("event_type") == "click", F.col("value"))).alias("click"), F.avg(F.when((F.col("event_type") == "error") & (F.dayofmonth("event_time") % 2 == 0), F.col("value"))).alias("error"))
    long = wide.select("day", F.explode(F.array(*[F.struct(F.lit(c).alias("symbol"), F.col(c).alias("v")) for c in ("click", "error")])).alias("s")).select("day", "s.*").where("v is not null")
    asked = spark.createDataFrame([("click",), ("error",), ("unknown",)], "symbol string")
    found = asked.join(long, "symbol", "left").groupBy("symbol").agg(F.count("v").alias("n"), F.round(F.max_by("v", "day"), 6).alias("last"))
    return found.withColumn("problem", F.when(F.col("n") == 0, "no data"))


@query(f"{W}{LR_SQL}, t AS (SELECT * FROM lr_ ORDER BY day DESC LIMIT 66) SELECT (SELECT round(stddev_samp(lr) * sqrt(252.0) * 100, 2) FROM (SELECT lr FROM t ORDER BY day DESC LIMIT 22)) AS trailing_vol_22, (SELECT round((max(close) FILTER (WHERE r = 1) / max(close) FILTER (WHERE r = 8) - 1) * 100, 2) FROM (SELECT close, row_number() OVER (ORDER BY day DESC) AS r FROM t)) AS return_7, (SELECT max(day) FROM t) AS as_of")
def market_indicators(spark, sf_dir):
    """Vol of the last 22 returns and the return over 7 rows, of a quarter's history."""
    rows = signal.returns(A.daily_prices(spark, sf_dir)).withColumn("n", F.row_number().over(Window.partitionBy().orderBy(F.desc("day")))).where("n <= 66")
    at = lambda n: F.max(F.when(F.col("n") == n, F.col("close")))
    vol = F.stddev_samp(F.when(F.col("n") <= 22, F.col("lr"))) * F.sqrt(F.lit(252.0)) * 100.0
    return rows.agg(F.round(vol, 2).alias("trailing_vol_22"), F.round((at(1) / at(8) - 1) * 100, 2).alias("return_7"), F.max("day").alias("as_of"))


@query(f"{W}{INDEX_SQL}, c AS (SELECT day, row_number() OVER (ORDER BY day) AS n, (risk_index / lag(risk_index, 7) OVER (ORDER BY day) - 1) * 100 AS ch FROM indexed), m AS (SELECT day, event_type, (avg(value) - 50) / 100 AS mv FROM (SELECT CAST(ts AS DATE) AS day, event_type, value FROM events) GROUP BY 1, 2), t AS (SELECT day, arg_max(event_type, (abs(mv), event_type)) AS label, arg_max(mv, (abs(mv), event_type)) AS mv FROM m GROUP BY day) SELECT day, coalesce(nullif(concat_ws(' · ', CASE WHEN n < 8 THEN 'News risk 7d change needs 8+ index days' WHEN ch IS NOT NULL THEN 'News risk ' || CASE WHEN ch >= 0 THEN 'up' ELSE 'down' END || printf(' %.1f%% over 7 days', abs(ch)) END, CASE WHEN abs(mv) >= 0.05 THEN label || CASE WHEN mv >= 0 THEN ' +' ELSE ' ' END || printf('%.2f%% today', mv) END), ''), 'Waiting for market and news updates…') AS line FROM c JOIN t USING (day)")
def what_changed(spark, sf_dir):
    w = timeseries.ordered()
    week = indexed(spark, sf_dir).select("day", F.row_number().over(w).alias("n"), ((F.col("risk_index") / F.lag("risk_index", 7).over(w) - 1) * 100).alias("ch"))
    moves = A.articles(spark, sf_dir).groupBy("day", "event_type").agg(((F.avg("value") - 50) / 100).alias("mv"))
    top = moves.groupBy("day").agg(F.max_by(F.struct("event_type", "mv"), F.struct(F.abs("mv"), "event_type")).alias("t")).select("day", "t.*")
    return week.join(top, "day").select("day", labels.what_changed(F.col("n"), F.col("ch"), F.col("event_type"), F.col("mv")).alias("line"))


# --- payloads


@query(f"{W}{RISK_SQL} SELECT strftime(max(day), '%Y-%m-%d') AS date, count(*) AS n_rows, max(day) < DATE '2024-02-10' AS stale, (SELECT route FROM route_days WHERE day = (SELECT max(day) FROM route_days) ORDER BY route LIMIT 1) AS first_route FROM route_days WHERE day = (SELECT max(day) FROM route_days)")
def corridor_payload(spark, sf_dir):
    """The board's rows in an envelope of date, disclaimer, registry and staleness, as JSON, read back."""
    last = timeseries.latest(route_days(spark, sf_dir).select("route", "day", F.round("route_risk", 6).alias("route_risk")), ["route"], "day")
    rows = F.array_sort(F.collect_list(F.struct("route", "route_risk")))  # one a route
    packed = last.agg(F.max("day").alias("day"), rows.alias("rows")).select(
        F.to_json(F.struct(F.date_format("day", "yyyy-MM-dd").alias("date"), F.lit("Model output, no advice").alias("disclaimer"), F.lit(len(C.ROUTES)).alias("routes"), writers.renamed("rows", "route", "corridor").alias("rows"), (F.col("day") < F.lit("2024-02-10").cast("date")).alias("stale"))).alias("payload")
    )
    get = lambda p: F.get_json_object("payload", p)
    return packed.select(get("$.date").alias("date"), F.json_array_length(get("$.rows")).cast("long").alias("n_rows"), get("$.stale").cast("boolean").alias("stale"), get("$.rows[0].corridor").alias("first_route"))


@query(f"{W}{INDEX_SQL}, l AS (SELECT max(day) AS live, count(*) AS n FROM indexed) SELECT doc_id, live AS live_through, n AS index_days, CASE WHEN DATE '2024-01-01' + CAST(doc_id % 60 AS INTEGER) < live THEN 'Offline benchmarks predate the current index. Re-run validate after index rebuild.' END AS stale_reason FROM documents, l")
def report_meta(spark, sf_dir):
    live = indexed(spark, sf_dir).agg(F.max("day").alias("live_through"), F.count("*").alias("index_days"))
    made = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 60).cast("int"))
    rows = A.table(spark, sf_dir, "documents").select("doc_id", made.alias("made")).crossJoin(live)  # one row on the right
    return rows.select("doc_id", "live_through", "index_days", labels.stale_reason(F.col("made"), F.col("live_through")).alias("stale_reason"))


@query(f"SELECT 'bucket' AS section, bucket AS name, n, pct AS figure FROM ({ORACLE_SQL['score_buckets']}) UNION ALL SELECT 'type', risk_type, n, share FROM ({ORACLE_SQL['type_shares']}) UNION ALL SELECT 'threshold', CAST(threshold AS VARCHAR), NULL, positive_pct FROM ({ORACLE_SQL['threshold_sensitivity']})")
def report_sections(spark, sf_dir):
    """Sections of different shape as one report."""
    named = lambda q, section, name, figure: QUERIES[q](spark, sf_dir).withColumns({"section": F.lit(section), "name": F.col(name).cast("string"), "figure": F.col(figure)})
    parts = [named("score_buckets", "bucket", "bucket", "pct"), named("type_shares", "type", "risk_type", "share"), named("threshold_sensitivity", "threshold", "threshold", "positive_pct")]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).select("section", "name", "n", "figure")


# --- series


@query(f"{W}{OBSERVED_SQL}, f AS (SELECT day, last_value(risk_index IGNORE NULLS) OVER (ORDER BY day ROWS UNBOUNDED PRECEDING) AS x FROM rows_), m AS (SELECT avg(x) FILTER (WHERE day >= DATE '{A.CUT}') AS m FROM f), r AS (SELECT day, CASE WHEN day >= DATE '{A.CUT}' THEN x * 100 / m ELSE x END AS x FROM f, m) SELECT day, round(x, 6) AS risk_index, CASE WHEN day >= DATE '{A.CUT}' THEN round(avg(x) OVER (PARTITION BY day >= DATE '{A.CUT}' ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 6) END AS ma7 FROM r")
def rescale_split(spark, sf_dir):
    """The later era of a filled series scaled to mean 100, its moving mean taken again."""
    rows = gaps.fill(R.observed(spark, sf_dir), "2024-01-01", "2024-01-31", "forward", ["risk_index"])
    scaled = timeseries.with_scope(gaps.rescale(rows, ["risk_index"], A.CUT), A.CUT)
    late = F.when(F.col("_era") != "warmup", timeseries.moving_mean("risk_index", 7, ["_era"]))
    return scaled.select("day", F.round("risk_index", 6).alias("risk_index"), F.round(late, 6).alias("ma7"))


CORRIDOR_EVENTS = (("2024-01-12", "strait_of_malacca", "one"), ("2024-01-20", "india_china_lac", "two"), ("2024-01-25", "red_sea_suez", "three"), ("2025-06-01", "imec", "out of range"))
_events = ", ".join(f"(DATE '{d}', '{r}', '{n}')" for d, r, n in CORRIDOR_EVENTS)
_near, _prior = "p.day BETWEEN d - 3 AND d + 3", "p.day BETWEEN d - 30 AND d - 4"


@query(f"{W}{RISK_SQL}, e AS (SELECT * FROM (VALUES {_events}) AS v(d, route, label)), z AS (SELECT label, avg(threat_index) FILTER (WHERE {_near}) AS m, avg(threat_index) FILTER (WHERE {_prior}) AS b, stddev_samp(threat_index) FILTER (WHERE {_prior}) AS s, count(*) FILTER (WHERE {_prior}) AS n FROM e JOIN route_days p ON p.route = e.route AND ({_near} OR {_prior}) GROUP BY label) SELECT e.label, e.route, round(CASE WHEN n >= 2 AND s > 0 THEN (m - b) / s END, 6) AS z, CASE WHEN coalesce(n, 0) < 2 OR coalesce(s, 0) <= 0 OR m IS NULL THEN 'N/A' WHEN (m - b) / s > 1 THEN 'YES' ELSE 'NO' END AS pass FROM e LEFT JOIN z USING (label)")
def corridor_event_response(spark, sf_dir):
    """Each known event against its own route's days before; N/A where that can't be said."""
    events = spark.createDataFrame(list(CORRIDOR_EVENTS), "d string, route string, label string").select(F.to_date("d").alias("event_day"), F.col("route").alias("event_route"), "label")
    series = route_days(spark, sf_dir).select("day", "route", "threat_index").join(F.broadcast(events.select("event_route").distinct()), F.col("route") == F.col("event_route"), "left_semi")
    z = timeseries.event_z(series, events, "threat_index", keys=["route"]).where("route = event_route")
    out = events.join(z.select("label", "z"), "label", "left")
    return out.select("label", F.col("event_route").alias("route"), F.round("z", 6).alias("z"), F.when(F.col("z").isNull(), "N/A").when(F.col("z") > 1, "YES").otherwise("NO").alias("pass"))


@query()
def parity_smoke(spark, sf_dir):
    """Routes of articles against those found again in text made of their place names: rates and their difference."""
    rows = A.articles(spark, sf_dir).withColumn("line", text.text_of_locations(F.col("locations")))
    rows = rows.withColumn("again", text.place_blocks(F.col("line"), text.route_gazetteer()))
    both = rows.select(text.routes(F.col("locations")).alias("given"), text.routes(F.col("again")).alias("found"))
    marks = both.select(F.inline(F.concat(F.transform("given", lambda r: F.struct(r.alias("route"), F.lit(1).alias("g"), F.lit(0).alias("f"))), F.transform("found", lambda r: F.struct(r.alias("route"), F.lit(0).alias("g"), F.lit(1).alias("f"))))))
    counts = marks.groupBy("route").agg(F.sum("g").alias("given"), F.sum("f").alias("found"))
    total = A.articles(spark, sf_dir).agg(F.count("*").alias("n"))
    every = routes.registry(spark).select("route").join(counts, "route", "left").na.fill(0).crossJoin(total)  # one row on the right
    rate = lambda c: F.col(c) / F.col("n")
    return every.select("route", "given", "found", F.round(rate("found") - rate("given"), 6).alias("difference"), ((F.col("given") > 0) & (F.col("found") == 0)).alias("silent_drop"))


_lineitem = "li AS (SELECT CAST(l_shipdate AS DATE) AS day, round(avg(l_quantity), 6) AS q FROM lineitem GROUP BY 1), li2 AS (SELECT day, ln(q + 1) AS x FROM li)"
_mk = ", ".join([_full(VOL, "lr", 5, "stddev_samp") + " AS rv5", _full(" * 100", "lr", 5, "sum") + " AS ret5", _ahead(VOL, "lr", 5, "stddev_samp") + " AS target"])


@query(f"{W}{LR_SQL}, m AS (SELECT day, {_mk} FROM lr_), {_lineitem}, f AS (SELECT day, x AS log_q, {_full('', 'x', 5, 'avg')} AS q_ma5, x - lag(x) OVER (ORDER BY day) AS q_chg1 FROM li2) SELECT m.day, round(rv5, 4) AS rv5, round(ret5, 4) AS ret5, round(target, 4) AS target, round(log_q, 6) AS log_q, round(q_ma5, 6) AS q_ma5, round(q_chg1, 6) AS q_chg1 FROM m ASOF JOIN f ON m.day >= f.day WHERE rv5 IS NOT NULL AND ret5 IS NOT NULL AND target IS NOT NULL AND q_ma5 IS NOT NULL AND q_chg1 IS NOT NULL")
def feature_matrix(spark, sf_dir):
    """Market features, the index's features as of each day, and the target; complete rows only."""
    market = signal.returns(A.daily_prices(spark, sf_dir))
    market = market.select("day", signal.realized_vol(5).alias("rv5"), (timeseries.full_window(F.col("lr"), 5, F.sum) * 100.0).alias("ret5"), signal.forward_vol(5).alias("target")).na.drop()
    level = A.table(spark, sf_dir, "lineitem").groupBy(F.to_date("l_shipdate").alias("day")).agg(F.round(F.avg("l_quantity"), 6).alias("q"))
    index = signal.index_features(level, ["q"], (5, 22, 66)).select("day", "log_q", "q_ma5", "q_chg1")
    out = signal.assemble(market, index, ["log_q", "q_ma5", "q_chg1"], "target")
    return out.select("day", *[F.round(c, 4).alias(c) for c in ("rv5", "ret5", "target")], *[F.round(c, 6).alias(c) for c in ("log_q", "q_ma5", "q_chg1")])


def _forecast(spark, sf_dir) -> DataFrame:
    market = signal.market_features(A.daily_prices(spark, sf_dir)).withColumn("target", signal.forward_vol(5))
    own, joint = ["rv5", "rv22", "ret5", "drawdown"], ["rv5", "rv22", "ret5", "drawdown", "rv66", "ret22"]
    return model.latest(market, {"market": own, "market_and_trend": joint}, "target")


@query()
def latest_forecast(spark, sf_dir):
    """The models of all rows with a known outcome, applied to the last row, combined with its regime."""
    one = _forecast(spark, sf_dir).groupBy("block").agg(F.first("as_of").alias("as_of"), F.first("predicted").alias("predicted"), F.first("probability").alias("probability"))
    return one.withColumn("regime", bands.vol_regime(F.col("probability")))


@query()
def feature_importance(spark, sf_dir):
    """Each feature's share of the gains of all splits (in place of SHAP values)."""
    return _forecast(spark, sf_dir).select("block", "feature", "importance")


# --- the quality report: checks of the index, of the routes, of feeds and of the benchmark

LIMITS = {
    "index_days": ("x >= 30", lambda x: x >= 30), "index_mean": ("abs(x - 100) < 0.001", lambda x: F.abs(x - 100) < 0.001), "index_std": ("x BETWEEN 20 AND 60", lambda x: x.between(20, 60)),
    "index_skew": ("x > 0", lambda x: x > 0), "index_p99": ("x >= 150", lambda x: x >= 150), "index_autocorr": ("x > 0.3", lambda x: x > 0.3), "positive_share": ("x BETWEEN 0.05 AND 0.5", lambda x: x.between(0.05, 0.5)),
    "benchmark_corr": ("x > 0.5", lambda x: x > 0.5), "gap_days": ("x = 0", lambda x: x == 0), "route_leakage": ("x = 0", lambda x: x == 0), "routes_scored": ("x >= 1", lambda x: x >= 1),
    "route_coverage": ("x >= 0.2", lambda x: x >= 0.2), "slot_bias": ("x <= 0.1", lambda x: x <= 0.1), "tagged_pct": ("x >= 95", lambda x: x >= 95), "duplicate_pct": ("x <= 20", lambda x: x <= 20), "vol_model_auc": ("x > 0.5", lambda x: x > 0.5),
}
_slot = "(CAST(strftime(event_time, '%H') AS INTEGER) * 4 + CAST(strftime(event_time, '%M') AS INTEGER) // 15) % 4 = 0"
_sources = {
    "index_days": "SELECT count(*) FROM indexed", "index_mean": "SELECT avg(risk_index) FROM indexed", "index_std": "SELECT stddev_samp(risk_index) FROM indexed", "index_skew": "SELECT skewness(risk_index) FROM indexed",
    "index_p99": "SELECT quantile_cont(risk_index, 0.99) FROM indexed", "index_autocorr": "SELECT corr(risk_index, p) FROM (SELECT risk_index, lag(risk_index) OVER (ORDER BY day) AS p FROM indexed)",
    "positive_share": "SELECT sum(positive_count) / sum(total_articles) FROM indexed", "benchmark_corr": "SELECT corr(risk_index, bench) FROM indexed JOIN bench USING (day)", "gap_days": "SELECT count(*) FROM rows_ WHERE is_imputed",
    "route_leakage": "SELECT count(*) FROM (SELECT route FROM route_days JOIN (SELECT day, risk_index FROM indexed) USING (day) GROUP BY route HAVING abs(CASE WHEN stddev_pop(threat_index) > 0 THEN corr(threat_index, risk_index) END) > 0.95)",
    "routes_scored": "SELECT count(DISTINCT route) FROM route_days WHERE score_status = 'ok'", "route_coverage": "SELECT sum(matched_positive_articles) / sum(positive_articles) FROM per_day",
    "slot_bias": f"SELECT abs(avg(s - f) / avg(f)) FROM (SELECT day, sum(CASE WHEN risk_score > 0.2 THEN risk_score ELSE 0 END) / count(*) AS f FROM scored GROUP BY day) JOIN (SELECT day, sum(CASE WHEN risk_score > 0.2 THEN risk_score ELSE 0 END) / count(*) AS s FROM scored WHERE {_slot} GROUP BY day) USING (day)",
    "tagged_pct": "SELECT 100.0 * count(*) FILTER (WHERE event_type <> 'view') / count(*) FROM scored", "duplicate_pct": "SELECT 100.0 * count(*) FILTER (WHERE id % 11 = 0) / count(*) FROM scored", "vol_model_auc": "SELECT NULL",
}
_checks = " UNION ALL ".join(f"SELECT '{k}' AS id, CAST(x AS DOUBLE) AS value, CASE WHEN x IS NULL THEN 'na' WHEN {LIMITS[k][0]} THEN 'pass' ELSE 'fail' END AS status FROM (SELECT round(CAST(({sql}) AS DOUBLE) + 1e-9, 6) AS x)" for k, sql in _sources.items())
QUALITY_SQL = RISK_SQL + ", " + INDEX_SQL[len(A.SCORED_SQL) + 1 :].lstrip(", \n") + ", " + OBSERVED_SQL[len(INDEX_SQL) + 1 :].lstrip(", \n") + f", bench AS (SELECT CAST(ts AS DATE) AS day, round(avg(value), 6) AS bench FROM events GROUP BY 1), checks AS ({_checks})"


def checks(spark, sf_dir) -> DataFrame:
    """``id, value, status`` of every check: one-row figures of each producer, joined and turned into records."""
    index, scored = indexed(spark, sf_dir), A.scored(spark, sf_dir)
    lagged = index.withColumn("p", F.lag("risk_index", 1).over(timeseries.ordered()))
    one = lagged.agg(
        F.count("*").cast("double").alias("index_days"), F.avg("risk_index").alias("index_mean"), F.stddev_samp("risk_index").alias("index_std"), stats.skew("risk_index").alias("index_skew"),
        stats.quantile("risk_index", 0.99).alias("index_p99"), stats.correlation("risk_index", "p").alias("index_autocorr"), (F.sum("positive_count") / F.sum("total_articles")).alias("positive_share"),
    )
    bench = index.join(R.bench(spark, sf_dir), "day").agg(stats.correlation("risk_index", "bench").alias("benchmark_corr"))
    missing = timeseries.missing_days(R.observed(spark, sf_dir), "2024-01-01", "2024-01-31").agg(F.count("*").cast("double").alias("gap_days"))
    days = route_days(spark, sf_dir).join(index.select("day", "risk_index"), "day")
    per_route = days.groupBy("route").agg(stats.correlation("threat_index", "risk_index").alias("c"), F.max((F.col("score_status") == "ok").cast("double")).alias("ok"), F.sum("positive_articles").alias("p"), F.sum("matched_positive_articles").alias("m"))
    route = per_route.agg(F.count_if(F.abs("c") > 0.95).cast("double").alias("route_leakage"), F.sum("ok").alias("routes_scored"), (F.max("m") / F.max("p")).alias("route_coverage"))
    slot = (F.hour("event_time") * 4 + F.floor(F.minute("event_time") / 15)) % 4 == 0
    value = F.when(F.col("risk_score") > 0.2, F.col("risk_score")).otherwise(0.0)
    daily = scored.groupBy("day").agg((F.sum(value) / F.count("*")).alias("f"), (F.sum(F.when(slot, value)) / F.count_if(slot)).alias("s")).where("s is not null")
    bias = daily.agg(F.abs(F.avg(F.col("s") - F.col("f")) / F.avg("f")).alias("slot_bias"))
    feeds = scored.agg((100.0 * F.count_if(F.col("event_type") != "view") / F.count("*")).alias("tagged_pct"), (100.0 * F.count_if(F.col("id") % 11 == 0) / F.count("*")).alias("duplicate_pct"))
    all_ = reduce(lambda a, b: a.crossJoin(b), [one, bench, missing, route, bias, feeds]).withColumn("vol_model_auc", F.lit(None).cast("double"))  # one row each
    rounded = {k: F.round(F.col(k) + 1e-9, 6) for k in LIMITS}
    records = F.array(*[feed.check(k, v, LIMITS[k][1](v), LIMITS[k][0]) for k, v in rounded.items()])
    return all_.select(F.inline(records)).select("id", "value", "status")


@query(f"{W}{QUALITY_SQL} SELECT id, value, status FROM checks")
def quality_report(spark, sf_dir):
    return checks(spark, sf_dir)


@query(f"{W}{QUALITY_SQL} SELECT count(*) FILTER (WHERE status = 'pass') AS pass, count(*) FILTER (WHERE status = 'fail') AS fail, count(*) FILTER (WHERE status = 'warn') AS warn, count(*) FILTER (WHERE status = 'na') AS na, CASE WHEN bool_or(status = 'fail') THEN 'fail' WHEN bool_or(status = 'warn') THEN 'warn' WHEN bool_or(status = 'pass') THEN 'pass' ELSE 'na' END AS overall FROM checks")
def quality_summary(spark, sf_dir):
    return feed.checks_summary(checks(spark, sf_dir))


_rank = "CASE status WHEN 'pass' THEN 0 WHEN 'warn' THEN 1 WHEN 'fail' THEN 2 WHEN 'na' THEN 3 ELSE 4 END"


@query(f"{W}{QUALITY_SQL} SELECT id, status FROM checks ORDER BY {_rank}, id LIMIT 12")
def quality_cells(spark, sf_dir):
    return feed.check_cells(checks(spark, sf_dir), 12).select("id", "status")


_fixed = ("benchmark_corr", "route_leakage", "vol_model_auc")


@query(f"{W}{QUALITY_SQL}, s AS (SELECT *, coalesce(list_position([{A.listed(_fixed)}], id), 99) AS slot, count(*) FILTER (WHERE id IN ({A.listed(_fixed)})) OVER () AS n FROM checks) SELECT id, status FROM s WHERE slot < 99 OR (n < 4 AND status <> 'na') ORDER BY slot, id LIMIT 5")
def quality_headlines(spark, sf_dir):
    return feed.headline_checks(checks(spark, sf_dir), _fixed).select("id", "status")


_bundle = {"home": ("news_stats", "total", "canonical"), "health": ("health_snapshot", "documents", "sources"), "quality": ("quality_summary", "pass", "overall"), "signal": ("readiness", "n_days", "ready"), "routes": ("corridor_payload", "n_rows", "first_route"), "archive": ("slot_sample_bias", "n_days", "pass")}


@query(" UNION ALL ".join(f"SELECT '{page}' AS page, CAST({one} AS VARCHAR) AS first, CAST({two} AS VARCHAR) AS second FROM ({ORACLE_SQL[name]})" for page, (name, one, two) in _bundle.items()))
def page_bundles(spark, sf_dir):
    """Each page's figures as one JSON payload, and two of them read back."""
    parts = []
    for page, (name, one, two) in _bundle.items():
        rows = QUERIES[name](spark, sf_dir)
        payload = rows.select(F.to_json(F.struct(*rows.columns)).alias("payload"))
        parts.append(payload.select(F.lit(page).alias("page"), F.get_json_object("payload", f"$.{one}").alias("first"), F.get_json_object("payload", f"$.{two}").alias("second")))
    return reduce(DataFrame.union, parts)
