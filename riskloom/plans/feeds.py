"""Queries of feeds, boards, checks and payloads."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import bands
from ..operators import feed, tables, timeseries
from ..sources import writers
from . import articles as A
from .registry import query
from .texts import TOKENS_SQL, topic_sql
from .risk import INDEX_SQL, W, indexed

ROWS_SQL = f"{A.ARTICLES_SQL}, feed AS (SELECT id, event_time, CASE WHEN user_id % 4 = 0 THEN 1 WHEN user_id % 4 = 3 THEN NULL ELSE 2 END AS tier, CASE WHEN id % 11 = 0 THEN id - 1 END AS duplicate_of, CASE WHEN event_type = 'view' THEN '' ELSE themes END AS themes, locations, 'Title ' || event_type || CASE WHEN k % 9 = 0 THEN ' stock market' ELSE '' END AS title, tone_neg FROM articles)"


def rows(spark, sf_dir):
    return A.articles(spark, sf_dir).select(
        "id",
        "event_time",
        F.when(F.col("user_id") % 4 == 0, 1).when(F.col("user_id") % 4 == 3, None).otherwise(2).alias("tier"),
        F.when(F.col("id") % 11 == 0, F.col("id") - 1).alias("duplicate_of"),
        F.when(F.col("event_type") == "view", "").otherwise(F.col("themes")).alias("themes"),
        "locations",
        F.concat(F.lit("Title "), "event_type", F.when(F.col("k") % 9 == 0, " stock market").otherwise("")).alias("title"),
        "tone_neg",
    )


@query(f"{W}{ROWS_SQL} SELECT id, title FROM feed WHERE tier = 2 AND duplicate_of IS NULL AND themes ILIKE '%BORDER_DISPUTE%' AND (themes ILIKE '%strait%' OR locations ILIKE '%mal_cca%' OR title ILIKE '%x%') AND event_time >= TIMESTAMP '2024-01-05' AND event_time < TIMESTAMP '2024-01-25' AND trim(themes) <> '' ORDER BY event_time DESC NULLS LAST, id LIMIT 50")
def feed_filter(spark, sf_dir):
    wanted = rows(spark, sf_dir).where(feed.matching(tier=2, theme="BORDER_DISPUTE", route="mal_cca", start="2024-01-05", end="2024-01-25", tagged_only=True))
    return feed.newest(wanted, 50).select("id", "title")


_score = "(epoch_us(event_time) // 1000) / 1e12 + CASE WHEN tier = 1 THEN 100 WHEN tier = 2 THEN 40 ELSE 0 END + CASE WHEN trim(themes) <> '' THEN 20 ELSE 0 END + CASE WHEN contains(upper(themes), 'COUP') THEN 30 ELSE 0 END + CASE WHEN tier <= 1 THEN 15 ELSE 0 END"


@query(f"{W}{ROWS_SQL} SELECT id, round({_score}, 9) AS score FROM feed ORDER BY {_score} DESC, id LIMIT 8")
def brief_rank(spark, sf_dir):
    scored = rows(spark, sf_dir).select("id", feed.brief_score(["COUP"], 1).alias("score"))
    return scored.orderBy(F.desc("score"), "id").limit(8).select("id", F.round("score", 9).alias("score"))


_body = "lower(concat_ws(' ', title, themes, locations))"
_geo = " OR ".join(f"contains(b, '{t}')" for t in ("armedconflict", "terror", "invasion", "coup", "sanction", "blockade", "war", "military", "border", "nuclear", "conflict", "geopolit", "missile", "strike", "escalat"))


@query(f"{W}{ROWS_SQL}, g AS (SELECT *, contains(b, 'market') OR contains(b, 'stock') AS m, contains(b, 'malacca') OR contains(b, 'strait') AS c FROM (SELECT *, {_body} AS b FROM feed) WHERE tier = 1 OR {_geo} OR tone_neg >= 0.35), k AS (SELECT *, (SELECT count(*) FROM g WHERE m OR c) AS nb FROM g) SELECT id, CASE WHEN c THEN 'corridor_match' WHEN m THEN 'market_keyword' ELSE 'geo_theme' END AS why FROM k WHERE m OR c OR nb < 3 ORDER BY (m OR c) DESC, event_time DESC, id LIMIT 8")
def driving_select(spark, sf_dir):
    return feed.driving(rows(spark, sf_dir), ("market", "stock"), "strait_of_malacca").select("id", "why")


@query(f"{W}{ROWS_SQL} SELECT id, tier FROM feed ORDER BY CASE WHEN tier = 1 THEN 0 WHEN trim(themes) <> '' THEN 1 ELSE 2 END, id LIMIT 1")
def hero_pick(spark, sf_dir):
    return feed.hero(rows(spark, sf_dir).select("id", "tier", "themes"), by="id").select("id", "tier")


@query(f"{W}{A.ARTICLES_SQL}, t AS (SELECT id, {topic_sql(TOKENS_SQL)} AS topic FROM articles) SELECT topic, count(*) AS n FROM t WHERE topic <> 'General' GROUP BY topic ORDER BY n DESC, min(id) LIMIT 1")
def dominant_topic(spark, sf_dir):
    return feed.dominant_topic(A.articles(spark, sf_dir).select("themes", "id"), by="id").select("topic", "n")


@query(f"{W}{ROWS_SQL} SELECT count(*) AS total, count(*) FILTER (WHERE tier IS NOT NULL AND duplicate_of IS NULL) AS canonical, epoch_us(max(event_time)) // 1000 AS latest_ms, bool_or(trim(themes) <> '') AS any_tagged, round(100.0 * count(*) FILTER (WHERE trim(themes) <> '') / nullif(count(*), 0), 6)::DOUBLE AS tagged_pct FROM feed")
def news_stats(spark, sf_dir):
    tagged = F.trim("themes") != ""
    return rows(spark, sf_dir).agg(
        F.count("*").alias("total"),
        F.count_if(F.col("tier").isNotNull() & F.col("duplicate_of").isNull()).alias("canonical"),
        F.unix_millis(F.max("event_time")).alias("latest_ms"),
        F.bool_or(tagged).alias("any_tagged"),
        F.round(F.coalesce(F.try_divide(100.0 * F.count_if(tagged), F.count("*")), F.lit(None).cast("double")), 6).alias("tagged_pct"),
    )


@query("WITH s AS (SELECT event_type AS stage, CASE WHEN value > 100 THEN 'fail' WHEN value > 60 THEN 'warn' ELSE 'pass' END AS status, value FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY) SELECT stage, status, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents FROM s GROUP BY 1, 2")
def ops_metrics(spark, sf_dir):
    events = A.table(spark, sf_dir, "events").select("event_type", "value", F.col("ts").cast("timestamp").alias("ts"))
    last = events.agg(F.max("ts").alias("last"))
    recent = events.crossJoin(last).where(F.col("ts") >= F.col("last") - F.expr("INTERVAL 7 DAYS"))  # one row on the right
    status = F.when(F.col("value") > 100, "fail").when(F.col("value") > 60, "warn").otherwise("pass")
    return recent.groupBy(F.col("event_type").alias("stage"), status.alias("status")).agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"))


@query(f"{W}{INDEX_SQL}, m AS (SELECT avg(risk_index) AS a, count(*) AS n, max(ma30) AS x, corr(risk_index, acts_index) AS r FROM indexed), c AS (SELECT 'mean' AS id, CASE WHEN abs(a - 100) < 0.001 THEN 'pass' ELSE 'fail' END AS status FROM m UNION ALL SELECT 'days', CASE WHEN n >= 30 THEN 'pass' ELSE 'fail' END FROM m UNION ALL SELECT 'tail', CASE WHEN x > 1000 THEN 'pass' ELSE 'fail' END FROM m UNION ALL SELECT 'none', 'na') SELECT count(*) FILTER (WHERE status = 'pass') AS pass, count(*) FILTER (WHERE status = 'fail') AS fail, count(*) FILTER (WHERE status = 'warn') AS warn, count(*) FILTER (WHERE status = 'na') AS na, CASE WHEN bool_or(status = 'fail') THEN 'fail' WHEN bool_or(status = 'warn') THEN 'warn' WHEN bool_or(status = 'pass') THEN 'pass' ELSE 'na' END AS overall FROM c")
def quality_tally(spark, sf_dir):
    m = indexed(spark, sf_dir).agg(F.avg("risk_index").alias("a"), F.count("*").alias("n"), F.max("ma30").alias("x"))
    checks = F.array(
        feed.check("mean", F.col("a"), F.abs(F.col("a") - 100) < 0.001, "100"),
        feed.check("days", F.col("n"), F.col("n") >= 30, ">= 30"),
        feed.check("tail", F.col("x"), F.col("x") > 1000, "> 1000"),
        feed.check("none", F.lit(None).cast("double"), F.lit(True), "any"),
    )
    return feed.checks_summary(m.select(F.inline(checks)))


@query("SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM labels) AS labelled, (SELECT count(DISTINCT source) FROM documents) AS sources, (SELECT epoch_us(max(ts)) // 1000 FROM events) AS latest_ms, (SELECT max(o_orderdate)::DATE FROM orders) AS last_order")
def health_snapshot(spark, sf_dir):
    t = lambda n: A.table(spark, sf_dir, n)
    one = t("documents").agg(F.count("*").alias("documents"), F.countDistinct("source").alias("sources"))
    two = t("labels").agg(F.count("*").alias("labelled"))
    three = t("events").agg(F.unix_millis(F.max(F.col("ts").cast("timestamp"))).alias("latest_ms"))
    return one.crossJoin(two).crossJoin(three).crossJoin(t("orders").agg(F.to_date(F.max("o_orderdate")).alias("last_order")))  # one row each


@query(f"{W}{INDEX_SQL} SELECT day, CASE WHEN risk_index >= 135 THEN 'ELEVATED' WHEN risk_index >= 100 THEN 'MODERATE' ELSE 'LOW' END AS index_regime, day > (SELECT max(day) FROM indexed) - 2 AS fresh FROM indexed")
def index_labels(spark, sf_dir):
    from pyspark.sql import Window

    return indexed(spark, sf_dir).select("day", bands.index_regime(F.col("risk_index")).alias("index_regime"), (F.col("day") > F.date_sub(F.max("day").over(Window.partitionBy()), 2)).alias("fresh"))


@query(f"{W}{A.ARTICLES_SQL} SELECT day, 'h' AS tag, CAST(count(*) AS VARCHAR) AS n, round(100.0 * count(*) FILTER (WHERE event_type = 'error') / count(*), 6)::DOUBLE AS discarded_pct FROM articles GROUP BY day")
def cycle_yield(spark, sf_dir):
    d = A.articles(spark, sf_dir).groupBy("day").agg(F.count("*").alias("c"), F.count_if(F.col("event_type") == "error").alias("e"))
    packed = writers.payload(d.select("day", F.lit("h").alias("tag"), F.col("c").alias("n"), (100.0 * F.col("e") / F.col("c")).alias("pct")), "day")
    return packed.select("day", F.get_json_object("payload", "$.tag").alias("tag"), F.get_json_object("payload", "$.n").alias("n"), F.round(F.get_json_object("payload", "$.pct").cast("double"), 6).alias("discarded_pct"))


@query(f"{W}{ROWS_SQL}, p AS (SELECT * FROM feed WHERE themes IS NULL OR themes = '' ORDER BY event_time, id LIMIT 100) SELECT id FROM p")
def pending_batch(spark, sf_dir):
    """The oldest articles without tags, one batch of them."""
    pending = F.col("themes").isNull() | (F.col("themes") == "")
    return rows(spark, sf_dir).where(pending).orderBy("event_time", "id").limit(100).select("id")


@query(f"{W}{ROWS_SQL} SELECT id, CASE WHEN id % 5 = 0 THEN 'NEW' ELSE themes END AS themes, tier FROM feed")
def update_tags(spark, sf_dir):
    old = rows(spark, sf_dir).select("id", "themes", "tier")
    changes = old.where("id % 5 = 0").select("id", F.lit("NEW").alias("themes"))
    return tables.update_columns(old, changes, ["id"], ["themes"])


@query(f"{W}{A.ARTICLES_SQL} SELECT user_id, event_type AS last_type, n FROM (SELECT user_id, event_type, count(*) OVER (PARTITION BY user_id) AS n, row_number() OVER (PARTITION BY user_id ORDER BY event_time DESC, id DESC) AS r FROM articles) WHERE r = 1")
def last_run(spark, sf_dir):
    a = A.articles(spark, sf_dir)
    return a.groupBy("user_id").agg(F.max_by("event_type", F.struct("event_time", "id")).alias("last_type"), F.count("*").alias("n"))


@query(f"{W}{A.ARTICLES_SQL}, q AS (SELECT event_type, arg_max(value, (event_time, id)) AS last, arg_min(value, (event_time, id)) AS first FROM articles GROUP BY 1) SELECT event_type, first, last, round(CASE WHEN first = 0 THEN 0 ELSE (last - first) / first * 100 END, 6) AS change_pct FROM q")
def quote_change(spark, sf_dir):
    at = F.struct("event_time", "id")
    q = A.articles(spark, sf_dir).groupBy("event_type").agg(F.max_by("value", at).alias("last"), F.min_by("value", at).alias("first"))
    return q.select("event_type", "first", "last", F.round(bands.percent_change(F.col("first"), F.col("last")), 6).alias("change_pct"))


@query(f"{W}{A.ARTICLES_SQL} SELECT id, event_type FROM (SELECT id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY event_time DESC, id DESC) AS r FROM articles) WHERE r <= 5")
def tail_rows(spark, sf_dir):
    keyed = A.articles(spark, sf_dir).withColumn("at", F.struct("event_time", "id"))
    return timeseries.tail(keyed, 5, "at", ["event_type"]).select("id", "event_type")


