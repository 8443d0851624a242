"""Queries of scores, rollups, routes and indices."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import bands, text
from ..functions import constants as C
from ..operators import gaps, joins, rollup, routes, scoring, stats, tables, timeseries
from . import articles as A
from .registry import query


def r6(*names: str):
    """Rounded columns; the tiny shift keeps exact halves from falling either way."""
    return [F.round(F.col(n).cast("double") + 1e-9, 6).alias(n) for n in names]


def s6(*names: str) -> str:
    return ", ".join(f"round(CAST({n} AS DOUBLE) + 1e-9, 6) AS {n}" for n in names)


SCORES = ("theme_score", "tone_score", "dim_score", "risk_score")
W = "WITH "


@query(f"{W}{A.SCORED_SQL} SELECT id, risk_type, category, {s6(*SCORES)} FROM scored")
def article_scores(spark, sf_dir):
    return A.scored(spark, sf_dir).select("id", "risk_type", "category", *r6(*SCORES))


SUMS = ("risk_sum", "acts_sum", "threats_sum", "mean_score", "mean_theme_score", "mean_tone_score", "mean_dim_score", "positive_share", "raw_ratio", "acts_ratio", "threats_ratio")
CATS = tuple(f"sum_{c}" for c in C.CATEGORY_NAMES)
_pos = "risk_score > 0.2"
DAYS_SQL = (
    A.SCORED_SQL
    + f""",
sums AS (SELECT day, count(*) AS total_articles, count(*) FILTER (WHERE risk_score > 0) AS candidate_count, count(*) FILTER (WHERE {_pos}) AS positive_count,
  coalesce(sum(risk_score) FILTER (WHERE {_pos}), 0) AS risk_sum, coalesce(sum(risk_score) FILTER (WHERE {_pos} AND risk_type = 'act'), 0) AS acts_sum,
  coalesce(sum(risk_score) FILTER (WHERE {_pos} AND risk_type IN ('threat', 'context')), 0) AS threats_sum, coalesce(avg(risk_score) FILTER (WHERE {_pos}), 0) AS mean_score,
  {", ".join(f"coalesce(avg({c}) FILTER (WHERE {_pos}), 0) AS mean_{c}" for c in SCORES[:3])},
  {", ".join(f"coalesce(sum(risk_score) FILTER (WHERE category = '{c}'), 0) AS sum_{c}" for c in C.CATEGORY_NAMES)} FROM scored GROUP BY day),
days AS (SELECT *, positive_count / total_articles AS positive_share, risk_sum / total_articles AS raw_ratio, acts_sum / total_articles AS acts_ratio, threats_sum / total_articles AS threats_ratio FROM sums)"""
)
COUNTS = ("total_articles", "candidate_count", "positive_count")


@query(f"{W}{DAYS_SQL} SELECT day, {', '.join(COUNTS)}, {s6(*SUMS, *CATS)} FROM days")
def daily_rollup(spark, sf_dir):
    return rollup.daily(A.scored(spark, sf_dir)).select("day", *COUNTS, *r6(*SUMS, *CATS))


def index_sql(source: str, pairs, era: str, start=A.BASE_START, end=A.BASE_END, exponent=C.TAIL_EXPONENT, stretch=C.UPPER_STRETCH) -> str:
    """CTEs ``i_<n>`` that turn ratios of ``source`` into indices per era."""
    out, last = [f"e0 AS (SELECT *, {era} AS era FROM {source})"], "e0"
    for n, (ratio, name) in enumerate(pairs):
        base = f"coalesce(avg({ratio}) FILTER (WHERE day BETWEEN DATE '{start}' AND DATE '{end}') OVER (PARTITION BY era), avg({ratio}) OVER (PARTITION BY era))"
        out += [
            f"a{n} AS (SELECT *, {ratio} / (CASE WHEN {base} > 0 THEN {base} ELSE 1 END) AS r FROM {last})",
            f"b{n} AS (SELECT *, CASE WHEN avg(r) OVER (PARTITION BY era) = 0 THEN 0 ELSE pow(r / avg(r) OVER (PARTITION BY era), {exponent}) END AS p FROM a{n})",
            f"c{n} AS (SELECT *, coalesce(p / nullif(avg(p) OVER (PARTITION BY era), 0), 0) * 100 AS q FROM b{n})",
            f"d{n} AS (SELECT *, CASE WHEN q >= median(q) OVER (PARTITION BY era) THEN q * {stretch} ELSE q END AS s FROM c{n})",
            f"f{n} AS (SELECT * EXCLUDE (r, p, q, s), coalesce(s / nullif(avg(s) OVER (PARTITION BY era), 0), 0) * 100 AS {name} FROM d{n})",
        ]
        last = f"f{n}"
    ma = ", ".join(f"CASE WHEN era <> 'warmup' THEN avg({pairs[0][1]}) OVER (PARTITION BY era ORDER BY day ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW) END AS ma{k}" for k in (7, 30))
    return ",\n".join([*out, f"indexed AS (SELECT *, {ma} FROM {last})"])


INDEX = ("risk_index", "acts_index", "threats_index", "ma7", "ma30")
INDEX_SQL = f"{DAYS_SQL},\n{index_sql('days', timeseries.RATIOS, chr(39) + 'all' + chr(39))}"
SPLIT = f"CASE WHEN day < DATE '{A.CUT}' THEN 'warmup' ELSE 'product' END"


def days(spark, sf_dir):
    return rollup.daily(A.scored(spark, sf_dir))


def indexed(spark, sf_dir):
    return timeseries.index_series(days(spark, sf_dir), A.BASE_START, A.BASE_END)


@query(f"{W}{INDEX_SQL} SELECT day, total_articles, positive_count, {s6('risk_sum', 'raw_ratio', *INDEX)} FROM indexed")
def daily_index(spark, sf_dir):
    return indexed(spark, sf_dir).select("day", "total_articles", "positive_count", *r6("risk_sum", "raw_ratio", *INDEX))


@query(f"{W}{DAYS_SQL},\n{index_sql('days', timeseries.RATIOS, SPLIT)} SELECT day, {s6(*INDEX)} FROM indexed")
def daily_index_split_era(spark, sf_dir):
    return timeseries.index_series(days(spark, sf_dir), A.BASE_START, A.BASE_END, cut=A.CUT).select("day", *r6(*INDEX))


@query(f"{W}{INDEX_SQL} SELECT strftime(day, '%Y-%m') AS year_month, {', '.join(f'round(avg({c}) + 1e-9, 6) AS {c}' for c in INDEX[:3])}, count(*) AS total_days FROM indexed GROUP BY 1")
def monthly_index(spark, sf_dir):
    return rollup.monthly(indexed(spark, sf_dir), *INDEX[:3]).select("year_month", *r6(*INDEX[:3]), "total_days")


@query(f"{W}{A.SCORED_SQL} SELECT day, {', '.join(f'round(coalesce(sum(risk_score) FILTER (WHERE category = {chr(39)}{c}{chr(39)}), 0) + 1e-9, 6) AS {c}' for c in C.CATEGORY_NAMES)} FROM scored GROUP BY day")
def event_type_pivot(spark, sf_dir):
    return rollup.category_pivot(A.scored(spark, sf_dir)).select("day", *r6(*C.CATEGORY_NAMES))


COUNTRY_SQL = (
    A.SCORED_SQL
    + f""", totals_ AS (SELECT day, count(*) AS total_articles FROM scored GROUP BY day),
each AS (SELECT DISTINCT id, day, risk_score, upper(split_part(e, '#', 3)) AS country FROM (SELECT id, day, risk_score, unnest(string_split(locations, ';')) AS e FROM scored WHERE {_pos}) WHERE split_part(e, '#', 3) <> ''),
grouped AS (SELECT day, country, sum(risk_score) AS risk_sum FROM each GROUP BY 1, 2),
ratios AS (SELECT g.*, total_articles, risk_sum / total_articles AS raw_ratio FROM grouped g JOIN totals_ USING (day)),
based AS (SELECT *, avg(raw_ratio) FILTER (WHERE day BETWEEN DATE '{A.BASE_START}' AND DATE '{A.BASE_END}') OVER (PARTITION BY country) AS b FROM ratios)"""
)


@query(f"{W}{COUNTRY_SQL} SELECT day, country, round(risk_sum + 1e-9, 6) AS risk_sum, total_articles, round(raw_ratio + 1e-9, 6) AS raw_ratio, round(raw_ratio / coalesce(nullif(b, 0), 1) * 100 + 1e-9, 6) AS group_index FROM based")
def country_index(spark, sf_dir):
    grouped = rollup.by_group(A.scored(spark, sf_dir), text.countries(F.col("locations")), "country")
    out = rollup.group_index(grouped, "country", A.BASE_START, A.BASE_END)
    return out.select("day", "country", *r6("risk_sum"), "total_articles", *r6("raw_ratio", "group_index"))


@query(f"{W}{A.ROUTES_SQL} SELECT s.id, coalesce((SELECT string_agg(route, ',' ORDER BY n) FROM tagged t WHERE t.id = s.id), '') AS routes FROM scored s")
def route_tags(spark, sf_dir):
    return A.routed(spark, sf_dir).select("id", F.array_join(text.masked_routes(F.col("routes")), ",").alias("routes"))


MEMBERS_SQL = "members AS (SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v['name']}', {v['energy']}::DOUBLE, {v['goods']}::DOUBLE)" for k, v in C.ROUTES.items()) + ") AS m(route, name, energy, goods))"
PANEL_SQL = (
    A.ROUTES_SQL
    + f""", {MEMBERS_SQL},
per_day AS (SELECT day, count(*) AS total_articles, count(*) FILTER (WHERE {_pos}) AS positive_articles, count(*) FILTER (WHERE {_pos} AND id IN (SELECT id FROM tagged)) AS matched_positive_articles FROM scored GROUP BY day),
hits AS (SELECT day, route, sum(risk_score) AS risk_sum, count(*) AS hit_count FROM scored JOIN tagged USING (id) WHERE {_pos} GROUP BY 1, 2),
panel AS (SELECT d.*, m.route, m.name, m.energy, m.goods, coalesce(risk_sum, 0) AS risk_sum, coalesce(hit_count, 0) AS hit_count, coalesce(risk_sum, 0) / total_articles AS raw_ratio
  FROM per_day d CROSS JOIN members m LEFT JOIN hits h ON h.day = d.day AND h.route = m.route)"""
)


@query(f"{W}{PANEL_SQL} SELECT day, route, total_articles, positive_articles, matched_positive_articles, hit_count, {s6('risk_sum', 'raw_ratio')} FROM panel")
def corridor_panel(spark, sf_dir):
    out = routes.panel(A.routed(spark, sf_dir), routes.registry(spark))
    return out.select("day", "route", "total_articles", "positive_articles", "matched_positive_articles", "hit_count", *r6("risk_sum", "raw_ratio"))


RISK_SQL = (
    PANEL_SQL
    + f""",
g0 AS (SELECT *, count(*) FILTER (WHERE hit_count > 0 AND day BETWEEN DATE '{A.BASE_START}' AND DATE '{A.BASE_END}') OVER w AS hd, avg(raw_ratio) FILTER (WHERE day BETWEEN DATE '{A.BASE_START}' AND DATE '{A.BASE_END}') OVER w AS b FROM panel WINDOW w AS (PARTITION BY route)),
g1 AS (SELECT *, CASE WHEN b > 0 THEN raw_ratio / b ELSE 0 END AS r FROM g0),
g2 AS (SELECT *, CASE WHEN avg(r) OVER (PARTITION BY route) = 0 THEN 0 ELSE pow(r / avg(r) OVER (PARTITION BY route), {C.ROUTE_TAIL_EXPONENT}) END AS p FROM g1),
g3 AS (SELECT *, coalesce(p / nullif(avg(p) OVER (PARTITION BY route), 0), 0) * 100 AS q FROM g2),
g4 AS (SELECT *, CASE WHEN q >= median(q) OVER (PARTITION BY route) THEN q * {C.ROUTE_UPPER_STRETCH} ELSE q END AS s FROM g3),
g5 AS (SELECT *, coalesce(s / nullif(avg(s) OVER (PARTITION BY route), 0), 0) * 100 AS t FROM g4),
g6 AS (SELECT *, CASE WHEN hd >= {C.MIN_HIT_DAYS} AND b > 0 THEN 'ok' ELSE 'insufficient_history' END AS score_status, CASE WHEN hd >= {C.MIN_HIT_DAYS} AND b > 0 THEN greatest(0, least(100, t)) ELSE 0 END AS threat_index FROM g5),
g7 AS (SELECT *, greatest(0, least(100, threat_index * energy)) AS energy_risk, greatest(0, least(100, threat_index * goods)) AS goods_risk FROM g6),
g8 AS (SELECT *, greatest(energy_risk, goods_risk) AS route_risk FROM g7),
route_days AS (SELECT *, avg(route_risk) OVER (PARTITION BY route ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS ma7, avg(route_risk) OVER (PARTITION BY route ORDER BY day ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS ma30 FROM g8)"""
)
RISK = ("threat_index", "energy_risk", "goods_risk", "route_risk", "ma7", "ma30")


def route_days(spark, sf_dir):
    members = routes.registry(spark)
    return routes.normalise(routes.panel(A.routed(spark, sf_dir), members), members, A.BASE_START, A.BASE_END)


@query(f"{W}{RISK_SQL} SELECT day, route, name, score_status, {s6(*RISK)} FROM route_days")
def corridor_risk(spark, sf_dir):
    return route_days(spark, sf_dir).select("day", "route", "name", "score_status", *r6(*RISK))


@query(f"{W}{RISK_SQL} SELECT route, round(coalesce(ma7, route_risk, 0), 6) AS operational, CASE WHEN score_status = 'insufficient_history' THEN 'Calibrating' WHEN coalesce(ma7, route_risk, 0) >= 50 THEN 'High' WHEN coalesce(ma7, route_risk, 0) >= 20 THEN 'Watch' ELSE 'Low' END AS action FROM route_days WHERE day = (SELECT max(day) FROM route_days)")
def latest_board(spark, sf_dir):
    last = timeseries.latest(route_days(spark, sf_dir).select("route", "day", "route_risk", "ma7", "score_status"), ["route"], "day")
    level = F.coalesce("ma7", "route_risk", F.lit(0.0))
    return last.select("route", F.round(level, 6).alias("operational"), bands.risk_action(level, F.col("score_status")).alias("action"))


@query(f"{W}{RISK_SQL} SELECT day, arg_max(route, (round(route_risk, 9), -n)) AS route, round(max(route_risk), 6) AS route_risk FROM (SELECT r.*, row_number() OVER (PARTITION BY day ORDER BY route) AS n FROM route_days r) GROUP BY day")
def argmax_route(spark, sf_dir):
    from ..operators.feed import argmax

    return argmax(route_days(spark, sf_dir).withColumn("v", F.round("route_risk", 9)), "v", "route", ["day"]).select("day", "route", *r6("route_risk"))


@query(f"{W}{RISK_SQL} SELECT route, day, CASE WHEN prev_ IS NULL THEN 'flat' WHEN route_risk - prev_ > 2 THEN 'rising' WHEN route_risk - prev_ < -2 THEN 'falling' ELSE 'flat' END AS trend, hit_count > 0 AND route_risk > coalesce(ma7, 0) + 5 AS spike FROM (SELECT *, lag(route_risk) OVER (PARTITION BY route ORDER BY day) AS prev_ FROM route_days)")
def trend_label(spark, sf_dir):
    previous = F.lag("route_risk").over(timeseries.ordered(["route"]))
    rows = route_days(spark, sf_dir).withColumn("p", previous)
    return rows.select("route", "day", bands.trend(F.col("p"), F.col("route_risk")).alias("trend"), bands.spike(F.col("hit_count"), F.col("route_risk"), F.coalesce("ma7", F.lit(0.0))).alias("spike"))


@query(f"{W}{RISK_SQL} SELECT route, max(name) AS name, count(DISTINCT day) AS days, round(avg(route_risk), 6) AS mean_risk, round(stddev_samp(route_risk), 6) AS std_risk, round(max(route_risk), 6) AS max_risk, round(avg(CASE WHEN hit_count > 0 THEN 100.0 ELSE 0 END), 6) AS hit_day_pct FROM route_days GROUP BY route")
def corridor_summary(spark, sf_dir):
    return (
        route_days(spark, sf_dir).groupBy("route")
        .agg(F.max("name").alias("name"), F.countDistinct("day").alias("days"), F.avg("route_risk").alias("mean_risk"), F.stddev_samp("route_risk").alias("std_risk"), F.max("route_risk").alias("max_risk"), F.avg(F.when(F.col("hit_count") > 0, 100.0).otherwise(0.0)).alias("hit_day_pct"))
        .select("route", "name", "days", *r6("mean_risk", "std_risk", "max_risk", "hit_day_pct"))
    )


@query(f"{W}{RISK_SQL}, d AS (SELECT day, max(risk_index) AS parent FROM ({W}{INDEX_SQL} SELECT day, risk_index FROM indexed) GROUP BY day) SELECT route, round(CASE WHEN stddev_pop(threat_index) > 0 THEN corr(threat_index, parent) END, 6) AS r, coalesce(CASE WHEN stddev_pop(threat_index) > 0 THEN abs(corr(threat_index, parent)) > 0.95 END, FALSE) AS leaks FROM route_days JOIN d USING (day) GROUP BY route")
def corridor_parent_leakage(spark, sf_dir):
    parent = indexed(spark, sf_dir).select("day", F.col("risk_index").alias("parent"))
    out = route_days(spark, sf_dir).join(parent, "day").groupBy("route").agg(stats.correlation("threat_index", "parent").alias("c"))
    return out.select("route", F.round("c", 6).alias("r"), F.coalesce(F.abs("c") > 0.95, F.lit(False)).alias("leaks"))


@query(f"{W}{A.SCORED_SQL} SELECT CASE WHEN risk_score = 0 THEN 'zero' WHEN risk_score <= 0.2 THEN 'to_0.2' WHEN risk_score <= 0.4 THEN 'to_0.4' WHEN risk_score <= 0.6 THEN 'to_0.6' ELSE 'over_0.6' END AS bucket, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6)::DOUBLE AS pct FROM scored GROUP BY 1")
def score_buckets(spark, sf_dir):
    from pyspark.sql import Window

    out = A.scored(spark, sf_dir).groupBy(scoring.score_bucket(F.col("risk_score")).alias("bucket")).agg(F.count("*").alias("n"))
    return out.select("bucket", "n", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 6).alias("pct"))


@query(f"{W}{A.SCORED_SQL} SELECT t::DOUBLE AS threshold, round(100.0 * avg(CASE WHEN risk_score > t THEN 1 ELSE 0 END), 6)::DOUBLE AS positive_pct FROM scored CROSS JOIN (VALUES (0.20), (0.25), (0.30), (0.35)) AS v(t) GROUP BY t")
def threshold_sensitivity(spark, sf_dir):
    grid = F.explode(F.transform(F.sequence(F.lit(20), F.lit(35), F.lit(5)), lambda x: x / 100.0))
    # Buckets first: the sweep runs over distinct scores, not over articles times thresholds.
    scores = A.scored(spark, sf_dir).groupBy("risk_score").agg(F.count("*").alias("n"))
    swept = scores.select("risk_score", "n", grid.alias("threshold")).groupBy("threshold").agg(F.round(100.0 * F.sum(F.when(F.col("risk_score") > F.col("threshold"), F.col("n")).otherwise(0)) / F.sum("n"), 6).alias("positive_pct"))
    return swept.select(F.round("threshold", 2).alias("threshold"), "positive_pct")


@query(f"{W}{A.SCORED_SQL} SELECT risk_type, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6)::DOUBLE AS share FROM scored WHERE {_pos} GROUP BY 1")
def type_shares(spark, sf_dir):
    from pyspark.sql import Window

    out = A.scored(spark, sf_dir).where(rollup.positive()).groupBy("risk_type").agg(F.count("*").alias("n"))
    return out.select("risk_type", "n", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6).alias("share"))


_tiers = ", ".join(f"round(100.0 * avg(CASE WHEN t{i} > 0 THEN 1 ELSE 0 END), 6)::DOUBLE AS tier{i}_pct" for i in (1, 2, 3))


@query(f"{W}{A.SCORED_SQL} SELECT {_tiers}, round(100.0 * avg(CASE WHEN t1 + t2 + t3 > 0 THEN 1 ELSE 0 END), 6)::DOUBLE AS any_pct FROM scored")
def tier_hit_rates(spark, sf_dir):
    rows = A.articles(spark, sf_dir)
    hits = [text.has_code(F.col("themes"), t) for t, _ in C.TIER_WEIGHTS]
    pct = lambda c: F.round(100.0 * F.avg(c.cast("int")), 6)
    return rows.agg(*[pct(h).alias(f"tier{i}_pct") for i, h in enumerate(hits, 1)], pct(hits[0] | hits[1] | hits[2]).alias("any_pct"))


@query(f"{W}{A.ARTICLES_SQL} SELECT code, count(*) AS n FROM (SELECT DISTINCT id, trim(unnest(string_split(upper(themes), ';'))) AS code FROM articles) GROUP BY code ORDER BY n DESC, code LIMIT 15")
def top_codes(spark, sf_dir):
    codes = F.explode(F.array_distinct(text.theme_codes(F.col("themes")))).alias("code")
    return A.articles(spark, sf_dir).select(codes).groupBy("code").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "code").limit(15)


@query(f"{W}{A.SCORED_SQL} SELECT {', '.join(f'round(var_samp({c}) / var_samp(risk_score), 6) AS {c}_share, round(corr({c}, risk_score), 6) AS {c}_corr' for c in SCORES[:3])} FROM scored WHERE {_pos}")
def component_contrib(spark, sf_dir):
    rows = A.scored(spark, sf_dir).where(rollup.positive())
    return rows.agg(*[x for c in SCORES[:3] for x in (F.round(F.var_samp(c) / F.var_samp("risk_score"), 6).alias(f"{c}_share"), F.round(F.corr(c, "risk_score"), 6).alias(f"{c}_corr"))])


_dirty = f"day IN (DATE '2024-01-10', DATE '2024-01-20')"


@query(f"{W}{DAYS_SQL}, merged AS (SELECT day, total_articles, risk_sum * 1.5 AS risk_sum FROM days WHERE {_dirty} UNION ALL SELECT day, total_articles, risk_sum FROM days WHERE NOT {_dirty}) SELECT day, total_articles, round(risk_sum + 1e-9, 6) AS risk_sum, round(risk_sum / total_articles + 1e-9, 6) AS raw_ratio FROM merged")
def dirty_day_merge(spark, sf_dir):
    old = days(spark, sf_dir).select("day", "total_articles", "risk_sum", F.lit(None).cast("double").alias("raw_ratio"), F.lit(0.0).alias("acts_ratio"), F.lit(0.0).alias("threats_ratio"), F.lit(0.0).alias("acts_sum"), F.lit(0.0).alias("threats_sum"))
    dirty = old.where(F.col("day").isin(*[__import__("datetime").date(2024, 1, d) for d in (10, 20)])).withColumn("risk_sum", F.col("risk_sum") * 1.5)
    return rollup.ensure_ratios(tables.replace_days(old, dirty)).select("day", "total_articles", *r6("risk_sum", "raw_ratio"))


_sample = "CAST(strftime(event_time, '%H') AS INTEGER) * 4 + CAST(strftime(event_time, '%M') AS INTEGER) // 15"


@query(f"{W}{A.SCORED_SQL}, full_ AS (SELECT day, sum(CASE WHEN {_pos} THEN risk_score ELSE 0 END) / count(*) AS f FROM scored GROUP BY day), part AS (SELECT day, sum(CASE WHEN {_pos} THEN risk_score ELSE 0 END) / count(*) AS s FROM scored WHERE ({_sample}) % 4 = 0 GROUP BY day) SELECT round(avg(s - f) / avg(f), 6) AS relative_bias, round(corr(f, s), 6) AS r, abs(avg(s - f) / avg(f)) <= 0.1 AS pass, count(*) AS n_days FROM full_ JOIN part USING (day)")
def slot_sample_bias(spark, sf_dir):
    rows = A.scored(spark, sf_dir)
    slot = F.hour("event_time") * 4 + F.floor(F.minute("event_time") / 15)
    value = F.sum(F.when(rollup.positive(), F.col("risk_score")).otherwise(0.0)) / F.count("*")
    both = rows.groupBy("day").agg(value.alias("f")).join(rows.where(slot % 4 == 0).groupBy("day").agg(value.alias("s")), "day")
    bias = F.avg(F.col("s") - F.col("f")) / F.avg("f")
    return both.agg(F.round(bias, 6).alias("relative_bias"), F.round(F.corr("f", "s"), 6).alias("r"), (F.abs(bias) <= 0.1).alias("pass"), F.count("*").alias("n_days"))


@query(f"{W}{A.ARTICLES_SQL} SELECT user_id, event_type, id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_time DESC, id DESC) AS n FROM articles) WHERE n = 1")
def dedup_latest(spark, sf_dir):
    return tables.dedup(A.articles(spark, sf_dir), ["user_id", "event_type"], [F.desc("event_time"), F.desc("id")]).select("user_id", "event_type", "id", "value")


@query(f"{W}n AS (SELECT o_orderkey, 'X' AS o_orderstatus, round(o_totalprice * 2, 2) AS o_totalprice FROM orders WHERE o_orderkey % 10 = 3 UNION ALL SELECT o_orderkey + 10000000, 'N', 1.0 FROM orders WHERE o_orderkey % 1000 = 7) SELECT * FROM n UNION ALL SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM n)")
def upsert_orders(spark, sf_dir):
    old = A.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    changed = old.where("o_orderkey % 10 = 3").withColumns({"o_orderstatus": F.lit("X"), "o_totalprice": F.round(F.col("o_totalprice") * 2, 2)})
    added = old.where("o_orderkey % 1000 = 7").select((F.col("o_orderkey") + 10000000).alias("o_orderkey"), F.lit("N").alias("o_orderstatus"), F.lit(1.0).alias("o_totalprice"))
    return tables.upsert(old, changed.union(added), ["o_orderkey"])


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_custkey % 3 <> 0 UNION ALL SELECT c_custkey, upper(c_name), 'NEW' FROM customer WHERE c_custkey % 3 = 0")
def insert_absent(spark, sf_dir):
    rows = A.table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    fresh = rows.select("c_custkey", F.upper("c_name").alias("c_name"), F.lit("NEW").alias("c_mktsegment"))
    return tables.insert_absent(rows.where("c_custkey % 3 <> 0"), fresh, ["c_custkey"])


@query(f"{W}{A.ARTICLES_SQL}, runs AS (SELECT user_id % 20 AS feed, event_time AS at_, event_type <> 'error' AS ok FROM articles), l AS (SELECT feed, max(at_) AS last_attempt, max(at_) FILTER (WHERE ok) AS last_success FROM runs GROUP BY feed) SELECT l.feed, epoch_us(last_attempt) // 1000 AS last_ms, epoch_us(last_success) // 1000 AS success_ms, (SELECT count(*) FROM runs r WHERE r.feed = l.feed AND NOT ok AND (last_success IS NULL OR r.at_ > last_success)) AS failures FROM l")
def feed_health(spark, sf_dir):
    runs = A.articles(spark, sf_dir).select((F.col("user_id") % 20).alias("feed"), F.col("event_time").alias("at"), (F.col("event_type") != "error").alias("ok"))
    return tables.health(runs).select("feed", F.unix_millis("last_attempt").alias("last_ms"), F.unix_millis("last_success").alias("success_ms"), "failures")


@query(f"{W}{A.ARTICLES_SQL} SELECT id, day FROM articles WHERE (day < DATE '{A.CUT}' AND event_type <> 'view') OR (day >= DATE '{A.CUT}' AND event_type = 'view')")
def merge_sources(spark, sf_dir):
    rows = A.articles(spark, sf_dir).select("id", "day", "event_type")
    return tables.merge_sources(rows.where("event_type <> 'view'"), rows.where("event_type = 'view'"), A.CUT).select("id", "day")


@query(f"{W}{A.ARTICLES_SQL}, d AS (SELECT day, count(*) FILTER (WHERE event_type = 'error') % 7 AS m FROM articles GROUP BY day) SELECT day, 'filler-' || strftime(day, '%Y%m%d') || '-' || lpad(CAST(k AS VARCHAR), 6, '0') AS identifier FROM (SELECT day, unnest(generate_series(1, m)) AS k FROM d)")
def filler_rows(spark, sf_dir):
    per_day = A.articles(spark, sf_dir).groupBy("day").agg((F.count_if(F.col("event_type") == "error") % 7).alias("m"))
    return tables.filler(per_day, "m")


@query(f"{W}{DAYS_SQL} SELECT day, round(sum(risk_sum) + 1e-9, 6) AS risk_sum FROM days GROUP BY day")
def integrity_gate(spark, sf_dir):
    rows = days(spark, sf_dir)
    checked = tables.gate(rows, (F.col("positive_count") <= F.col("candidate_count"), "more positives than candidates"), (F.col("candidate_count") <= F.col("total_articles"), "more candidates than articles"))
    return checked.select("day", *r6("risk_sum"))


@query(f"{W}{A.ARTICLES_SQL} SELECT id, k FROM (SELECT id, k, row_number() OVER (ORDER BY event_time, id) - 1 AS n FROM articles) WHERE n % 50 = 7")
def systematic_sample(spark, sf_dir):
    return tables.systematic_sample(A.articles(spark, sf_dir).select("id", "k", "event_time"), ["event_time", "id"], 50, 7).select("id", "k")


REG_SQL = "s AS (SELECT r_name AS region, CAST(l_shipdate AS DATE) AS day, count(*) AS lines, sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS cents FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE l_shipdate >= TIMESTAMP '1998-01-01' AND l_shipdate < TIMESTAMP '1998-04-01' GROUP BY 1, 2)"


@query(f"{W}{REG_SQL}, d AS (SELECT CAST(unnest(generate_series(DATE '1998-01-01', DATE '1998-03-31', INTERVAL 1 DAY)) AS DATE) AS day) SELECT d.day, r_name AS region, coalesce(lines, 0) AS lines, CAST(coalesce(cents, 0) AS BIGINT) AS cents FROM d CROSS JOIN region LEFT JOIN s ON s.day = d.day AND s.region = r_name")
def region_panel(spark, sf_dir):
    """Lines per region and day, dense: the small sides are joined and aggregated before the calendar is."""
    t = lambda n: A.table(spark, sf_dir, n)
    lines = t("lineitem").where("l_shipdate >= '1998-01-01' and l_shipdate < '1998-04-01'").select("l_suppkey", F.to_date("l_shipdate").alias("day"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"))
    per_supplier = lines.groupBy("l_suppkey", "day").agg(F.count("*").alias("lines"), F.sum("cents").alias("cents"))
    names = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("r_name").alias("region"))
    placed = per_supplier.join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(names, F.col("s_nationkey") == F.col("n_nationkey"))
    sums = placed.groupBy("day", "region").agg(F.sum("lines").alias("lines"), F.sum("cents").alias("cents"))
    return joins.dense_panel(sums, timeseries.calendar(spark, "1998-01-01", "1998-03-31"), t("region").select(F.col("r_name").alias("region")), ["day", "region"], ["lines", "cents"])


FILL_DAYS = "day NOT IN (DATE '2024-01-05', DATE '2024-01-06', DATE '2024-01-17', DATE '2024-01-30')"
OBSERVED_SQL = f"{INDEX_SQL}, observed AS (SELECT day, risk_index, acts_index FROM indexed WHERE {FILL_DAYS}), cal AS (SELECT CAST(unnest(generate_series(DATE '2024-01-01', DATE '2024-01-31', INTERVAL 1 DAY)) AS DATE) AS day), rows_ AS (SELECT cal.day, risk_index, acts_index, o.day IS NULL AS is_imputed FROM cal LEFT JOIN observed o ON o.day = cal.day)"


def observed(spark, sf_dir):
    return indexed(spark, sf_dir).select("day", "risk_index", "acts_index").where(FILL_DAYS.replace("DATE '", "date'"))


def filled(spark, sf_dir, method, benchmark=None):
    return gaps.fill(observed(spark, sf_dir), "2024-01-01", "2024-01-31", method, ["risk_index", "acts_index"], benchmark)


@query(f"{W}{OBSERVED_SQL} SELECT day FROM rows_ WHERE is_imputed")
def gap_missing_days(spark, sf_dir):
    return timeseries.missing_days(observed(spark, sf_dir), "2024-01-01", "2024-01-31")


@query(f"{W}{OBSERVED_SQL} SELECT day, is_imputed, {', '.join(f'round(last_value({c} IGNORE NULLS) OVER (ORDER BY day ROWS UNBOUNDED PRECEDING), 6) AS {c}' for c in ('risk_index', 'acts_index'))} FROM rows_")
def gap_forward(spark, sf_dir):
    return filled(spark, sf_dir, "forward").select("day", "is_imputed", *r6("risk_index", "acts_index"))


def _linear(c: str) -> str:
    return f"""round(coalesce({c}, CASE WHEN r_{c} IS NULL THEN l_{c} ELSE l_{c} + (r_{c} - l_{c}) * (n - ln_{c}) / (rn_{c} - ln_{c}) END), 6) AS {c}"""


def _around(c: str) -> str:
    back, ahead = "(ORDER BY day ROWS UNBOUNDED PRECEDING)", "(ORDER BY day ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
    at = f"CASE WHEN {c} IS NOT NULL THEN n END"
    return f"last_value({c} IGNORE NULLS) OVER {back} AS l_{c}, last_value({at} IGNORE NULLS) OVER {back} AS ln_{c}, first_value({c} IGNORE NULLS) OVER {ahead} AS r_{c}, first_value({at} IGNORE NULLS) OVER {ahead} AS rn_{c}"


@query(f"{W}{OBSERVED_SQL}, n_ AS (SELECT *, row_number() OVER (ORDER BY day) AS n FROM rows_), a_ AS (SELECT *, {_around('risk_index')}, {_around('acts_index')} FROM n_) SELECT day, is_imputed, {_linear('risk_index')}, {_linear('acts_index')} FROM a_")
def gap_linear(spark, sf_dir):
    return filled(spark, sf_dir, "linear").select("day", "is_imputed", *r6("risk_index", "acts_index"))


BENCH_SQL = "bench AS (SELECT CAST(ts AS DATE) AS day, round(avg(value), 6) AS bench FROM events GROUP BY 1)"


def bench(spark, sf_dir):
    return A.table(spark, sf_dir, "events").groupBy(F.to_date(F.col("ts").cast("timestamp")).alias("day")).agg(F.round(F.avg("value"), 6).alias("bench"))


@query(f"{W}{OBSERVED_SQL}, {BENCH_SQL}, a_ AS (SELECT max(day) AS day FROM observed WHERE day < (SELECT min(day) FROM rows_ WHERE is_imputed)), s_ AS (SELECT risk_index / bench AS scale FROM observed JOIN a_ USING (day) JOIN bench USING (day)), f_ AS (SELECT day, is_imputed, last_value(risk_index IGNORE NULLS) OVER w AS risk_index, last_value(acts_index IGNORE NULLS) OVER w AS acts_index FROM rows_ WINDOW w AS (ORDER BY day ROWS UNBOUNDED PRECEDING)), j_ AS (SELECT f_.day, is_imputed, CASE WHEN is_imputed THEN coalesce(bench * (SELECT scale FROM s_), risk_index) ELSE risk_index END AS risk_index, acts_index FROM f_ LEFT JOIN bench ON bench.day = f_.day) SELECT day, is_imputed, round(risk_index * 100 / avg(risk_index) OVER (), 6) AS risk_index, round(acts_index * 100 / avg(risk_index) OVER (), 6) AS acts_index FROM j_")
def gap_benchmark(spark, sf_dir):
    rows = filled(spark, sf_dir, "benchmark", bench(spark, sf_dir))
    return gaps.rescale(rows, ["risk_index", "acts_index"]).select("day", "is_imputed", *r6("risk_index", "acts_index"))


@query(f"{W}{OBSERVED_SQL}, k_ AS (SELECT day, day - CAST(row_number() OVER (ORDER BY day) AS INTEGER) AS g FROM rows_ WHERE is_imputed) SELECT min(day) AS first_day, max(day) AS last_day, count(*) AS n_days FROM k_ GROUP BY g")
def gap_islands(spark, sf_dir):
    return timeseries.islands(timeseries.missing_days(observed(spark, sf_dir), "2024-01-01", "2024-01-31"))
