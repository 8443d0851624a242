"""Queries of series, statistics, market features and signals."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import bands
from ..operators import joins, rollup, signal, stats, timeseries, vectors
from . import articles as A
from .registry import query
from .risk import INDEX_SQL, W, bench, indexed, r6, s6

PRICES = A.PRICES_SQL
LR_SQL = f"{PRICES}, lr_ AS (SELECT *, ln(close) - lag(ln(close)) OVER (ORDER BY day) AS lr FROM prices)"


def _full(expr: str, value: str, n: int, how: str) -> str:
    frame = f"OVER (ORDER BY day ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({value}) {frame} = {n} THEN {how}({value}) {frame} END{expr}"


def _ahead(expr: str, value: str, n: int, how: str) -> str:
    frame = f"OVER (ORDER BY day ROWS BETWEEN 1 FOLLOWING AND {n} FOLLOWING)"
    return f"CASE WHEN count({value}) {frame} = {n} THEN {how}({value}) {frame} END{expr}"


VOL = " * sqrt(252.0) * 100"


@query(f"{W}{LR_SQL} SELECT day, round(lr, 6) AS lr, {', '.join('round(' + _full(VOL, 'lr', n, 'stddev_samp') + f', 4) AS rv{n}' for n in (5, 22, 66))} FROM lr_")
def realized_vol(spark, sf_dir):
    rows = signal.returns(A.daily_prices(spark, sf_dir))
    return rows.select("day", F.round("lr", 6).alias("lr"), *[F.round(signal.realized_vol(n), 4).alias(f"rv{n}") for n in (5, 22, 66)])


@query(f"{W}{LR_SQL}, f_ AS (SELECT day, {', '.join(_full(VOL, 'lr', n, 'stddev_samp') + f' AS rv{n}' for n in (5, 22))}, {', '.join(_full(' * 100', 'lr', n, 'sum') + f' AS ret{n}' for n in (5, 22, 66))}, (close / {_full('', 'close', 252, 'max')} - 1) * 100 AS drawdown FROM lr_) SELECT day, round(ret5, 4) AS ret5, round(ret22, 4) AS ret22, round(ret66, 4) AS ret66, round(rv5 / rv22, 4) AS rv_ratio, round(drawdown, 4) AS drawdown FROM f_")
def market_features(spark, sf_dir):
    return signal.market_features(A.daily_prices(spark, sf_dir)).select("day", *[F.round(c, 4).alias(c) for c in ("ret5", "ret22", "ret66", "rv_ratio", "drawdown")])


@query(f"{W}{LR_SQL} SELECT day, round({_ahead(VOL, 'lr', 5, 'stddev_samp')}, 4) AS fwd_vol, round({_ahead(' * 100', 'lr', 5, 'sum')}, 4) AS fwd_ret, lead(day, 5) OVER (ORDER BY day) AS resolves_on FROM lr_")
def forward_vol(spark, sf_dir):
    rows = signal.returns(A.daily_prices(spark, sf_dir))
    return rows.select("day", F.round(signal.forward_vol(5), 4).alias("fwd_vol"), F.round(signal.forward_return(5), 4).alias("fwd_ret"), F.lead("day", 5).over(timeseries.ordered()).alias("resolves_on"))


def _feature(c: str) -> str:
    return f"round(l, 6) AS log_{c}, round({_full('', 'l', 5, 'avg')}, 6) AS {c}_ma5, round(l - {_full('', 'l', 22, 'avg')}, 6) AS {c}_spike, round(l - lag(l) OVER (ORDER BY day), 6) AS {c}_chg1, round(l - lag(l, 5) OVER (ORDER BY day), 6) AS {c}_chg5"


@query(f"{W}{INDEX_SQL}, l_ AS (SELECT day, ln(risk_index + 1) AS l FROM indexed) SELECT day, {_feature('risk_index')} FROM l_")
def index_features(spark, sf_dir):
    out = signal.index_features(indexed(spark, sf_dir).select("day", "risk_index"), ["risk_index"])
    return out.select("day", *r6("log_risk_index", "risk_index_ma5", "risk_index_spike", "risk_index_chg1", "risk_index_chg5"))


@query(f"{W}m AS (SELECT date_trunc('month', l_shipdate)::DATE AS day, count(*) AS lines FROM lineitem GROUP BY 1), {PRICES} SELECT p.day, round(p.close, 4) AS close, m.lines FROM prices p ASOF LEFT JOIN m ON p.day >= m.day")
def asof_features(spark, sf_dir):
    months = A.table(spark, sf_dir, "lineitem").groupBy(F.trunc(F.to_date("l_shipdate"), "MM").alias("day")).agg(F.count("*").alias("lines"))
    return joins.as_of(A.daily_prices(spark, sf_dir), months, "day", ["lines"]).select("day", F.round("close", 4).alias("close"), "lines")


@query("SELECT event_id, o_orderkey FROM (SELECT event_id, value FROM events WHERE event_type = 'error') e JOIN (SELECT o_orderkey, o_totalprice / 1000 AS lo, o_totalprice / 1000 + 0.01 AS hi FROM orders WHERE o_orderpriority = '1-URGENT') o ON value BETWEEN lo AND hi")
def band_join(spark, sf_dir):
    left = A.table(spark, sf_dir, "events").where("event_type = 'error'").select("event_id", "value")
    right = A.table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select("o_orderkey", (F.col("o_totalprice") / 1000).alias("lo"), (F.col("o_totalprice") / 1000 + 0.01).alias("hi"))
    return joins.band(left, right, "value", "lo", "hi", 0.5).select("event_id", "o_orderkey")


EVENTS = ("1996-03-01", "1998-07-15", "2000-01-20", "1995-01-02")
_near, _prior = "p.day BETWEEN e.d - 3 AND e.d + 3", "p.day BETWEEN e.d - 30 AND e.d - 4"


@query(f"{W}{PRICES}, e AS (SELECT CAST(d AS DATE) AS d FROM (VALUES {', '.join(f'(DATE {chr(39)}{d}{chr(39)})' for d in EVENTS)}) AS v(d)), z_ AS (SELECT e.d AS event_day, avg(close) FILTER (WHERE {_near}) AS m, avg(close) FILTER (WHERE {_prior}) AS b, stddev_samp(close) FILTER (WHERE {_prior}) AS s, count(*) FILTER (WHERE {_prior}) AS n FROM e JOIN prices p ON ({_near}) OR ({_prior}) GROUP BY e.d) SELECT event_day, round(m, 3) AS event_mean, round(CASE WHEN n >= 2 AND s > 0 THEN (m - b) / s END, 6) AS z, n AS prior_n FROM z_")
def event_zscore(spark, sf_dir):
    events = spark.createDataFrame([(d,) for d in EVENTS], "d string").select(F.to_date("d").alias("event_day"))
    return timeseries.event_z(A.daily_prices(spark, sf_dir), events, "close").select("event_day", F.round("event_mean", 3).alias("event_mean"), *r6("z"), "prior_n")


SEGMENT_SQL = "seg AS (SELECT c_mktsegment AS segment, CAST(o_orderdate AS DATE) AS day, count(*)::DOUBLE AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)"


@query(f"{W}{SEGMENT_SQL}, z_ AS (SELECT segment, avg(n) FILTER (WHERE {_near.replace('e.d', 'DATE ' + chr(39) + EVENTS[1] + chr(39))}) AS m, avg(n) FILTER (WHERE {_prior.replace('e.d', 'DATE ' + chr(39) + EVENTS[1] + chr(39))}) AS b, stddev_samp(n) FILTER (WHERE {_prior.replace('e.d', 'DATE ' + chr(39) + EVENTS[1] + chr(39))}) AS s FROM seg p GROUP BY segment), k_ AS (SELECT segment, CASE WHEN s > 0 THEN (m - b) / s END AS z FROM z_) SELECT segment, round(z, 6) AS z, round(z - (SELECT max(o.z) FROM k_ o WHERE o.segment <> k_.segment), 6) AS lead FROM k_")
def event_discrimination(spark, sf_dir):
    from pyspark.sql import Window

    t = lambda n: A.table(spark, sf_dir, n)
    counts = t("orders").groupBy("o_custkey", F.to_date("o_orderdate").alias("day")).agg(F.count("*").alias("k"))
    seg = counts.join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_mktsegment").alias("segment"), "day").agg(F.sum("k").cast("double").alias("n"))
    z = timeseries.event_z(seg, spark.createDataFrame([(EVENTS[1],)], "d string").select(F.to_date("d").alias("event_day")), "n", ["segment"]).select("segment", "z")
    rank = z.withColumns({"best": F.max("z").over(Window.partitionBy()), "_r": F.row_number().over(Window.partitionBy().orderBy(F.desc("z")))})
    second = F.max(F.when(F.col("_r") == 2, F.col("z"))).over(Window.partitionBy())
    return rank.select("segment", F.round("z", 6).alias("z"), F.round(F.col("z") - F.when(F.col("_r") == 1, second).otherwise(F.col("best")), 6).alias("lead"))


@query(f"{W}{PRICES} SELECT day, round(close, 4) AS close, round((close - avg(close) OVER y) / stddev_samp(close) OVER y, 6) AS z_year FROM prices WINDOW y AS (PARTITION BY year(day)) ORDER BY close DESC, day LIMIT 10")
def top_spikes(spark, sf_dir):
    from pyspark.sql import Window

    y = Window.partitionBy(F.year("day"))
    z = ((F.col("close") - F.avg("close").over(y)) / F.stddev_samp("close").over(y)).alias("z")
    return A.daily_prices(spark, sf_dir).select("day", "close", z).orderBy(F.desc("close"), "day").limit(10).select("day", F.round("close", 4).alias("close"), F.round("z", 6).alias("z_year"))


_q = ", ".join(f"round(quantile_cont(close, {q}), 4) AS p{int(q * 100):02d}" for q in (0.01, 0.25, 0.5, 0.75, 0.99))


@query(f"{W}{PRICES}, l_ AS (SELECT close, lag(close) OVER (ORDER BY day) AS p1, lag(close, 5) OVER (ORDER BY day) AS p5 FROM prices) SELECT round(avg(close), 4) AS mean, round(stddev_samp(close), 4) AS std, round(skewness(close), 6) AS skew, {_q}, round(corr(close, p1), 6) AS lag1, round(corr(close, p5), 6) AS lag5, count(*) AS n FROM l_")
def stat_properties(spark, sf_dir):
    rows = A.daily_prices(spark, sf_dir)
    quantiles = [F.round(stats.quantile("close", q), 4).alias(f"p{int(q * 100):02d}") for q in (0.01, 0.25, 0.5, 0.75, 0.99)]
    main = rows.agg(F.round(F.avg("close"), 4).alias("mean"), F.round(F.stddev_samp("close"), 4).alias("std"), F.round(stats.skew("close"), 6).alias("skew"), *quantiles, F.count("*").alias("n"))
    lags = [timeseries.autocorrelation(rows, "close", k).select(F.round("autocorr", 6).alias(f"lag{k}")) for k in (1, 5)]
    return main.crossJoin(lags[0]).crossJoin(lags[1])


PAIR_SQL = "o AS (SELECT CAST(o_orderdate AS DATE) AS day, count(*)::DOUBLE AS x FROM orders GROUP BY 1), l AS (SELECT CAST(l_shipdate AS DATE) AS day, count(*)::DOUBLE AS y FROM lineitem GROUP BY 1), both_ AS (SELECT day, x, y FROM o JOIN l USING (day))"


def pair(spark, sf_dir):
    o = A.table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count("*").cast("double").alias("x"))
    return o.join(A.table(spark, sf_dir, "lineitem").groupBy(F.to_date("l_shipdate").alias("day")).agg(F.count("*").cast("double").alias("y")), "day")


@query(f"{W}{PAIR_SQL}, r_ AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2 AS ry, x, y FROM both_) SELECT round(corr(x, y), 6) AS pearson, round(corr(rx, ry), 6) AS spearman, count(*) AS n FROM r_")
def pearson_spearman(spark, sf_dir):
    rows = pair(spark, sf_dir)
    return rows.agg(F.round(stats.correlation("x", "y"), 6).alias("pearson"), F.count("*").alias("n")).crossJoin(stats.spearman(rows, "x", "y").select(F.round("spearman", 6).alias("spearman")))


@query(f"{W}{PAIR_SQL} SELECT round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 6) AS intercept, round(regr_r2(y, x), 6) AS r2, count(*) AS n FROM both_")
def ols_one(spark, sf_dir):
    return stats.ols_hac(pair(spark, sf_dir), "y", "x", "day").select(*r6("slope", "intercept", "r2"), "n")


@query(f"{W}{PAIR_SQL} SELECT round(sqrt(avg((y - x) * (y - x))), 6) AS rmse, round(avg(abs(y - x)), 6) AS mae, round(1 - sum((y - x) * (y - x)) / sum((y - b) * (y - b)), 6) AS r2_vs_naive, count(*) AS n FROM (SELECT *, lag(y) OVER (ORDER BY day) AS b FROM both_) WHERE b IS NOT NULL")
def forecast_errors(spark, sf_dir):
    rows = pair(spark, sf_dir).withColumn("b", F.lag("y").over(timeseries.ordered()))
    return stats.errors(rows, "y", "x", "b").select(*r6("rmse", "mae", "r2_vs_naive"), "n")


SCORED_DOCS = "d AS (SELECT doc_id, toxic, max(n_chars % 97)::DOUBLE AS s FROM labels JOIN documents USING (doc_id) GROUP BY 1, 2)"


@query(f"{W}{SCORED_DOCS}, r_ AS (SELECT toxic, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2 AS r, s FROM d), a_ AS (SELECT (sum(r) FILTER (WHERE toxic = 1) - count(*) FILTER (WHERE toxic = 1) * (count(*) FILTER (WHERE toxic = 1) + 1) / 2) / (count(*) FILTER (WHERE toxic = 1) * count(*) FILTER (WHERE toxic = 0)) AS auc FROM r_), g_ AS (SELECT s, sum(toxic) AS tp, count(*) AS n FROM d GROUP BY s), c_ AS (SELECT tp, sum(tp) OVER (ORDER BY s DESC) AS ctp, sum(n) OVER (ORDER BY s DESC) AS cn FROM g_), p_ AS (SELECT sum(tp * ctp / cn) / sum(tp) AS average_precision FROM c_) SELECT round(auc, 6) AS auc, round(average_precision, 6) AS average_precision, (SELECT round(2.0 * count(*) FILTER (WHERE s >= 50 AND toxic = 1) / (2 * count(*) FILTER (WHERE s >= 50 AND toxic = 1) + count(*) FILTER (WHERE (s >= 50) <> (toxic = 1))), 6)::DOUBLE FROM d) AS f1, (SELECT round(avg(toxic), 6) FROM d) AS base_rate FROM a_, p_")
def auc_pr_f1(spark, sf_dir):
    rows = A.table(spark, sf_dir, "labels").join(A.table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id").groupBy("doc_id", "toxic").agg(F.max(F.col("n_chars") % 97).cast("double").alias("s"))
    f = rows.agg(F.round(stats.f1(F.col("s") >= 50, F.col("toxic")), 6).alias("f1"), F.round(F.avg("toxic"), 6).alias("base_rate"))
    return stats.auc(rows, "s", "toxic").select(*r6("auc")).crossJoin(stats.average_precision(rows, "s", "toxic").select(*r6("average_precision"))).crossJoin(f)


@query(f"{W}{INDEX_SQL}, v_ AS (SELECT *, lag(risk_index, 7) OVER (ORDER BY day) AS before FROM indexed), l_ AS (SELECT * FROM v_ ORDER BY day DESC LIMIT 1) SELECT day AS as_of, round(risk_index, 6) AS level, round((risk_index - 100) / 35, 6) AS z, CASE WHEN risk_index >= 170 THEN 'HIGH' WHEN risk_index >= 135 THEN 'ELEVATED' WHEN risk_index >= 100 THEN 'MODERATE' ELSE 'LOW' END AS regime, round((risk_index / before - 1) * 100, 6) AS change_7, (SELECT round(avg(CASE WHEN i.risk_index <= l_.risk_index THEN 100.0 ELSE 0 END), 6)::DOUBLE FROM indexed i) AS geo_percentile, (SELECT count(*) FROM indexed) AS index_days FROM l_")
def geo_regime(spark, sf_dir):
    return signal.geo_regime(indexed(spark, sf_dir)).select("as_of", *r6("level", "z"), "regime", *r6("change_7", "geo_percentile"), "index_days")


RV22_SQL = f"{LR_SQL}, rv_ AS (SELECT day, {_full(VOL, 'lr', 22, 'stddev_samp')} AS rv FROM lr_), h_ AS (SELECT * FROM rv_ WHERE rv IS NOT NULL ORDER BY day DESC LIMIT 252), t_ AS (SELECT arg_max(rv, day) AS tr_, max(day) AS as_of, median(rv) AS med, quantile_cont(rv, 0.75) AS q75 FROM h_), vol_ AS (SELECT as_of, tr_, med, q75, CASE WHEN tr_ >= q75 THEN 0.55 WHEN tr_ >= med THEN 0.25 ELSE 0.08 END::DOUBLE AS high_vol_prob, (SELECT avg(CASE WHEN rv <= tr_ THEN 100.0 ELSE 0 END) FROM h_)::DOUBLE AS vol_percentile FROM t_)"


@query(f"{W}{RV22_SQL} SELECT as_of, round(tr_, 4) AS \"trailing\", round(q75, 4) AS q75, high_vol_prob, CASE WHEN high_vol_prob >= 0.5 THEN 'HIGH_VOL' WHEN high_vol_prob >= 0.25 THEN 'ELEVATED' ELSE 'NORMAL' END AS regime, round(vol_percentile, 6) AS vol_percentile FROM vol_")
def vol_signal(spark, sf_dir):
    out = signal.trailing_vol_signal(A.daily_prices(spark, sf_dir))
    return out.select("as_of", F.round("trailing", 4).alias("trailing"), F.round("q75", 4).alias("q75"), "high_vol_prob", "regime", *r6("vol_percentile"))


@query(f"{W}{RV22_SQL}, {INDEX_SQL}, g_ AS (SELECT avg(CASE WHEN risk_index <= (SELECT arg_max(risk_index, day) FROM indexed) THEN 100.0 ELSE 0 END)::DOUBLE AS g FROM indexed), s_ AS (SELECT g, vol_percentile AS v, round(0.6 * g + 0.4 * vol_percentile, 1) AS s FROM g_, vol_) SELECT s AS stress_score, CASE WHEN s >= 75 THEN 'HIGH_STRESS' WHEN s >= 50 THEN 'WATCH' ELSE 'CALM' END AS stress_regime, CASE WHEN s >= 75 THEN 'both' WHEN s < 50 THEN 'none' WHEN g >= 60 AND v < 50 THEN 'geo_leads' WHEN v >= 60 AND g < 50 THEN 'vol_leads' ELSE 'mixed' END AS story, CASE WHEN g >= 50 AND v >= 50 THEN 'both' WHEN g >= 50 THEN 'geo_only' WHEN v >= 50 THEN 'vol_only' ELSE 'calm' END AS quadrant FROM s_")
def joint_stress(spark, sf_dir):
    out = signal.joint(signal.geo_regime(indexed(spark, sf_dir)), signal.trailing_vol_signal(A.daily_prices(spark, sf_dir)))
    return out.select("stress_score", "stress_regime", "story", "quadrant")


LEVEL_SQL = "lev AS (SELECT CAST(o_orderdate AS DATE) AS day, count(*) * 10.0 AS v FROM orders GROUP BY 1)"


@query(f"{W}{LR_SQL}, {LEVEL_SQL}, f_ AS (SELECT day, {_ahead(VOL, 'lr', 5, 'stddev_samp')} AS fv, {_ahead(' * 100', 'lr', 5, 'sum')} AS fr FROM lr_) SELECT count(*) AS sample_days, round(median(fv), 4) AS vol_median, round(median(fr), 4) AS return_median FROM f_ JOIN lev USING (day) WHERE fv IS NOT NULL AND fr IS NOT NULL AND abs(v - (SELECT arg_max(v, day) FROM lev)) <= 10")
def analog(spark, sf_dir):
    levels = A.table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg((F.count("*") * 10.0).alias("v"))
    return signal.analog(levels, A.daily_prices(spark, sf_dir), "v").select("sample_days", F.round("vol_median", 4).alias("vol_median"), F.round("return_median", 4).alias("return_median"))


@query(f"{W}{PRICES}, n_ AS (SELECT day, row_number() OVER (ORDER BY day) - 1 AS position FROM prices) SELECT day, position, CASE WHEN position >= 750 THEN (position - 750) // 250 END AS fold, CASE WHEN position >= 750 THEN (position - 750) // 250 * 250 + 744 END AS train_until FROM n_")
def walk_forward_folds(spark, sf_dir):
    out = signal.walk_forward(A.daily_prices(spark, sf_dir).select("day"), 5, 750, 250)
    return out.select("day", F.col("position").cast("long"), F.col("fold").cast("long").alias("fold"), F.col("train_until").cast("long").alias("train_until"))


@query()
def vol_experiment(spark, sf_dir):
    """Boosted trees over purged folds (no SQL form): errors of the forecasts of each feature block.

    The index is the level that ``analog`` uses, as the news index spans too few of the price days.
    """
    from ..operators import model

    levels = A.table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg((F.count("*") * 10.0).alias("risk_index"))
    index = signal.index_features(levels, ["risk_index"])
    risk = [c for c in index.columns if c not in ("day", "risk_index")]
    market = ["rv5", "rv22", "rv66", "ret5", "ret22", "ret66", "rv_ratio", "drawdown"]
    rows = signal.market_features(A.daily_prices(spark, sf_dir)).withColumn("target", signal.forward_vol(5))
    blocks = {"market_only": market, "gpr_only": risk, "market+gpr": market + risk}
    rows = signal.assemble(rows, index, risk, "target").na.drop(subset=blocks["market+gpr"])
    parts = [stats.errors(model.experiment(rows, {b: c}, "target", "rv5"), "target", "predicted", "naive").select(F.lit(b).alias("block"), "*") for b, c in blocks.items()]
    return parts[0].union(parts[1]).union(parts[2])


@query("SELECT vec_id, label, round(sim, 4) AS similarity FROM (WITH c AS (SELECT label, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings), p AS (SELECT label, i, avg(x) AS m FROM c GROUP BY 1, 2), q AS (SELECT label, list(m ORDER BY i) AS proto FROM p GROUP BY 1) SELECT e.vec_id, q.label, list_cosine_similarity(e.embedding::DOUBLE[], q.proto) AS sim FROM embeddings e CROSS JOIN q)")
def proto_similarity(spark, sf_dir):
    rows = A.table(spark, sf_dir, "embeddings")
    return vectors.assign(rows, vectors.prototypes(rows, "label", "embedding"), "label", "embedding", "vec_id").select("vec_id", "label", F.round("similarity", 4).alias("similarity"))


@query("WITH c AS (SELECT label, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings), p AS (SELECT label, i, avg(x) AS m FROM c GROUP BY 1, 2), q AS (SELECT label, list(m ORDER BY i) AS proto FROM p GROUP BY 1) SELECT e.vec_id, string_agg(CAST(q.label AS VARCHAR), ';' ORDER BY q.label) AS themes FROM embeddings e CROSS JOIN q WHERE list_cosine_similarity(e.embedding::DOUBLE[], q.proto) >= 0.34 GROUP BY 1")
def theme_assign(spark, sf_dir):
    rows = A.table(spark, sf_dir, "embeddings")
    hits = vectors.assign(rows, vectors.prototypes(rows, "label", "embedding"), "label", "embedding", "vec_id", 0.34)
    return hits.groupBy("vec_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("label")), lambda x: x.cast("string")), ";").alias("themes"))


@query("SELECT vec_id, embedding[1] BETWEEN -0.1 AND 0.1 AND embedding[2] BETWEEN -0.1 AND 0.2 AS inside FROM embeddings")
def bbox_tagger(spark, sf_dir):
    x, y = (F.get("embedding", F.lit(i)) for i in (0, 1))
    return A.table(spark, sf_dir, "embeddings").select("vec_id", (x.between(F.lit(-0.1).cast("float"), F.lit(0.1).cast("float")) & y.between(F.lit(-0.1).cast("float"), F.lit(0.2).cast("float"))).alias("inside"))


@query("SELECT n_name AS country, strftime(o_orderdate, '%Y-%m') AS year_month, count(*) AS n, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2")
def country_orders(spark, sf_dir):
    """Orders are summed by customer and month before they meet the smaller tables."""
    t = lambda n: A.table(spark, sf_dir, n)
    sums = t("orders").groupBy("o_custkey", F.date_format("o_orderdate", "yyyy-MM").alias("year_month")).agg(F.count("*").alias("n"), F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("cents"))
    places = t("customer").select("c_custkey", "c_nationkey").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").alias("country"))
    return sums.join(places, F.col("o_custkey") == F.col("c_custkey")).groupBy("country", "year_month").agg(F.sum("n").alias("n"), F.sum("cents").alias("cents"))


@query("WITH d AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1) SELECT day, n, round(avg(n) OVER (ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 6) AS ma7, day > (SELECT max(day) FROM d) - 14 AS in_period FROM d")
def period_filter(spark, sf_dir):
    from pyspark.sql import Window

    d = A.table(spark, sf_dir, "events").groupBy(F.to_date(F.col("ts").cast("timestamp")).alias("day")).agg(F.count("*").alias("n"))
    return d.select("day", "n", F.round(timeseries.moving_mean("n", 7), 6).alias("ma7"), (F.col("day") > F.date_sub(F.max("day").over(Window.partitionBy()), 14)).alias("in_period"))


@query(f"{W}{INDEX_SQL}, {('bench AS (SELECT CAST(ts AS DATE) AS day, round(avg(value), 6) AS bench FROM events GROUP BY 1)')} SELECT round(corr(risk_index, bench), 6) AS pearson, coalesce(corr(risk_index, bench) > 0.5, FALSE) AS pass, count(*) AS n FROM indexed JOIN bench USING (day)")
def benchmark_correlation(spark, sf_dir):
    both = indexed(spark, sf_dir).join(bench(spark, sf_dir), "day")
    return both.agg(F.round(stats.correlation("risk_index", "bench"), 6).alias("pearson"), (stats.correlation("risk_index", "bench") > 0.5).alias("pass"), F.count("*").alias("n"))
