"""The driver's tables as the inputs of the risk model: events as articles, orders as daily series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import text
from ..operators import scoring

CUT, BASE_START, BASE_END = "2024-01-16", "2024-01-03", "2024-01-24"
THEMES = {
    "error": "ARMEDCONFLICT;SANCTION; sanction",
    "click": "TERROR;BORDER_DISPUTE",
    "purchase": "ESPIONAGE",
    "view": "WEATHER",
    "signup": "COUP;NUCLEAR;NUCLEAR;TAX_FNCACT_REBEL",
}
PLACES = (
    "1#India#IN#IN#20.0#77.0#0;4#Ladakh#IN#IN30#34.15#77.57#0",
    "1#Iran#IR#IR#32.0#53.0#0;1#Iran#ir#IR#32.0#53.0#0",
    "4#open water#XX##26.5#56.0#0;bad#entry",
    "4#Port near Malacca#XX##bad#101.0#0;1#Egypt#EG#EG#27.0#30.0#0",
    "",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cases(key: Column, values) -> Column:
    out = None
    for k, v in values:
        out = F.when(key == k, v) if out is None else out.when(key == k, v)
    return out


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, event_time, day, user_id, k, themes, tone_neg, tone_polarity, dims, locations`` from ``events``."""
    k = F.get_json_object("props", "$.k").cast("int")
    events = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("event_time"), "user_id", "event_type", "value", k.alias("k")
    )
    share = F.lpad(F.col("k").cast("string"), 2, "0")
    return events.select(
        "*",
        F.to_date("event_time").alias("day"),
        cases(F.col("event_type"), THEMES.items()).alias("themes"),
        (F.col("value") / 4).alias("tone_neg"),
        (F.col("value") / 10).alias("tone_polarity"),
        F.concat(F.lit("c18.1:0."), share, F.lit(",c18.3:0."), share, F.lit(",bad,c9.1:nan,c18.2:-0.5,c18.1:x")).alias("dims"),
        cases(F.col("k") % 5, enumerate(PLACES)).alias("locations"),
    )


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.score_articles(articles(spark, sf_dir))


def routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored articles with the mask of their routes."""
    return scored(spark, sf_dir).withColumn("routes", text.route_mask(F.col("locations")))


def listed(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def _hits(tier) -> str:
    return f"len(list_filter(string_split(upper(themes), ';'), lambda x: trim(x) IN ({listed(tier)})))"


def _dim(key: str) -> str:
    value = "try_cast(split_part(trim(p), ':', 2) AS DOUBLE)"
    kept = f"list_filter(string_split(dims, ','), lambda p: split_part(trim(p), ':', 1) = '{key}' AND {value} IS NOT NULL AND NOT isnan({value}))"
    return f"greatest(0.0, coalesce(list_transform({kept}, lambda p: {value})[-1], 0.0))"


_case = lambda key, values: f"CASE {key} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in values) + " END"

ARTICLES_SQL = f"""
base AS (SELECT event_id AS id, ts AS event_time, CAST(ts AS DATE) AS day, user_id, event_type, value, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
articles AS (SELECT *, {_case("event_type", [(f"'{k}'", v) for k, v in THEMES.items()])} AS themes, value / 4 AS tone_neg, value / 10 AS tone_polarity,
  'c18.1:0.' || lpad(CAST(k AS VARCHAR), 2, '0') || ',c18.3:0.' || lpad(CAST(k AS VARCHAR), 2, '0') || ',bad,c9.1:nan,c18.2:-0.5,c18.1:x' AS dims,
  {_case("k % 5", enumerate(PLACES))} AS locations FROM base)"""

_cats = " ".join(f"WHEN list_has_any(list_transform(string_split(upper(themes), ';'), lambda x: trim(x)), [{listed(v)}]) THEN '{k}'" for k, v in C.CATEGORIES.items())

SCORED_SQL = (
    ARTICLES_SQL
    + f""",
parts AS (SELECT *, {_hits(C.TIER1)} AS t1, {_hits(C.TIER2)} AS t2, {_hits(C.TIER3)} AS t3, {_dim("c18.1")} AS d1, {_dim("c18.2")} AS d2, {_dim("c18.3")} AS d3, {_dim("c9.1")} AS d9 FROM articles),
comps AS (SELECT *, least(0.5, (t1 * 1.0 + t2 * 0.6 + t3 * 0.3) / 3.0)::DOUBLE AS theme_score,
  (CASE WHEN abs(tone_neg) < 5 THEN 0.0 ELSE least(0.2, (abs(tone_neg) - 5) / 25 * 0.2) END + least(0.1, abs(tone_polarity) / 20 * 0.1))::DOUBLE AS tone_score,
  (CASE WHEN t1 > 0 THEN least(0.2, (CASE WHEN d3 > 0.15 THEN d3 ELSE 0 END) * 0.4 + (CASE WHEN d2 > 0.15 THEN d2 ELSE 0 END) * 0.3 + (CASE WHEN d1 > 0.15 THEN d1 ELSE 0 END) * 0.2 + (CASE WHEN d9 > 0.15 THEN d9 ELSE 0 END) * 0.1) ELSE 0 END)::DOUBLE AS dim_score,
  CASE WHEN t1 > 0 THEN 'act' WHEN t2 > 0 THEN 'threat' WHEN t3 > 0 THEN 'context' ELSE 'none' END AS risk_type FROM parts),
totals AS (SELECT *, (CASE WHEN theme_score = 0 THEN 0 ELSE least(1.0, theme_score + tone_score + dim_score) END)::DOUBLE AS risk_score FROM comps),
scored AS (SELECT *, CASE WHEN risk_score = 0 THEN 'none' {_cats} ELSE 'other' END AS category FROM totals)"""
)


def _route_rule(route: str, spec: dict) -> str:
    aliases = [a for p in C.PLACES if p[6] == route for a in p[1]]
    rules = [f"c IN ({listed(spec['countries'])})" + (f" AND adm1 IN ({listed(spec['adm1'])})" if spec["adm1"] else "")]
    rules += [f"regexp_matches(name, '(?i)(^|[^a-z0-9_])({'|'.join(aliases)})($|[^a-z0-9_])')"]
    if spec["bounds"]:
        s, n, w, e = spec["bounds"]
        rules.append(f"(lat BETWEEN {s} AND {n} AND lon BETWEEN {w} AND {e})")
    return " OR ".join(f"({r})" for r in rules)


ROUTES_SQL = (
    SCORED_SQL
    + """,
entries AS (SELECT id, unnest(string_split(locations, ';')) AS entry FROM scored),
fields AS (SELECT id, split_part(entry, '#', 2) AS name, upper(split_part(entry, '#', 3)) AS c, upper(split_part(entry, '#', 4)) AS adm1,
  CASE WHEN try_cast(split_part(entry, '#', 6) AS DOUBLE) IS NOT NULL THEN try_cast(split_part(entry, '#', 5) AS DOUBLE) END AS lat,
  CASE WHEN try_cast(split_part(entry, '#', 5) AS DOUBLE) IS NOT NULL THEN try_cast(split_part(entry, '#', 6) AS DOUBLE) END AS lon
  FROM entries WHERE len(string_split(entry, '#')) >= 6),
tagged AS ("""
    + " UNION ALL ".join(f"SELECT DISTINCT id, {i} AS n, '{r}' AS route FROM fields WHERE {_route_rule(r, s)}" for i, (r, s) in enumerate(C.ROUTES.items()))
    + ")"
)


def daily_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``day, close``: mean order price per day."""
    return table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.round(F.avg("o_totalprice") + 1e-6, 4).alias("close"))


PRICES_SQL = "prices AS (SELECT CAST(o_orderdate AS DATE) AS day, round(avg(o_totalprice) + 1e-6, 4) AS close FROM orders GROUP BY 1)"
