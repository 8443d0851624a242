"""Feeds: conjunctive filters, headline selection, ranking, topics."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import text


def matching(**wanted) -> Column:
    """Conjunction of the filters that are given: tier, theme and route (substrings, ``_`` a wildcard), start, end (half open), tagged_only."""
    rules = [F.col("tier").isNotNull() & F.col("duplicate_of").isNull()]
    if (tier := wanted.get("tier")) is not None:
        rules.append(F.col("tier") == tier)
    if theme := wanted.get("theme"):
        rules.append(F.col("themes").ilike(f"%{theme}%"))
    if route := wanted.get("route"):
        rules.append(F.col("themes").ilike(f"%{route}%") | F.col("locations").ilike(f"%{route}%") | F.col("title").ilike(f"%{route}%"))
    if start := wanted.get("start"):
        rules.append(F.col("event_time") >= F.lit(start).cast("timestamp"))
    if end := wanted.get("end"):
        rules.append(F.col("event_time") < F.lit(end).cast("timestamp"))
    if wanted.get("tagged_only"):
        rules.append(F.coalesce(F.trim("themes"), F.lit("")) != "")
    return reduce(lambda a, b: a & b, [F.coalesce(r, F.lit(False)) for r in rules])


def newest(rows: DataFrame, limit: int, by: str = "event_time", tie: str = "id") -> DataFrame:
    """The newest rows, nulls last: a top-k, no full sort."""
    return rows.orderBy(F.desc_nulls_last(by), F.asc(tie)).limit(limit)


def searchable(*columns: str) -> Column:
    return F.lower(F.concat_ws(" ", *columns))


def any_of(body: Column, words: Sequence[str]) -> Column:
    """Whether the text has any of the words: one pattern, so the text is built once."""
    return body.rlike("|".join(map(re.escape, words)))


def driving(rows: DataFrame, market_words: Sequence[str], route: str | None = None, limit: int = 8, geo_tokens: Sequence[str] = C.GEO_TOKENS, tone_floor: float = 0.35) -> DataFrame:
    """Headlines that move the market: those with a market or route word first; purely geopolitical ones join if fewer than three remain."""
    body = searchable("title", "themes", "locations")
    gate = (F.col("tier") == 1) | any_of(body, geo_tokens) | (F.col("tone_neg") >= tone_floor)
    tokens = [t for t in (route or "").lower().replace("_", " ").split() if len(t) > 3]
    market, on_route = any_of(body, market_words), any_of(body, tokens) if tokens else F.lit(False)
    reason = F.when(on_route, "corridor_match").when(market, "market_keyword").otherwise("geo_theme")
    passed = rows.where(F.coalesce(gate, F.lit(False))).withColumns({"why": reason, "_both": (market | on_route).cast("int")})
    # One top-k: with fewer than ``limit`` of the first bucket all of them are in it, so its rows tell their number.
    top = passed.orderBy(F.desc("_both"), F.desc("event_time"), "id").limit(limit)
    short = F.sum("_both").over(Window.partitionBy()) < min(3, limit)
    return top.withColumn("_short", short).where((F.col("_both") == 1) | F.col("_short")).drop("_both", "_short")


def brief_score(preferred: Sequence[str], min_tier: int) -> Column:
    """Recency, tier, tags and preferences as one number."""
    themes = F.upper(F.coalesce("themes", F.lit("")))
    liked = any_of(themes, preferred) if preferred else F.lit(False)
    return (
        F.coalesce(F.unix_millis("event_time"), F.lit(0)) / 1e12
        + F.when(F.col("tier") == 1, 100).when(F.col("tier") == 2, 40).otherwise(0)
        + F.when(F.trim(themes) != "", 20).otherwise(0)
        + F.when(liked, 30).otherwise(0)
        + F.when(F.col("tier") <= min_tier, 15).otherwise(0)
    )


def hero(rows: DataFrame, by: str = "position") -> DataFrame:
    """First of tier 1, else first tagged, else first."""
    rank = F.when(F.col("tier") == 1, 0).when(F.coalesce(F.trim("themes"), F.lit("")) != "", 1).otherwise(2)
    return rows.agg(F.min_by(F.struct(*rows.columns), F.struct(rank.alias("r"), F.col(by).alias("p"))).alias("h")).select("h.*")


def dominant_topic(rows: DataFrame, by: str = "position") -> DataFrame:
    """The most frequent topic but General, the earliest seen on ties."""
    topics = rows.select(text.article_topic(F.col("themes")).alias("topic"), F.col(by).alias("p")).where("topic <> 'General'")
    return topics.groupBy("topic").agg(F.count("*").alias("n"), F.min("p").alias("p")).agg(F.max_by(F.struct("topic", "n"), F.struct("n", (-F.col("p")).alias("p"))).alias("t")).select("t.*")


def argmax(rows: DataFrame, value: str, tie: str, keys: Sequence[str] = ()) -> DataFrame:
    """The row with the largest value per key, the smallest ``tie`` on equals."""
    w = Window.partitionBy(*keys).orderBy(F.desc_nulls_last(value), F.asc(tie))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def checks_summary(checks: DataFrame) -> DataFrame:
    """Counts by status and the overall one: any failure, else any warning, else a pass, else n/a."""
    counts = [F.count_if(F.col("status") == s).alias(s) for s in ("pass", "fail", "warn", "na")]
    return checks.agg(*counts).withColumn("overall", F.when(F.col("fail") > 0, "fail").when(F.col("warn") > 0, "warn").when(F.col("pass") > 0, "pass").otherwise("na"))


def check(identifier: str, value: Column, passes: Column, threshold: str) -> Column:
    """A quality record: n/a without a value, else pass or fail."""
    status = F.when(value.isNull(), "na").when(passes, "pass").otherwise("fail")
    return F.struct(F.lit(identifier).alias("id"), value.cast("double").alias("value"), F.lit(threshold).alias("threshold"), status.alias("status"))


def label_sets(expected: Column, forbidden: Column, found: Column) -> Column:
    """Whether all expected labels and no forbidden one are found."""
    return (F.size(F.array_except(expected, found)) == 0) & (F.size(F.array_intersect(forbidden, found)) == 0)


def lookup(mapping: Mapping[str, str], key: Column, default: Column) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, key), default)


def board(rows: DataFrame, value: Column | None, tie: str) -> DataFrame:
    """A short list with ``position``: by a value from the top down (nulls last), then by a column."""
    order = ([value.desc_nulls_last()] if value is not None else []) + [F.asc(tie)]
    return rows.withColumn("position", F.row_number().over(Window.partitionBy().orderBy(*order)).cast("long"))


def extracted() -> Column:
    """Canonical articles whose tags are all there."""
    there = [F.col(c).isNotNull() for c in ("tier", "extracted_at", "tone_neg", "tone_polarity", "version")]
    return reduce(lambda a, b: a & b, there) & F.col("duplicate_of").isNull() & (F.coalesce("dims", F.lit("")) != "")


def feeds_due(feeds: DataFrame, health: DataFrame, now: Column, seconds: Mapping[int, int] = C.FEED_SECONDS) -> DataFrame:
    """``tier, due, stale``: whether any feed of a tier waits since its interval, and how many had no success in two.

    ``feeds`` is ``feed, tier``; ``health`` is ``feed, last_attempt, last_success``. A feed never tried is due and stale.
    """
    wait = F.create_map(*[F.lit(x) for kv in seconds.items() for x in kv])
    passed = lambda c: F.unix_seconds(now) - F.unix_seconds(c)
    rows = feeds.join(health, "feed", "left").withColumn("_wait", F.try_element_at(wait, F.col("tier")))
    due = F.col("last_attempt").isNull() | (passed(F.col("last_attempt")) >= F.col("_wait"))
    stale = F.col("last_success").isNull() | (passed(F.col("last_success")) > 2 * F.col("_wait"))
    return rows.groupBy("tier").agg(F.bool_or(due).alias("due"), F.count_if(stale).alias("stale"))


def status_rank(status: Column) -> Column:
    return F.when(status == "pass", 0).when(status == "warn", 1).when(status == "fail", 2).when(status == "na", 3).otherwise(4)


def check_cells(checks: DataFrame, most: int = 80) -> DataFrame:
    """Checks for display: passes first, then warnings, failures and the rest, at most ``most``."""
    return checks.withColumn("_r", status_rank(F.col("status"))).orderBy("_r", "id").limit(most).drop("_r")


def headline_checks(checks: DataFrame, fixed: Sequence[str], most: int = 5, least: int = 4) -> DataFrame:
    """The fixed checks, in their order; if fewer than ``least`` are there, others that apply join up to ``most``."""
    slot = F.coalesce(*[F.when(F.col("id") == f, F.lit(i)) for i, f in enumerate(fixed)], F.lit(len(fixed)))
    picks = F.count_if(F.col("id").isin(*fixed)).over(Window.partitionBy())  # a report's checks: some dozens
    rows = checks.withColumns({"_slot": slot, "_n": picks})
    joins = (F.col("_slot") < len(fixed)) | ((F.col("_n") < least) & (F.col("status") != "na"))
    return rows.where(joins).orderBy("_slot", "id").limit(most).drop("_slot", "_n")
