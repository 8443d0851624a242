"""One ingest cycle as a job: fetch, keep what is new, mark repeats of a story, and book links, feeds and yields."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as C
from ..sources import rss, shared, versions
from . import similar_titles, tables

ARTICLES = "id long, link string, source string, source_code string, tier int, confidence string, matched_keywords array<string>, title string, description string, published timestamp, published_raw string, first_seen timestamp, duplicate_of long, cycle long"
LINKS = "link string, source_code string, tier int, published timestamp, first_seen timestamp"
HEALTH = "source_code string, last_attempt timestamp, last_success timestamp, failures long"
YIELDS = ("fetched", "seen", "kept", "new", "repeats")


def held(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table in versions, or none of its rows yet."""
    return versions.read(spark, path) if versions.current(spark, path) >= 0 else spark.createDataFrame([], schema)


def cycle(spark: SparkSession, feeds: list[dict], path: str, at: str, keywords: tuple[str, ...] = C.KEYWORDS, compare_titles: bool = True, backoff: float = 3.0) -> DataFrame:
    """Run one cycle over all fetches of the feeds; ``source_code`` with the counts of ``YIELDS`` and ``error``.

    The first write of a link stands, within the cycle (by time, then feed)
    and over all cycles. A new article whose title is like one of the two
    hours before is marked as its repeat and kept. Under ``path`` are the
    tables ``articles``, ``links``, ``health`` and ``cycles``, each switched
    whole; a cycle that died before its last switch is run again and finds
    the links that it had booked.
    """
    number = versions.current(spark, f"{path}/cycles") + 1
    now = F.lit(at).cast("timestamp")
    # Each fetch is read once: its entries, and its status without a position.
    both = shared.cut(rss.entries(spark, feeds, rows="both", backoff=backoff))
    status = both.where("position IS NULL").select("source_code", "fetched", "seen", "error")
    found = both.where("position IS NOT NULL").drop("url", "attempts", "fetched", "seen", "error")
    kept = shared.cut(tables.dedup(rss.candidates(found, keywords), ["link"], [F.asc_nulls_last("published"), F.asc("source_code"), F.asc("fetch"), F.asc("position")]))

    before = held(spark, f"{path}/articles", ARTICLES)
    # What an unfinished run of this cycle has booked is booked anew.
    before = before.where(F.col("cycle") < number)
    fresh = kept.join(before.select("link"), "link", "left_anti").withColumns({"id": F.xxhash64("link"), "first_seen": now, "cycle": F.lit(number).cast("long")})
    fresh = shared.cut(fresh)
    time = lambda: F.coalesce("published", "first_seen").alias("event_time")
    if compare_titles:
        since = fresh.agg(F.min(F.coalesce("published", "first_seen")) - F.expr(f"INTERVAL {similar_titles.SECONDS} SECONDS")).first()[0]
        originals = before.where(F.col("duplicate_of").isNull() & (F.coalesce("published", "first_seen") >= F.lit(since)))
        both = originals.select("id", "title", time()).unionByName(fresh.select("id", "title", time()))
        marks = similar_titles.resolve(both).join(fresh.select("id"), "id", "left_semi")
        fresh = fresh.join(marks, "id", "left")
    else:
        fresh = fresh.withColumn("duplicate_of", F.lit(None).cast("long"))
    fresh = shared.cut(fresh.select(*before.columns))
    versions.write(before.unionByName(fresh), f"{path}/articles")

    links = found.select("link", "source_code", "tier", "published", now.alias("first_seen"))
    versions.write(tables.insert_absent(held(spark, f"{path}/links", LINKS), links, ["link"], [F.asc_nulls_last("published"), F.asc("source_code")]), f"{path}/links")

    counts = status.groupBy("source_code").agg(F.sum("fetched").alias("fetched"), F.sum("seen").alias("seen"), F.max(F.when(F.col("fetched") == 0, F.col("error"))).alias("error"))
    asked = spark.createDataFrame([(f["source_code"],) for f in feeds], "source_code string")
    per = lambda rows, name: rows.groupBy("source_code").agg(F.count("*").alias(name))
    out = asked.join(counts, "source_code", "left")
    for rows, name in ((kept, "kept"), (fresh, "new"), (fresh.where("duplicate_of IS NOT NULL"), "repeats")):
        out = out.join(per(rows, name), "source_code", "left")
    out = shared.cut(out.na.fill(0, list(YIELDS)).withColumns({c: F.col(c).cast("long") for c in YIELDS}).select("source_code", *YIELDS, F.when((F.col("fetched") == 0), F.coalesce("error", F.lit("no fetch"))).alias("error")))

    old = held(spark, f"{path}/health", HEALTH)
    ok = F.col("fetched") > 0
    news = out.select("source_code", ok.alias("ok")).join(old, "source_code", "left").select(
        "source_code", now.alias("last_attempt"), F.when(F.col("ok"), now).otherwise(F.col("last_success")).alias("last_success"), F.when(F.col("ok"), F.lit(0).cast("long")).otherwise(F.coalesce("failures", F.lit(0)) + 1).alias("failures")
    )
    versions.write(tables.upsert(old, news, ["source_code"]), f"{path}/health")

    run = out.withColumns({"cycle": F.lit(number).cast("long"), "at": now})
    all_runs = run if number == 0 else versions.read(spark, f"{path}/cycles").unionByName(run)
    versions.write(all_runs, f"{path}/cycles", number)
    return out
