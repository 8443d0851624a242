"""Queries of feed documents: written from the driver's events, read back through the feed source."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as C
from ..sources import rss, shared, writers
from . import articles as A
from .registry import query

FEEDS = {"ERROR": 1, "CLICK": 1, "PURCHASE": 2, "VIEW": 2, "SIGNUP": 2}
#: Entries of one fetch.
FETCH = 400
TOPICS = ("border", "weather", "S-400 & Quad", "trade")


def _topic(sql: bool = False):
    if sql:
        return "CASE event_id % 4 " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(TOPICS)) + " END"
    return A.cases(F.col("event_id") % 4, enumerate(TOPICS))


def _escaped(text):
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def _element(tag: str, content):
    return F.concat(F.lit(f"<{tag}>"), content, F.lit(f"</{tag}>"))


def feed_folders(root: str) -> list[dict]:
    """The feeds as they are configured: each has a first address and one to fall back on."""
    return [{"source": code.title(), "source_code": code, "tier": tier, "urls": [f"{root}/first/{code}", f"{root}/second/{code}"]} for code, tier in FEEDS.items()]


def feed_documents(spark, sf_dir, root: str) -> None:
    """Events as RSS (tier 1) and Atom (tier 2) documents, one a fetch.

    Of three fetches the first address has one, lacks one, and has one that is
    damaged before its first entry; the second address has them all.
    """
    e = A.table(spark, sf_dir, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), F.upper("event_type").alias("code"))
    title = _escaped(F.concat(F.lit("Report "), F.col("event_id"), F.lit(": "), _topic()))
    body = _escaped(F.concat(F.lit("<p>Seen by <b>user</b>\n "), F.col("user_id"), F.lit(" &#38; others</p>")))
    link = F.when(F.col("event_id") % 11 == 0, "").otherwise(F.concat(F.lit("https://x.example/"), F.col("event_id")))
    local = F.date_format(F.from_utc_timestamp("ts", "+05:30"), "EEE, dd MMM yyyy HH:mm:ss")
    iso = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))
    fifth = F.col("event_id") % 5 == 0
    item = _element("item", F.concat(_element("title", title), _element("link", link), F.when(fifth, _element("dc:date", iso)).otherwise(_element("pubDate", F.concat(local, F.lit(" +0530")))), _element("description", body)))
    entry = _element("entry", F.concat(_element("title", title), F.lit('<link rel="self" href="https://x.example/self"/><link rel="alternate" href="'), link, F.lit('"/>'), F.when(fifth, _element("updated", iso)).otherwise(F.concat(_element("published", iso), _element("updated", F.lit("2030-01-01T00:00:00Z")))), F.lit('<summary type="html">'), body, F.lit("</summary>")))
    first_tier = F.col("code").isin(*[c for c, t in FEEDS.items() if t == 1])
    listed = e.select("code", (F.col("event_id") / FETCH).cast("long").alias("fetch"), F.struct("event_id", F.when(first_tier, item).otherwise(entry).alias("xml")).alias("one"))
    # A fetch is FETCH ids at most.
    fetches = listed.groupBy("code", "fetch").agg(F.array_join(F.transform(F.array_sort(F.collect_list("one")), lambda x: x["xml"]), "\n").alias("inside"))
    whole = F.when(first_tier, F.concat(F.lit('<?xml version="1.0"?><rss version="2.0" xmlns:dc="http://purl.org/dc/elements/1.1/"><channel><title>all</title>'), F.col("inside"), F.lit("</channel></rss>"))).otherwise(F.concat(F.lit('<feed xmlns="http://www.w3.org/2005/Atom"><title>all</title>'), F.col("inside"), F.lit("</feed>")))
    name = F.format_string("%09d.xml", "fetch")
    third = F.col("fetch") % 3
    place = lambda url, content: F.struct(F.concat(F.lit(f"{root}/{url}/"), "code").alias("folder"), content.alias("content"))
    cut = F.when(third == 2, "<rss><channel><item><title>cut").otherwise(whole)
    # Events are read once for both addresses.
    both = fetches.select(name.alias("name"), F.inline(F.when(third == 1, F.array(place("second", whole))).otherwise(F.array(place("second", whole), place("first", cut)))))
    writers.documents(both, "folder", "name", "content")


@query(f"""WITH e AS (SELECT event_id, user_id, ts, upper(event_type) AS code, {_topic(sql=True)} AS topic, upper(event_type) IN ('ERROR', 'CLICK') AS first_tier FROM events WHERE event_id % 11 <> 0),
k AS (SELECT *, CASE WHEN first_tier THEN '' WHEN topic = 'border' THEN 'border' WHEN topic = 'S-400 & Quad' THEN 'Quad,S-400' END AS keywords FROM e)
SELECT 'https://x.example/' || event_id AS link, code AS source_code, CASE WHEN first_tier THEN 1 ELSE 2 END AS tier, CASE WHEN first_tier THEN 'high' ELSE 'filtered_match' END AS confidence, keywords,
 'Report ' || event_id || ': ' || topic AS title, 'Seen by user ' || user_id || ' & others' AS description, CAST(floor(epoch(ts)) AS BIGINT) AS at, strftime(ts, '%B %d, %Y %H:%M') AS raw FROM k WHERE keywords IS NOT NULL""")
def rss_entries(spark, sf_dir):
    """Candidates of all feeds: entries with title and link, tier 2 by keyword, whichever address answered."""
    root = shared.run_folder(spark, "feeds")
    feed_documents(spark, sf_dir, root)
    found = rss.candidates(rss.entries(spark, feed_folders(root), backoff=0), C.KEYWORDS)
    return found.select("link", "source_code", "tier", "confidence", F.array_join("matched_keywords", ",").alias("keywords"), "title", "description", F.unix_seconds("published").alias("at"), F.col("published_raw").alias("raw"))


@query(f"""WITH f AS (SELECT upper(event_type) AS code, event_id // {FETCH} AS part, count(*) AS fetched, count(*) FILTER (WHERE event_id % 11 <> 0) AS seen FROM events GROUP BY 1, 2)
SELECT code AS source_code, count(*) AS fetches, CAST(sum(fetched) AS BIGINT) AS fetched, CAST(sum(seen) AS BIGINT) AS seen, count(*) FILTER (WHERE part % 3 <> 0) AS fallbacks, CAST(sum(CASE WHEN part % 3 = 0 THEN 1 ELSE 2 END) AS BIGINT) AS attempts, 0 AS failed FROM f GROUP BY 1""")
def rss_status(spark, sf_dir):
    """Per feed: fetches, entries, valid entries, answers by the second address, attempts, and fetches without entries."""
    root = shared.run_folder(spark, "feeds")
    feed_documents(spark, sf_dir, root)
    found = rss.entries(spark, feed_folders(root), rows="status", backoff=0)
    return found.groupBy("source_code").agg(F.count("*").alias("fetches"), F.sum("fetched").alias("fetched"), F.sum("seen").alias("seen"), F.count_if(F.contains("url", F.lit("/second/"))).alias("fallbacks"), F.sum("attempts").alias("attempts"), F.count_if(F.col("fetched") == 0).alias("failed"))


@query(f"""WITH e AS (SELECT event_id, upper(event_type) AS code, upper(event_type) IN ('ERROR', 'CLICK') OR event_id % 4 IN (0, 2) AS kept FROM events)
SELECT code AS source_code, count(*) AS fetched, count(*) FILTER (WHERE event_id % 11 <> 0) AS seen, count(*) FILTER (WHERE event_id % 11 <> 0 AND kept) AS kept, count(*) FILTER (WHERE event_id % 11 <> 0 AND kept) AS new, 0 AS repeats, 0 AS again, count(*) FILTER (WHERE event_id % 11 <> 0) AS links, 0 AS failures FROM e GROUP BY 1""")
def ingest_cycle(spark, sf_dir):
    """Two ingest cycles over the same fetches: the first books everything, the second nothing (titles are compared in the tests)."""
    from ..operators import ingest
    from ..sources import versions

    root = shared.run_folder(spark, "feeds")
    feed_documents(spark, sf_dir, root)
    run = lambda at: ingest.cycle(spark, feed_folders(root), f"{root}/tables", at, compare_titles=False, backoff=0)
    first, second = run("2024-02-01 06:00:00"), run("2024-02-01 07:00:00")
    links = versions.read(spark, f"{root}/tables/links").groupBy("source_code").agg(F.count("*").alias("links"))
    health = versions.read(spark, f"{root}/tables/health").select("source_code", "failures")
    return first.drop("error").join(second.select("source_code", F.col("new").alias("again")), "source_code").join(links, "source_code").join(health, "source_code")
