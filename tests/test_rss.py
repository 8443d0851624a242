"""The feed source: parsing, fallbacks and retries, and a stream that reads each fetch once."""

from datetime import datetime, timezone

from pyspark.sql import functions as F

from riskloom.functions import constants as C
from riskloom.functions import text
from riskloom.sources import rss

RSS = """<?xml version="1.0"?><rss version="2.0" xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:content="http://purl.org/rss/1.0/modules/content/"><channel><title>t</title><link>https://c</link>
<item><title> One &amp; two </title><link> https://x/1 </link><pubDate>Mon, 01 Jan 2024 05:30:00 +0530</pubDate><description>&lt;b&gt;bold&lt;/b&gt;&amp;nbsp;text</description></item>
<item><title>Two</title><link>https://x/2</link><dc:date>2024-01-02T00:00:00</dc:date><content:encoded>body</content:encoded></item>
<item><title></title><link>https://x/3</link></item><item><title>Four</title><pubDate>never</pubDate></item></channel></rss>"""
ATOM = """<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>A</title><link rel="self" href="https://s"/><link href="https://x/9"/><updated>2024-01-03T01:00:00+01:00</updated><content type="html">c</content></entry></feed>"""
DAY = lambda d: datetime(2024, 1, d, tzinfo=timezone.utc)


def test_rss_and_atom_are_parsed():
    entries, error = rss.parse(iter([RSS[:100].encode(), RSS[100:].encode()]))
    assert error is None and entries == [("One & two", "https://x/1", DAY(1), "bold text"), ("Two", "https://x/2", DAY(2), "body"), ("", "https://x/3", None, ""), ("Four", "", None, "")]
    assert rss.parse(iter([ATOM.encode()])) == ([("A", "https://x/9", DAY(3), "c")], None)
    assert rss.parse(iter([b"<rss><channel/></rss>"])) == ([], "no entries")
    assert rss.parse(iter([]))[1].startswith("damaged")


def test_entries_before_a_damage_count():
    entries, error = rss.parse(iter([RSS[: RSS.index("<item><title>Two")].encode() + b"<item><title>cut & off"]))
    assert [e.title for e in entries] == ["One & two"] and error.startswith("damaged")


def test_retries_then_fallback():
    tries, waits = [], []

    def read(url):
        tries.append(url)
        if url.startswith("a") and len(tries) < 3:
            raise TimeoutError
        if url.startswith("a"):
            return iter([b"<rss/>"])
        return iter([ATOM.encode()])

    got = rss.fetch(["a", "b"], "n", retries=2, backoff=7, read=read, wait=waits.append)
    assert (got.url, got.attempts, got.error, len(got.entries)) == ("b", 4, None, 1) and waits == [7, 7]

    def absent(url):
        raise FileNotFoundError

    assert rss.fetch(["a", "b"], "n", read=absent, wait=waits.append) == ([], None, 2, "unreadable: FileNotFoundError")

    def broken(url):
        raise OSError

    assert rss.fetch(["a"], "n", retries=1, read=broken, wait=waits.append).attempts == 2


def put(folder, name, content):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text(content)


def test_stream_reads_each_fetch_once(spark, tmp_path):
    feeds = [{"source": "S", "source_code": "S", "tier": 1, "urls": [f"file://{tmp_path}/s"]}, {"source": "T", "source_code": "T", "tier": 2, "urls": [f"file://{tmp_path}/none", f"file://{tmp_path}/t"]}]
    put(tmp_path / "s", "001.xml", RSS)
    put(tmp_path / "t", "001.xml", ATOM)
    out, state = str(tmp_path / "out"), str(tmp_path / "state")

    def run():
        stream = rss.entries(spark, feeds, streaming=True, backoff=0)
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(once=True).start().awaitTermination()
        return sorted((r["source_code"], r["fetch"], r["link"]) for r in spark.read.parquet(out).collect())

    first = [("S", "001.xml", "https://x/1"), ("S", "001.xml", "https://x/2"), ("T", "001.xml", "https://x/9")]
    assert run() == first
    assert run() == first
    put(tmp_path / "t", "002.xml", ATOM.replace("x/9", "x/10"))
    assert run() == [*first, ("T", "002.xml", "https://x/10")]


def test_status_and_candidates(spark, tmp_path):
    feeds = [{"source": "S", "source_code": "S", "tier": 2, "urls": [f"file://{tmp_path}/s"]}]
    put(tmp_path / "s", "1.xml", RSS.replace("Two</title>", "On the navy</title>"))
    put(tmp_path / "s", "2.xml", "nothing")
    status = sorted(tuple(r) for r in rss.entries(spark, feeds, "status", backoff=0).collect())
    assert [(r[2], r[4], r[5], r[6], bool(r[7])) for r in status] == [("1.xml", 1, 4, 2, False), ("2.xml", 1, 0, 0, True)]
    got = rss.candidates(rss.entries(spark, feeds, backoff=0), C.KEYWORDS).collect()
    assert [(r["title"], r["matched_keywords"], r["confidence"]) for r in got] == [("On the navy", ["navy"], "filtered_match")]


def test_many_small_fetches_are_few_partitions(spark, tmp_path):
    n = 300
    for i in range(n):
        put(tmp_path / "s", f"{i:03d}.xml", "nothing" if i % 50 == 7 else RSS)
    feeds = [{"source": "S", "source_code": "S", "tier": 1, "urls": [f"file://{tmp_path}/s"]}]
    found = rss.entries(spark, feeds, backoff=0)
    assert found.rdd.getNumPartitions() <= rss.SPREAD + 1
    assert [(r["fetch"], r["position"]) for r in found.orderBy("fetch", "position").collect()] == [(f"{i:03d}.xml", k) for i in range(n) if i % 50 != 7 for k in (0, 1)]
    many = rss.dealt([(feeds[0], [str(i) for i in range(100_001)]), (feeds[0], [])])
    assert len(many) == 201 and [x for p in many for x in p.names] == [str(i) for i in range(100_001)]
    assert len(rss.dealt([(feeds[0], ["a", "b"])])) == 2


def test_both_kinds_of_rows_from_one_reading(spark, tmp_path):
    for i in range(3):
        put(tmp_path / "s", f"{i}.xml", "nothing" if i == 1 else RSS)
    feeds = [{"source": "S", "source_code": "S", "tier": 2, "urls": [f"file://{tmp_path}/none", f"file://{tmp_path}/s"]}]
    rows = lambda kind: rss.entries(spark, feeds, kind, backoff=0)
    both = rows("both")
    listed = lambda df, like: sorted(map(str, df.select(*like.columns).collect()))
    assert listed(both.where("position IS NOT NULL"), rows("entries")) == listed(rows("entries"), rows("entries"))
    assert listed(both.where("position IS NULL"), rows("status")) == listed(rows("status"), rows("status"))


def test_keywords_by_folded_characters(spark):
    texts = ["naval exerci\u017fe", "\u0130S\u0131 \u212a", "bilateral talks, cross-border MEAt mea", "quad_ x-S-400.", "", None]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(text.keywords(F.col("t")).alias("k")).collect()
    assert [r["k"] for r in got] == [["naval exercise"], ["ISI"], ["border", "cross-border", "bilateral", "MEA", "bilateral talks"], ["S-400"], [], []]
