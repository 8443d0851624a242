"""The ingest cycle over feed documents that change, and operators on odd rows."""

import datetime as dt

from pyspark.sql import functions as F

from riskloom.operators import ingest, ordered, rollup, tables
from riskloom.sources import readers, versions


def document(*items):
    entry = "<item><title>{}</title><link>https://x/{}</link><pubDate>Mon, 01 Jan 2024 {:02d}:00:00 GMT</pubDate></item>"
    return "<rss><channel>" + "".join(entry.format(*i) for i in items) + "</channel></rss>"


def test_two_cycles_book_what_is_new(spark, tmp_path):
    feeds = [{"source": c, "source_code": c, "tier": t, "urls": [f"file://{tmp_path}/{c}"]} for c, t in (("A", 1), ("B", 2), ("C", 2))]
    for c in "ABC":
        (tmp_path / c).mkdir()
    (tmp_path / "A" / "1.xml").write_text(document(("Border clash near the mountain pass", 1, 1), ("Rain", 2, 2)))
    (tmp_path / "B" / "1.xml").write_text(document(("BORDER clash near the mountain pass!", 3, 2), ("Nothing of note", 4, 2), ("Border clash near the mountain pass", 1, 5)))
    (tmp_path / "C" / "1.xml").write_text("broken")
    path = str(tmp_path / "t")

    def run(at):
        return {r["source_code"]: (r["fetched"], r["seen"], r["kept"], r["new"], r["repeats"], bool(r["error"])) for r in ingest.cycle(spark, feeds, path, at, backoff=0).collect()}

    assert run("2024-01-01 06:00:00") == {"A": (2, 2, 2, 2, 0, False), "B": (3, 3, 1, 1, 1, False), "C": (0, 0, 0, 0, 0, True)}
    ids = {r["link"]: (r["id"], r["duplicate_of"]) for r in versions.read(spark, f"{path}/articles").collect()}
    assert ids["https://x/3"][1] == ids["https://x/1"][0] and ids["https://x/1"][1] is None and len(ids) == 3
    assert versions.read(spark, f"{path}/links").count() == 4
    # The same fetches again, and one more: a repeat of what the first cycle kept, and a story of its own.
    (tmp_path / "C" / "2.xml").write_text(document(("Border clash near the mountain pass.", 9, 3), ("Navy ship seen", 10, 3)))
    assert run("2024-01-01 07:00:00") == {"A": (2, 2, 2, 0, 0, False), "B": (3, 3, 1, 0, 0, False), "C": (2, 2, 2, 2, 1, False)}
    now = {r["link"]: r for r in versions.read(spark, f"{path}/articles").collect()}
    assert len(now) == 5 and now["https://x/9"]["duplicate_of"] == now["https://x/1"]["id"] and now["https://x/10"]["duplicate_of"] is None
    assert now["https://x/1"]["first_seen"] == dt.datetime(2024, 1, 1, 6)
    health = {r["source_code"]: (r["failures"], r["last_success"] is None) for r in versions.read(spark, f"{path}/health").collect()}
    assert health == {"A": (0, False), "B": (0, False), "C": (0, False)}
    assert versions.read(spark, f"{path}/cycles").groupBy("cycle").count().count() == 2


def test_the_row_before_by_stretches(spark):
    rows = [(k, t, f"{k}{t}") for k in "ab" for t in (0, 2, 3, 9, 10, 31)] + [("c", 5, None), ("c", 6, "x")]
    df = spark.createDataFrame(rows, "k string, t int, v string").repartition(3)
    got = {(r["k"], r["t"]): r["p"] for r in ordered.lagged(df, ["k"], "t", "v", "p", width=4).collect()}
    want = {}
    for k in "abc":
        own = sorted((t, v) for j, t, v in rows if j == k)
        want |= {(k, t): (own[i - 1][1] if i else None) for i, (t, _) in enumerate(own)}
    assert got == want


def test_samples_by_names(spark):
    names = [f"2024{i:05d}.zip" for i in range(500)]
    df = spark.createDataFrame([(n,) for n in reversed(names)], "name string").repartition(6)
    got = sorted(r["name"] for r in tables.systematic_sample(df, ["name"], 4, 1).collect())
    assert got == names[1::4]
    some = tables.seeded_sample(df.withColumn("day", F.substring("name", 1, 7)), ["day"], "name", 3)
    assert {r["n"] for r in some.groupBy("day").agg(F.count("*").alias("n")).collect()} == {3}
    again = tables.seeded_sample(df.withColumn("day", F.substring("name", 1, 7)).repartition(2), ["day"], "name", 3)
    assert sorted(map(tuple, some.collect())) == sorted(map(tuple, again.collect()))
    assert sorted(map(tuple, some.collect())) != sorted(map(tuple, tables.seeded_sample(df.withColumn("day", F.substring("name", 1, 7)), ["day"], "name", 3, seed=7).collect()))


def test_null_keys_count_no_articles(spark):
    df = spark.createDataFrame([(1, 0.5, ["a", None]), (1, 0.5, None), (1, 0.1, ["b"])], "day int, risk_score double, keys array<string>")
    got = [tuple(r) for r in rollup.by_group(df, F.col("keys"), "k").select("k", "risk_sum", "total_articles").collect()]
    assert got == [("a", 0.5, 3)]


def test_last_line_of_a_day_stays(spark, tmp_path):
    (tmp_path / "p.csv").write_text("Date,Close\n2024-01-01,9\n2024-01-02,5\n01/01/2024,3\nbad,1\n2024-01-02,x\n")
    got = {str(r["day"]): r["close"] for r in readers.series(spark, str(tmp_path / "p.csv")).collect()}
    assert got == {"2024-01-01": 3.0, "2024-01-02": 5.0}


def test_day_files_and_index_frames(spark, tmp_path):
    for d in ("20240101", "20240102", "20240105"):
        spark.range(2).withColumn("d", F.lit(d)).write.parquet(str(tmp_path / "w" / d))
        part = next(p for p in (tmp_path / "w" / d).iterdir() if p.suffix == ".parquet")
        (tmp_path / "days").mkdir(exist_ok=True)
        part.rename(tmp_path / "days" / f"global_processed_{d}.parquet")
    got = readers.day_files(spark, str(tmp_path / "days"), "2024-01-02", "2024-01-05")
    assert {(r["d"], str(r["day"])) for r in got.collect()} == {("20240102", "2024-01-02"), ("20240105", "2024-01-05")}
    raw = spark.createDataFrame([("2024-01-01 05:00:00", "1.5", "7"), ("2024-01-01", "2.5", "x"), (None, "9", "1"), ("2024-01-03", "n/a", None)], "at string, v string, m string").coalesce(1)
    frame = {str(r["day"]): (r["risk_index"], r["ma7"]) for r in readers.index_frame(raw, "at", "v", ma7="m").collect()}
    assert frame == {"2024-01-01": (2.5, None), "2024-01-03": (None, None)}
