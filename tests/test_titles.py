"""Similar titles: the prefix filter, the batch and the stateful form, against pairwise brute force."""

import datetime as dt
import difflib
import random

import pytest
from pyspark.sql import functions as F

from riskloom.operators import components, similar_titles
from riskloom.streaming import jobs

START = dt.datetime(2024, 1, 1)
HEADS = ("border clash reported near the pass", "talks on trade resume in the capital", "navy ship docks at chabahar", "a", "ab", "abc", "abcd", "abcde", "short one", "ministers meet")


def headlines(n, seed, minutes=4):
    """Rows with typos, repeats, ties, blanks, and some without a time."""
    rng, out = random.Random(seed), []
    for i in range(n):
        t = list(rng.choice(HEADS))
        for _ in range(rng.choice([0, 0, 1, 2, 4])):
            at = rng.randrange(len(t) + 1)
            t[at : at + rng.randint(0, 1)] = rng.choice(["", "x", "e", " "])
        title = "".join(t).upper() if rng.random() < 0.2 else " " + "".join(t)
        at = None if rng.random() < 0.03 else START + dt.timedelta(minutes=rng.randrange(n * minutes))
        out.append((i, None if rng.random() < 0.02 else title, at))
    return out


def brute(rows, threshold=0.85, seconds=7200):
    kept, out = [], {i: None for i, _, _ in rows}
    for at, i, t in sorted((at, i, t.strip().lower()) for i, t, at in rows if t is not None and at is not None and t.strip()):
        copied = next((j for b, j, u in kept if (at - b).total_seconds() <= seconds and difflib.SequenceMatcher(None, t, u).ratio() >= threshold), None)
        out[i] = copied
        if copied is None:
            kept.append((at, i, t))
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, title string, event_time timestamp")


def test_titles_alike_share_a_key():
    rng = random.Random(1)
    met = 0
    for _ in range(30_000):
        a = "".join(rng.choice("abc e") for _ in range(rng.randint(1, 14)))
        b = list(a)
        for _ in range(rng.randint(0, 4)):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randint(0, 1)] = rng.choice(["", "a", "z"])
        b = "".join(b)
        if b and difflib.SequenceMatcher(None, a, b).ratio() >= 0.85:
            met += 1
            assert set(similar_titles.keys(a)) & set(similar_titles.keys(b)), (a, b)
    assert met > 3000


def test_batch_equals_brute_force(spark):
    for seed in (2, 3):
        rows = headlines(250, seed)
        got = {r["id"]: r["duplicate_of"] for r in similar_titles.resolve(frame(spark, rows)).collect()}
        assert got == brute(rows)
    assert similar_titles.resolve(frame(spark, [])).count() == 0


def test_ten_thousand_equal_titles_make_no_pairs(spark):
    n = 10_000
    rows = spark.range(n).select("id", F.lit("The same headline").alias("title"), F.timestamp_seconds(F.col("id") * 0.5).alias("event_time"))
    near = rows.select(similar_titles.clean(F.col("title")).alias("t"), F.floor(F.unix_seconds("event_time") / 7200).alias("cell"))
    assert similar_titles.similar_texts(near).count() == 0
    got = similar_titles.resolve(rows).groupBy("duplicate_of").count().collect()
    assert {r["duplicate_of"]: r["count"] for r in got} == {None: 1, 0: n - 1}


def test_index_rows_are_numbers(spark):
    long = spark.range(40).select(F.concat(F.lpad(F.col("id").cast("string"), 2, "0"), F.repeat(F.lit(" words of a long title"), 6)).alias("t"), F.lit(0).alias("cell"))
    pairs = similar_titles.similar_texts(long)
    assert dict(pairs.dtypes) == {"a": "bigint", "b": "bigint"}
    assert pairs.count() == 40 * 39 // 2


def test_texts_of_one_node_are_compared_themselves(spark, monkeypatch):
    monkeypatch.setattr(similar_titles, "node", lambda t: F.xxhash64(t) % 7)
    for seed in (5, 6):
        rows = headlines(120, seed)
        assert {r["id"]: r["duplicate_of"] for r in similar_titles.resolve(frame(spark, rows)).collect()} == brute(rows)


def test_components_of_paths_and_stars(spark):
    path = [(i, i + 1) for i in range(300)] + [(1000, i) for i in range(1001, 1100)] + [(5000, 5000)]
    got = {r["node"]: r["label"] for r in components.components(spark.createDataFrame(path, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(301)} | {i: 1000 for i in range(1000, 1100)}
    assert components.components(spark.createDataFrame([], "a string, b string")).count() == 0


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(key, before)


def test_stateful_form_equals_batch(spark, tmp_path, rocks):
    rows = sorted((r for r in headlines(80, 4) if r[2] is not None), key=lambda r: (r[2], r[0]))
    source, out, state = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")

    def arrive(some):
        frame(spark, some).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("id long, title string, event_time timestamp").parquet(source)
        jobs.run_available(jobs.similar_pairs(stream), jobs.claim_titles(out), state)

    arrive(rows[:40])
    arrive(rows[40:])
    got = {r["id"]: r["duplicate_of"] for r in spark.read.parquet(out).collect()}
    want = brute(rows)
    assert got == {i: want[i] for i, t, _ in rows if t and t.strip()}
    assert any(v is not None for v in got.values())
