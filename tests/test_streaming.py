"""Streaming jobs over files, run to their end."""

import json

from pyspark.sql import functions as F

from riskloom.sources import readers
from riskloom.streaming import jobs


def entries(spark, folder, rows):
    folder.mkdir(exist_ok=True)
    (folder / f"{len(list(folder.iterdir()))}.json").write_text("\n".join(json.dumps(r) for r in rows))
    return readers.feed_entries(spark, str(folder), streaming=True)


ROWS = [
    {"link": "a", "source": "s", "title": "Border clash reported", "published": "2024-01-01T00:00:00Z"},
    {"link": "a", "source": "s", "title": "again", "updated": "2024-01-01T01:00:00Z"},
    {"link": "b", "source": "s", "title": "Border clash reported!", "published": "2024-01-01T01:00:00Z"},
    {"link": "c", "source": "s", "title": "Other", "published": "2024-01-02T05:00:00Z"},
]


def test_first_link_wins_and_days_are_replaced(spark, tmp_path):
    stream = entries(spark, tmp_path / "in", ROWS)
    taken = []
    jobs.run_available(jobs.first_links(stream), lambda b, _: taken.extend(r["link"] for r in b.collect()), str(tmp_path / "c1"))
    assert sorted(taken) == ["a", "b", "c"]
    out = str(tmp_path / "days")
    counted = jobs.day_counts(stream.withColumn("risk_score", F.lit(1.0)))
    jobs.run_available(counted, jobs.upsert_days(out), str(tmp_path / "c2"), "update")
    assert {str(r["day"]): r["n"] for r in spark.read.parquet(out).collect()} == {"2024-01-01": 3, "2024-01-02": 1}


def test_titles_in_state(spark, tmp_path):
    stream = entries(spark, tmp_path / "in", ROWS).where("link <> 'a' or title <> 'again'").withColumn("id", F.ascii("link").cast("long"))
    got = {}
    jobs.run_available(jobs.similar_within(stream, "source"), lambda b, _: got.update({r["id"]: r["duplicate_of"] for r in b.collect()}), str(tmp_path / "c3"))
    assert got == {97: None, 98: 97, 99: None}
