"""The refresh stream, resumed batches, versioned tables and regressions, against plain reckoning."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.operators import resume, rollup, scoring, stats, timeseries
from riskloom.plans import cycles
from riskloom.sources import versions
from riskloom.streaming import jobs

SF = "/root/testdata/sf0.001"
ARTICLE = "id long, event_time timestamp, day date, themes string, tone_neg double, tone_polarity double, dims string, locations string"


def articles(spark, rows):
    made = [(i, dt.datetime(2024, 1, d, h), dt.date(2024, 1, d), t, 10.0 + i % 7, 3.0, "c18.3:0.5", "") for i, d, h, t in rows]
    return spark.createDataFrame(made, ARTICLE)


def feed(n, days):
    return [(i, 1 + i % days, i % 24, ("ARMEDCONFLICT", "SANCTION;NUCLEAR", "WEATHER")[i % 3]) for i in range(n)]


def series(df):
    return {str(r["day"]): (r["total_articles"], r["risk_index"] and round(r["risk_index"], 8)) for r in df.collect()}


def full(spark, rows):
    return series(timeseries.index_series(rollup.daily(scoring.score_articles(articles(spark, rows))), "2024-01-01", "2024-01-31"))


def test_late_and_repeated_articles_give_the_full_run(spark, tmp_path):
    rows = feed(200, 9)
    sink = jobs.refresh_index(str(tmp_path / "t"), ("2024-01-01", "2024-01-31"), "2024-01-01")
    sink(articles(spark, rows[:150]), 0)
    # A batch with repeats of earlier articles, and late ones of days long scored.
    sink(articles(spark, rows[140:]), 1)
    got = series(jobs.current_index(spark, str(tmp_path / "t")))
    assert got == full(spark, rows)
    sink(articles(spark, rows[140:]), 1)
    sink(articles(spark, rows[:150]), 0)
    assert series(jobs.current_index(spark, str(tmp_path / "t"))) == got
    sink(articles(spark, []), 2)
    assert series(jobs.current_index(spark, str(tmp_path / "t"))) == got


def test_a_batch_that_died_before_its_switch_runs_again(spark, tmp_path, monkeypatch):
    rows, path = feed(120, 8), str(tmp_path / "t")
    sink = jobs.refresh_index(path, ("2024-01-01", "2024-01-31"), "2024-01-01")
    sink(articles(spark, rows[:60]), 0)
    before = series(jobs.current_index(spark, path))
    with monkeypatch.context() as m:
        m.setattr(versions, "commit", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            sink(articles(spark, rows[60:]), 1)
    assert series(jobs.current_index(spark, path)) == before
    sink(articles(spark, rows[60:]), 1)
    assert series(jobs.current_index(spark, path)) == full(spark, rows)


def test_the_index_waits_for_enough_days(spark, tmp_path):
    path = str(tmp_path / "t")
    sink = jobs.refresh_index(path, ("2024-01-01", "2024-01-31"), "2024-01-02", least=3)
    sink(articles(spark, [(1, 9, 0, "ARMEDCONFLICT"), (2, 1, 0, "SANCTION")]), 0)
    assert {r["ready"] for r in jobs.current_index(spark, path).collect()} == {False}
    assert {r["risk_index"] for r in jobs.current_index(spark, path).collect()} == {None}
    sink(articles(spark, [(3, 3, 0, "ARMEDCONFLICT"), (4, 4, 0, "SANCTION")]), 1)
    assert {r["ready"] for r in jobs.current_index(spark, path).collect()} == {True}
    # While the product is younger than that, all its days are enough.
    young = jobs.refresh_index(str(tmp_path / "y"), ("2024-01-01", "2024-01-31"), "2024-01-02", least=3)
    young(articles(spark, [(1, 2, 0, "ARMEDCONFLICT")]), 0)
    assert {r["ready"] for r in jobs.current_index(spark, str(tmp_path / "y")).collect()} == {True}


def test_versions_are_switched_and_old_ones_go(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    assert versions.current(spark, path) == -1
    with pytest.raises(FileNotFoundError):
        versions.read(spark, path)
    for k in range(4):
        versions.write(spark.range(k + 1), path)
    assert versions.read(spark, path).count() == 4
    assert sorted(p.name for p in (tmp_path / "t").iterdir() if p.name.startswith("version")) == ["version=2", "version=3"]
    # A version that was written and never switched to isn't seen, and goes with the next commit.
    spark.range(99).write.parquet(versions.folder(path, 9))
    assert versions.read(spark, path).count() == 4
    versions.write(spark.range(7), path)
    assert versions.read(spark, path).count() == 7 and not (tmp_path / "t" / "version=9").exists()


def test_a_batch_that_died_resumes(spark, tmp_path):
    path, calls = str(tmp_path / "b"), []
    every = resume.ranges(dt.date(2024, 1, 1), dt.date(2024, 1, 10), 3)
    assert [(a.day, b.day) for a, b in every] == [(1, 3), (4, 6), (7, 9), (10, 10)]

    def work(a, b, fail=None):
        calls.append(a.day)
        if a.day == fail:
            raise OSError("lost")
        return spark.range(a.day, b.day + 1)

    with pytest.raises(OSError):
        resume.run(spark, path, every, lambda a, b: work(a, b, 7))
    spark.range(5).write.parquet(f"{path}/rows/2024-01-07_2024-01-09")  # rows that were written and not entered
    got = resume.run(spark, path, every, work)
    assert calls == [1, 4, 7, 7, 10] and sorted(r["id"] for r in got.collect()) == list(range(1, 11))
    resume.run(spark, path, every[:1], work, parameters="other")
    assert calls[-1] == 1
    with pytest.raises(ValueError):
        resume.ranges(dt.date(2024, 1, 2), dt.date(2024, 1, 1))


def newey_west(y, x, lags=6):
    """Coefficients, errors, R², Durbin-Watson by plain matrices."""
    x = np.column_stack([np.ones(len(y)), x])
    inverse = np.linalg.inv(x.T @ x)
    beta = inverse @ x.T @ y
    e = y - x @ beta
    u = x * e[:, None]
    s = u.T @ u
    for k in range(1, lags + 1):
        g = u[k:].T @ u[:-k]
        s += (1 - k / (lags + 1)) * (g + g.T)
    return beta, np.sqrt(np.diag(inverse @ s @ inverse)), 1 - (e @ e) / ((y - y.mean()) @ (y - y.mean())), (np.diff(e) @ np.diff(e)) / (e @ e)


def check(got, y, x):
    beta, errors, r2, dw = newey_west(y, x)
    assert np.allclose([r["coef"] for r in got], beta) and np.allclose([r["se"] for r in got], errors)
    assert all(np.isclose(r["r2"], r2) and np.isclose(r["dw"], dw) and r["n"] == len(y) for r in got)
    assert all(np.isclose(r["p"], math.erfc(abs(r["coef"] / r["se"]) / math.sqrt(2))) and r["low"] < r["coef"] < r["high"] for r in got)


def test_regression_equals_matrix_algebra(spark):
    rng = np.random.default_rng(5)
    n = 300
    x = rng.normal(size=(n, 2)).cumsum(0)
    y = 2 + x @ [0.5, -1] + rng.normal(size=n).cumsum() * 0.1
    days = [dt.date(2024, 1, 1) + dt.timedelta(3 * i) for i in range(n)]
    rows = [(d, float(a), float(b), float(c)) for d, a, (b, c) in zip(days, y, x)]
    gone = [(dt.date(2030, 1, 1), None, 1.0, 1.0), (dt.date(2031, 1, 1), 1.0, None, 1.0)]
    df = spark.createDataFrame(rows[::-1] + gone, "day date, y double, a double, b double").repartition(5)
    got = stats.ols(df, "y", ["a", "b"], "day").collect()
    assert [r["term"] for r in got] == ["const", "a", "b"]
    check(got, y, x)
    singular = stats.ols(df.withColumn("c", F.col("a") * 2), "y", ["a", "c"], "day").collect()
    assert [r["coef"] for r in singular] == [None] * 3


def test_the_four_regressions(spark):
    rows = cycles.months(spark, SF).toPandas().sort_values("month")
    got = cycles.regressions(spark, SF).collect()
    for name, (y, xs) in cycles.REGRESSIONS.items():
        known = rows[[y, *xs]].dropna().astype(float)
        check([r for r in got if r["model"] == name], known[y].to_numpy(), known[list(xs)].to_numpy())
