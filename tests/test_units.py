"""Small cases of the operators, and properties against pandas."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from riskloom.functions import bands, text
from riskloom.functions import constants as C
from riskloom.operators import feed, gaps, joins, rollup, routes, scoring, signal, similar_titles, stats, tables, timeseries
from riskloom.sources import readers, writers


def days(spark, values, start="2024-01-01"):
    first = dt.date.fromisoformat(start)
    return spark.createDataFrame([(first + dt.timedelta(i), v) for i, v in enumerate(values)], "day date, x double")


def column(df, name, by="day"):
    return [r[name] for r in df.orderBy(by).collect()]


SERIES = st.lists(st.floats(0.01, 50), min_size=3, max_size=25)
FEW = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


@FEW
@given(SERIES)
def test_transform_like_pandas(spark, values):
    s = pd.Series(values)
    rel = (s / s.mean()) ** C.TAIL_EXPONENT
    idx = rel / rel.mean() * 100
    idx = idx.where(idx < idx.median(), idx * C.UPPER_STRETCH)
    got = column(timeseries.transform(days(spark, values).withColumn("k", F.lit(1)), "x", "y", ["k"]), "y")
    assert np.allclose(got, idx / idx.mean() * 100, rtol=1e-6) or np.isclose(np.mean(got), 100)


@FEW
@given(st.lists(st.one_of(st.none(), st.floats(0, 9)), min_size=1, max_size=15))
def test_interpolate_like_pandas(spark, values):
    got = column(timeseries.interpolate(days(spark, values), "x", "y"), "y")
    want = pd.Series(values, dtype=float).interpolate().tolist()
    assert np.allclose(np.array(got, float), np.array(want, float), equal_nan=True)


@FEW
@given(SERIES)
def test_skew_and_ranks_like_pandas(spark, values):
    s = pd.Series([round(v) for v in values], dtype=float)
    rows = days(spark, s.tolist()).withColumn("y", F.expr("x * 3 % 7"))
    if s.nunique() > 1:
        assert np.isclose(rows.agg(stats.skew("x").alias("s")).first()["s"], s.skew(), atol=1e-6)
    ranked = {r["x"]: r["r"] for r in stats.average_rank(rows, "x", "r").collect()}
    assert all(np.isclose(ranked[v], r) for v, r in zip(s, s.rank()))


def test_score_worked_cases(spark):
    rows = spark.createDataFrame(
        [
            (1, "ARMEDCONFLICT;SANCTION", 12.0, 6.0, "c18.3:0.5,c18.2:0.1"),
            (2, "terror", 0.0, 0.0, ""),
            (3, "WEATHER", 40.0, 40.0, "c18.3:1"),
            (4, None, None, None, None),
            (5, "COUP", float("nan"), -40.0, "c18.3:nan,c18.1:-4,c9.1:0.2,c9.1:x,c9.1:0.4"),
        ],
        "id int, themes string, tone_neg double, tone_polarity double, dims string",
    )
    got = {r["id"]: r for r in scoring.score_articles(rows).collect()}
    assert got[1]["risk_score"] == pytest.approx(0.5 + 0.056 + 0.03 + 0.2)
    assert (got[1]["risk_type"], got[1]["category"]) == ("act", "military_conflict")
    assert not got[2]["risk_score"] > C.POSITIVE_ABOVE and got[2]["risk_type"] == "threat"
    assert got[3]["risk_score"] == 0 and got[3]["category"] == "none"
    assert got[4]["risk_score"] == 0 and got[4]["risk_type"] == "none"
    assert got[5]["dim_score"] == pytest.approx(0.04) and got[5]["tone_score"] == pytest.approx(0.1)


def test_clean_raw_drops_bad_rows(spark):
    raw = spark.createDataFrame(
        [("20240102030405", "s", "id1", "A,12;B,7", "", "1.5,2,-3,4.5", "d"), ("bad", "s", "id2", "", "", "", ""), ("20240102030405", None, "", None, None, None, None), ("20240102030405", None, "id3", None, None, "x", None)],
        "stamp string, source string, identifier string, themes string, locations string, tone string, dims string",
    )
    got = {r["identifier"]: r for r in scoring.clean_raw(raw).collect()}
    assert set(got) == {"id1", "id3"}
    assert (got["id1"]["themes"], got["id1"]["tone_overall"], got["id1"]["tone_neg"], got["id1"]["tone_polarity"]) == ("A;B", 1.5, 3.0, 4.5)
    assert got["id3"]["tone_neg"] == 0


def test_routes_by_name_country_and_box(spark):
    cases = [
        ("4#Port of Hormuz, south#XX##1#2#0", ["strait_of_hormuz"]),
        ("4#Hormuzville#XX##1#2#0", []),
        ("1#India#IN#IN#20#77#0", []),
        ("4#Leh#in#in30#34#77#0", ["india_china_lac"]),
        ("4#sea#XX##26.5#56#0", ["strait_of_hormuz"]),
        ("4#ØRESUND bridge#XX##x#y#0", ["danish_straits_baltic"]),
        ("bad", []),
        (None, []),
    ]
    rows = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(cases)], "i int, loc string")
    got = column(rows.select("i", text.routes(F.col("loc")).alias("r")), "r", "i")
    assert got == [w for _, w in cases]


def test_text_functions(spark):
    one = spark.range(1)
    pick = lambda c: one.select(c.alias("x")).first()["x"]
    assert pick(text.keywords(F.lit("The NAVY met near the border; locale"))) == ["border", "navy"]
    assert pick(text.countries(F.lit("1#A#in#x;2#B#IN#y;3#C##z;4"))) == ["IN"]
    assert pick(text.article_topic(F.lit(" weird_thing ;missile-test"))) == "MILITARY"
    assert pick(text.article_topic(F.lit("weird_thing"))) == "Weird Thing"
    assert pick(text.article_topic(F.lit(None).cast("string"))) == "General"
    assert pick(text.slug(F.lit("  Red Sea / Suez! "))) == "red_sea_suez"
    assert pick(text.strip_html(F.lit("<p>a &amp; b</p>\n<br>c"))) == "a & b c"
    assert pick(text.meta_content(F.lit("<meta content='/i.png' property='og:image'>"), ["og:image"])) == "/i.png"
    assert pick(text.absolute_url(F.lit("//x/y"), F.lit("https://h/p"))) == "https://x/y"
    assert pick(text.dimension_list(text.words(F.lit("war war peace")))).startswith("c18.1:1.000,c18.2:0.000")
    assert pick(text.place_blocks(F.lit("near the Suez and Malacca"), text.route_gazetteer())).startswith("4#Strait of Malacca")
    assert pick(bands.session_open(F.lit("2024-01-05 04:00:00").cast("timestamp"))) is True
    assert pick(bands.regime(F.lit(2.0))) == "HIGH"


def test_split_era_and_missing_means(spark):
    rows = days(spark, [10.0] * 3 + [0.1] * 5).select("day", F.col("x").alias("raw_ratio"))
    got = timeseries.index_series(rows, "2024-01-01", "2024-01-08", "2024-01-04", [("raw_ratio", "risk_index")]).orderBy("day").collect()
    assert all(r["risk_index"] == pytest.approx(100) for r in got)
    assert [r["ma7"] is None for r in got] == [True] * 3 + [False] * 5


def test_gaps(spark):
    rows = days(spark, [10.0, 20.0, 30.0]).where("day <> '2024-01-02'").withColumnRenamed("x", "v")
    bench = days(spark, [1.0, 3.0, 9.0]).withColumnRenamed("x", "bench")
    fill = lambda m, b=None: column(gaps.fill(rows, "2024-01-01", "2024-01-04", m, ["v"], b), "v")
    assert fill("forward") == [10, 10, 30, 30]
    assert fill("linear") == [10, 20, 30, 30]
    assert fill("benchmark", bench) == [10, 30, 30, 30]
    assert timeseries.islands(timeseries.missing_days(rows, "2024-01-01", "2024-01-04")).count() == 2
    with pytest.raises(ValueError):
        timeseries.calendar(spark, "2024-01-02", "2024-01-01")


def test_as_of_and_band(spark):
    left, right = days(spark, [1.0, 2.0, 3.0]), days(spark, [7.0], "2024-01-02").withColumnRenamed("x", "v")
    assert column(joins.as_of(left, right, "day", ["v"]), "v") == [None, 7.0, 7.0]
    spans = spark.createDataFrame([(1, 1.5, 2.5), (2, -3.0, 1.0)], "k int, lo double, hi double")
    assert sorted((r["x"], r["k"]) for r in joins.band(left, spans, "x", "lo", "hi", 0.7).collect()) == [(1.0, 2), (2.0, 1)]


def test_table_changes(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "B"), (3, "C"), (3, "D")], "k int, v string")
    assert sorted(map(tuple, tables.upsert(old, new.where("v <> 'D'"), ["k"]).collect())) == [(1, "a"), (2, "B"), (3, "C")]
    assert sorted(map(tuple, tables.insert_absent(old, new, ["k"], [F.col("v")]).collect())) == [(1, "a"), (2, "b"), (3, "C")]
    with pytest.raises(ValueError):
        tables.update_columns(old, new.withColumnRenamed("v", "w"), ["k"], ["v"])
    with pytest.raises(Exception):
        tables.gate(old, (F.col("k") < 2, "too large")).collect()


def test_auc_ap_f1(spark):
    rows = spark.createDataFrame([(0.9, 1), (0.8, 0), (0.8, 1), (0.1, 0)], "s double, l int")
    assert stats.auc(rows, "s", "l").first()[0] == pytest.approx(0.875)
    assert stats.average_precision(rows, "s", "l").first()[0] == pytest.approx(0.5 + 0.5 * 2 / 3)
    assert rows.agg(stats.f1(F.col("s") > 0.5, F.col("l")).alias("f")).first()["f"] == pytest.approx(0.8)


def test_route_index_needs_history(spark):
    scored = spark.createDataFrame(
        [(dt.date(2024, 1, d), 0.5, ["strait_of_hormuz"] + (["imec"] if d == 1 else []), "act", "other") for d in range(1, 6)],
        "day date, risk_score double, routes array<string>, risk_type string, category string",
    )
    members = routes.registry(spark)
    panel = routes.panel(scored, members)
    assert panel.count() == 60
    got = routes.normalise(panel, members, "2024-01-01", "2024-01-05")
    by = {r["route"]: r for r in got.where("day = '2024-01-05'").collect()}
    assert by["strait_of_hormuz"]["score_status"] == "ok" and by["strait_of_hormuz"]["threat_index"] == pytest.approx(100)
    assert by["imec"]["score_status"] == "insufficient_history" and by["red_sea_suez"]["threat_index"] == 0


def test_greedy_titles(spark):
    rows = spark.createDataFrame(
        [(1, "Border clash reported", "2024-01-01 00:00:00"), (2, "Border clash reported!", "2024-01-01 01:30:00"), (3, "border clash reported", "2024-01-01 03:00:00"), (4, None, "2024-01-01 03:00:00")],
        "id long, title string, event_time string",
    ).withColumn("event_time", F.to_timestamp("event_time"))
    got = {r["id"]: r["duplicate_of"] for r in similar_titles.resolve(rows).collect()}
    assert got == {1: None, 2: 1, 3: None, 4: None}


def test_walk_forward_is_purged(spark):
    got = signal.walk_forward(days(spark, [1.0] * 20), 3, 10, 5).orderBy("day").collect()
    assert [r["fold"] for r in got] == [None] * 10 + [0] * 5 + [1] * 5
    assert got[10]["train_until"] == 6


def test_readers_and_writers(spark, tmp_path):
    rows = days(spark, [1.0, 2.0])
    path = str(tmp_path / "t")
    writers.by_day(rows, path)
    writers.by_day(rows.where("x = 2").withColumn("x", F.lit(5.0)), path)
    assert column(readers.days(spark, path, "2024-01-01", "2024-01-02"), "x") == [1.0, 5.0]
    plain = str(tmp_path / "p")
    rows.write.parquet(plain)
    writers.replace(spark.read.parquet(plain).where("x = 1"), plain)
    assert spark.read.parquet(plain).count() == 1
    assert readers.first_existing(spark, [str(tmp_path / "no"), plain]) == plain
    slot = tmp_path / "20240101001500.tsv"
    slot.write_text("\t".join(f"v{i}" for i in range(27)) + "\n")
    got = readers.slots(spark, str(slot)).first()
    assert (got["stamp"], got["dims"], got["slot"]) == ("v1", "v17", "0015")
    assert readers.slot_times(48, 1) == ["0015", "1215"]
    assert writers.payload(rows, "day").orderBy("day").first()["payload"] == '{"x":1.0}'
    csv = tmp_path / "s.csv"
    csv.write_text("Date,Close\n2024-01-01,5\nbad,6\n2024-01-02,x\n")
    assert readers.series(spark, str(csv)).count() == 1


def test_feed_rules(spark):
    checks = spark.createDataFrame([("pass",), ("warn",)], "status string")
    assert feed.checks_summary(checks).first()["overall"] == "warn"
    with_gap = spark.createDataFrame([(dt.date(2024, 1, 1), 4, None)], "day date, total_articles int, raw_ratio double").withColumns({c: F.lit(None).cast("double") for c in ("acts_ratio", "threats_ratio", "acts_sum", "threats_sum")}).withColumn("risk_sum", F.lit(2.0))
    assert rollup.ensure_ratios(with_gap).first()["raw_ratio"] == 0.5


def test_vol_experiment_runs_all_blocks_in_whole(spark):
    import inspect

    from riskloom.operators import model

    defaults = {k: v.default for k, v in inspect.signature(model.experiment).parameters.items()}
    assert (defaults["step"], defaults["trees"], defaults["min_train"]) == (21, 300, 750)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(430, 2))
    rows = spark.createDataFrame([(k, float(a), float(b), float(3 * a)) for k, (a, b) in enumerate(x)], "k int, a double, b double, y double")
    rows = rows.withColumn("day", F.date_add(F.lit("2020-01-01").cast("date"), F.col("k")))
    out = model.experiment(rows, {"good": ["a"], "noise": ["b"], "both": ["a", "b"]}, "y", "b", min_train=400, trees=100).toPandas()
    assert out.groupby("block").size().to_dict() == {"good": 30, "noise": 30, "both": 30}
    error = ((out.target - out.predicted) ** 2).groupby(out.block).mean()
    assert error["good"] < 1 < error["noise"] and ((out.probability > 0.5) == (out.high == 1))[out.block == "good"].mean() > 0.9


def test_conditions_on_scores_repeat_no_patterns(spark):
    from riskloom.operators import scoring

    rows = spark.createDataFrame([(i, "TERROR;BORDER_DISPUTE" if i % 2 else "WEATHER", 6.0, 4.0, "c18.3:0.5") for i in range(6)], "id long, themes string, tone_neg double, tone_polarity double, dims string")
    found = scoring.score_articles(rows).where("risk_score > 0 AND risk_score IS NOT NULL").select("id", "risk_score")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 3  # what counts are optimised to
    assert sorted(r["id"] for r in found.collect()) == [1, 3, 5]
