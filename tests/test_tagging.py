"""Places, themes, the tagging cycle, calibration, workbooks, artefacts and the guard, against plain Python."""

import datetime as dt
import io
import os
import re
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.functions import constants as C
from riskloom.functions import lateral, text
from riskloom.operators import tagging, themes
from riskloom.sources import readers, writers, xlsx
from riskloom.streaming import jobs


def located(title, body):
    """Names looked up one by one in the order of their places in the text."""
    both, taken = f"{title or ''} {body or ''}", []
    words = {w: c[:4] for c in C.COUNTRIES for w in c[4]}
    names = {a.lower(): p for p in C.PLACES for a in p[1]}
    for table in (words, names):
        found, at = set(), 0
        while at < len(both):
            here = [w for w in table if re.match(rf"(?<!\w){re.escape(w)}(?!\w)", both[at:], re.I) and (at == 0 or not re.match(r"\w", both[at - 1]))]
            if here:
                best = max(here, key=len)
                found.add(table[best])
                at += len(best)
            else:
                at += 1
        taken.append(found)
    countries = [f"1#{n}#{c}#{c}#{a}#{o}#0" for c, n, a, o in sorted(taken[0])]
    return ";".join(countries + [f"4#{p[0]}#{p[4]}#{p[5]}#{p[2]}#{p[3]}#0" for p in sorted(taken[1])])


TEXTS = [
    ("Talks in Sri Lanka and South Korea", "the Indian Ocean, not Indiana; saudi arabia, SAUDI and u.a.e. uae"),
    (None, "American-made; Wagah Border, Attari Wagah Border, Øresund øresund xÅland"),
    ("Chabahar Port", None),
    (None, None),
    ("india", "chinaé Chinaé  china"),
    ("Strait of Hormuz Strait", "IMEC corridor bab  el-mandeb Bab el-Mandeb"),
]


def test_places_are_leftmost_and_longest(spark):
    df = spark.createDataFrame([(i, *t) for i, t in enumerate(TEXTS)], "i int, title string, body string")
    got = [r["l"] for r in df.select("i", text.located(F.col("title"), F.col("body")).alias("l")).orderBy("i").collect()]
    assert got == [located(*t) for t in TEXTS]
    assert got[2] == "4#Chabahar#IR#IR04#25.2919#60.643#0" and got[3] == ""


def test_themes_of_whole_texts(spark):
    rows = [(0, "coup", "military coup overthrow government takeover power seized junta"), (1, None, " "), (2, None, "x " * 5000 + "ransomware"), (3, None, None)]
    df = spark.createDataFrame(rows, "id int, title string, content string")
    got = {r["id"]: r["s"] for r in df.select("id", themes.similarities(F.col("title"), F.col("content")).alias("s")).collect()}
    encode = themes.hashed_words()
    prototypes = encode(list(C.DESCRIPTIONS.values()))
    for i, title, content in rows:
        want = prototypes @ encode([f"{title or ''} {title or ''} {content or ''}"])[0]
        assert np.allclose(got[i], want)
    assert got[1] == got[3] == [0.0] * 25 and max(got[2]) > 0
    hits = [r["t"] for r in df.orderBy("id").select(themes.reached(themes.similarities(F.col("title"), F.col("content"))).alias("t")).collect()]
    assert hits[0] == ["COUP"] and hits[1] == hits[3] == []


def test_cycle_runs_until_none_is_pending(spark, tmp_path):
    path = str(tmp_path / "tags")
    made = [(i, f"title {i}", "war " * i, dt.datetime(2024, 1, 1 + i), 3 if i == 4 else None) for i in range(9)]
    df = spark.createDataFrame(made, "id long, title string, content string, event_time timestamp, duplicate_of long")
    assert tagging.run(df, path, "v1", limit=3) == 3
    assert sorted(r["id"] for r in tagging.current(spark, path).collect()) == [0, 1, 2]
    assert tagging.run(df, path, "v1", limit=3, until_empty=True) == 5
    assert tagging.run(df, path, "v1", limit=3, until_empty=True) == 0
    assert tagging.pending(df, tagging.written(spark, path), "v1").count() == 0
    assert tagging.run(df, path, "v2") == 8
    now = tagging.current(spark, path).collect()
    assert len(now) == 8 and {r["version"] for r in now} == {"v2"}
    assert {r["id"]: r["tone_neg"] > 0 for r in now} == {i: i > 0 for i in range(9) if i != 4}


def test_sweep_and_pick(spark):
    vectors = [(0, [0.5, 0.1, 0.0]), (1, [0.2, 0.5, 0.3]), (2, [0.1, 0.1, 0.1])]
    df = spark.createDataFrame(vectors, "id long, similarities array<double>")
    codes = ("COUP", "TERROR", "ESPIONAGE")
    rows = {r["threshold"]: r for r in tagging.sweep(df, [0.1, 0.4, 0.9], codes, (0.0, 0.4), (0.0, 0.4)).collect()}
    score = lambda n1, n2, n3: min(0.5, (n1 + 0.6 * n2 + 0.3 * n3) / 3)
    first = [score(1, 1, 0), score(1, 1, 1), score(1, 1, 1)]
    assert rows[0.1]["positive"] == 3 and np.isclose(rows[0.1]["mean"], np.mean(first)) and not rows[0.1]["passed"]
    assert rows[0.4]["positive"] == 2 and np.isclose(rows[0.4]["median"], np.median([1 / 3, 0.2])) and rows[0.4]["passed"] and rows[0.4]["low_coverage"]
    assert rows[0.9]["positive"] == 0 and rows[0.9]["median"] is None and not rows[0.9]["passed"]
    best = tagging.pick(tagging.sweep(df, [0.4, 0.45, 0.9], codes, (0.0, 0.4), (0.0, 0.4))).collect()
    assert [(r["threshold"], r["advisory"]) for r in best] == [(0.4, True)]
    assert tagging.pick(tagging.sweep(df, [0.9], codes)).count() == 0


def test_table_function_equals_the_column_form(spark):
    listed = ["1#India#in#IN#20.0#77.0#0;bad#entry;4#x#XX##bad#3#0", "", None, "4#a#b#c#1e1#-2.5"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(listed)], "id int, locations string")
    lateral.register(spark)
    got = spark.sql("SELECT a.id, m.* FROM {df} a, LATERAL parse_locations(a.locations) m", df=df)
    want = df.select("id", F.posexplode(text.mentions(F.col("locations"))).alias("position", "m")).select("id", "position", "m.*")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str) and got.count() == 3


SHEET = '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{}</sheetData></worksheet>'


def test_workbook_cells(spark, tmp_path):
    """Shared and rich strings, gaps, dates with times, booleans, errors, a second sheet, blank rows."""
    book = tmp_path / "b.xlsx"
    with zipfile.ZipFile(book, "w") as z:
        for name, part in writers.BOOK.items():
            z.writestr(name, part)
        z.writestr("xl/workbook.xml", writers.BOOK["xl/workbook.xml"].replace("</sheets>", '<sheet name="two" sheetId="2" r:id="rId2"/></sheets>'))
        z.writestr("xl/_rels/workbook.xml.rels", writers.BOOK["xl/_rels/workbook.xml.rels"].replace("</Rel", '<Relationship Id="rId2" Type="x" Target="/xl/worksheets/two.xml"/></Rel'))
        z.writestr("xl/sharedStrings.xml", '<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><si><t>name</t></si><si><r><t>ri</t></r><r><t>ch</t></r></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", SHEET.format('<row><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>at</t></is></c><c r="C1" t="inlineStr"><is><t>ok</t></is></c></row><row><c r="A2" t="s"><v>1</v></c><c r="B2" s="1"><v>45292.5</v></c><c r="C2" t="b"><v>1</v></c></row><row/><row><c r="C4" t="e"><v>#N/A</v></c></row><row><c r="B5"><v>2.50</v></c></row>'))
        z.writestr("xl/worksheets/two.xml", SHEET.format('<row><c t="str"><v>k</v></c></row><row><c><v>7</v></c></row>'))
    uri = f"file://{tmp_path}"
    got = [tuple(r) for r in xlsx.sheet(spark, f"{uri}/b.xlsx").collect()]
    assert got == [("rich", "2024-01-01 12:00:00", "true"), (None, "2.50", None)]
    assert [tuple(r) for r in xlsx.sheet(spark, uri, "two").collect()] == [("7",)]
    assert xlsx.column_number("AB12") == 27
    with pytest.raises(Exception, match="no sheet three"):
        xlsx.sheet(spark, uri, "three").count()


def test_freshness_is_that_of_the_files(spark, tmp_path):
    for k, at in (("a", 1_700_000_000), ("b", 1_700_000_500)):
        (tmp_path / "x" / k).mkdir(parents=True)
        (tmp_path / "x" / k / "f").write_text("z")
        os.utime(tmp_path / "x" / k / "f", (at, at))
    got = {r["artefact"]: (r["files"], r["s"]) for r in readers.freshness(spark, {"x": f"file://{tmp_path}/x", "none": f"file://{tmp_path}/no"}).select("artefact", "files", F.unix_seconds("as_of").alias("s")).collect()}
    assert got == {"x": (2, 1_700_000_500), "none": (0, None)}


def test_a_batch_without_progress_stops_the_stream(spark, tmp_path):
    source, seen = str(tmp_path / "in"), []
    for k in range(4):
        spark.range(k, k + 1).coalesce(1).write.mode("append").parquet(source)
    stream = lambda: spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(source)

    def sink(batch, number):
        seen.append(number)
        return 0 if number == 1 else batch.count()

    assert jobs.run_guarded(stream(), sink, str(tmp_path / "c")) is False
    assert 1 in seen and len(seen) < 4
    assert jobs.run_guarded(stream(), lambda b, n: b.count(), str(tmp_path / "c")) is True


def test_a_first_cycle_shuffles_no_article(spark, tmp_path):
    df = spark.range(100).selectExpr("id", "'t' AS title", "'c' AS content", "timestamp_seconds(id) AS event_time")
    todo = tagging.pending(df, tagging.written(spark, str(tmp_path / "none")), "v1")
    assert "Exchange" not in todo._jdf.queryExecution().executedPlan().toString() and todo.count() == 100


def test_few_vectors_are_held_at_once(spark):
    """A batch of texts is encoded in parts, with the figures that it has as a whole."""

    def counted():
        encode = themes.hashed_words()

        def parts(texts):
            if len(texts) > 64:
                raise ValueError(f"{len(texts)} vectors at once")
            return encode(texts)

        return parts

    texts = [None if i % 50 == 7 else "" if i % 50 == 8 else f"Été war_{i % 9} coup Kİ junta {i}" * (i % 5) for i in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, content string").coalesce(1)
    got = [r["s"] for r in df.orderBy("id").select(themes.similarities(F.lit(None), F.col("content"), counted).alias("s")).collect()]
    want = themes.hashed_words()([f"  {t or ''}" for t in texts]) @ themes.hashed_words()(list(C.DESCRIPTIONS.values())).T
    assert np.allclose(got, want) and themes.hashed_words()([""]).tolist() == [[0.0] * themes.DIMENSIONS]
    assert all(themes._words(t) == re.findall(r"\w+", t.lower()) for t in ("a_b-c9\x1cd'e\x00f\n", "É a_b-c", "", "K x"))


def test_names_by_shared_beginnings(spark):
    """Names spelt out as a tree are those of the plain alternation, in odd letter cases and at odd bounds."""
    names = [w for c in C.COUNTRIES for w in c[4]] + [a.lower() for p in C.PLACES for a in p[1]]
    texts = ["South Korea south korean SOUTH KOREA, sıngapore İran Kenya ſuez Øresundøresund xøresund", "sri lankan_sri lanka sri lankans 9india india9 india's o'india", "saudi arabian saudi  arabia saudi\narabia", "raxaul-birgunj-raxaul bab el-mandeb́ chiná china\U0001f600oman", "", "chinachina iraniran iran‍iraq"]
    longest = sorted(names, key=lambda n: (-len(n), n))
    plain = "|".join(re.escape(n).replace(r"\ ", " ") for n in longest)
    df = spark.createDataFrame([(t + " " + n.upper() + "'" + n + "," + n.title(),) for t in texts for n in names], "t string")
    for left, right in ((r"\b", r"\b"), (r"(?<!\w)", r"(?!\w)")):
        found = [F.regexp_extract_all("t", F.lit(f"(?iU){p}{right}"), F.lit(1)) for p in (f"{left}({plain})", f"{text._beginnings(names)}{left}({text._spellings(names)})")]
        assert df.where(~(found[0] == found[1])).count() == 0 and df.where(F.size(found[0]) > 0).count() == df.count()
    assert text._spellings(["oman", "saudi", "saudi arabia"]).count("s") == 1


def test_lexicon_words_are_told_in_one_pass(spark):
    df = spark.createDataFrame([("War war's WAR a'b'war peace, Killed İwar killed",), ("",), (None,), ("it's 9",)], "t string")
    lexicons = (C.NEGATIVE_WORDS, C.POSITIVE_WORDS, *C.DIM_LEXICONS.values())
    rows = df.select(text.words(F.col("t")).alias("w"), text.tallied(F.col("t"), *lexicons).alias("s"))
    found, n = F.col("s.found"), F.col("s.n")
    for one, other in [(text.density(F.col("w"), x), text.density(found, x, n)) for x in lexicons] + [(text.dimension_list(F.col("w")), text.dimension_list(found, total=n))]:
        assert rows.where(~(one == other)).count() == 0
    assert [tuple(r) for r in rows.select(n, found).collect()] == [(9, ["war", "war", "war", "peace", "war"]), (0, []), (0, []), (1, [])]
