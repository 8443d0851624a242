"""Band joins over intervals of any width, verbatim items, character references, and the parity of routes."""

import html
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from riskloom.functions import constants as C
from riskloom.functions import text
from riskloom.operators import joins
from riskloom.plans import articles, registry

SF = "/root/testdata/sf0.001"


def test_band_equals_brute_force_for_narrow_wide_and_endless_intervals(spark):
    rng = random.Random(2)
    values = [(i, rng.uniform(-1e6, 1e6)) for i in range(200)] + [(200, None), (201, float("nan")), (202, 0.0), (203, 0.0), (204, 1e6)]
    spans = []
    for i in range(150):
        low = rng.uniform(-1e6, 1e6)
        spans.append((i, low, low + 10 ** rng.uniform(-3, 6.5)))
    spans += [(150, 5.0, 4.0), (151, None, 1.0), (152, float("-inf"), 0.0), (153, 0.0, float("inf")), (154, float("nan"), float("nan")), (155, 0.0, 0.0), (156, 1e6, 1e6), (156, 1e6, 1e6)]
    got = joins.band(spark.createDataFrame(values, "x long, at double"), spark.createDataFrame(spans, "k long, lo double, hi double"), "at", "lo", "hi", 0.5)
    wanted = [(x, k) for x, v in values if v is not None and not math.isnan(v) for k, lo, hi in spans if lo is not None and lo <= v <= hi]
    assert sorted((r["x"], r["k"]) for r in got.collect()) == sorted(wanted)
    assert got.columns == ["x", "at", "k", "lo", "hi"]


def test_a_wide_interval_takes_few_cells(spark):
    one = spark.createDataFrame([(1, 0.0, 1e15)], "k long, lo double, hi double")
    assert joins.band(spark.createDataFrame([(7.0,), (-1.0,)], "at double"), one, "at", "lo", "hi", 1e-3).count() == 1
    assert joins.band(spark.createDataFrame([(7.0,)], "at double"), one.limit(0), "at", "lo", "hi", 1.0).count() == 0


def test_containing_equals_brute_force(spark):
    bodies = ["the quick brown fox jumps", "brown fox", "", None, "a quick brown\nfox", "fox fox fox fox", "unquick"]
    items = ["quick brown fox", "fox", "un", "brown fox jumps over", "fox fox fox", "", "fox", "quick brown fox"]
    texts = spark.createDataFrame(list(enumerate(bodies)), "d long, body string")
    asked = spark.createDataFrame(list(enumerate(items)), "i long, item string")
    wanted = sorted((d, i) for d, b in enumerate(bodies) if b for i, t in enumerate(items) if t and t in b)
    for block in (4 << 20, 150):
        assert sorted((r["d"], r["i"]) for r in joins.containing(texts, asked, "body", "item", block).collect()) == wanted
    assert joins.containing(texts, asked.limit(0), "body", "item").count() == 0


def test_character_references_equal_the_standard_library(spark):
    cases = [
        "a &lt; b &amp;amp; c", "&#8377;500 &#x20B9;500 &#X20b9;", "&eacute;&Eacute;&mdash;&hellip;&rsquo;", "&#150;&#x92;&#129;", "&unknownname; &; & &&amp;", "&#0; &#xD800; &#1114112;", "&#39;&apos;&quot;",
        "&#8217s &#x41 tail", "&&lt;&gt;&", "no reference", "", "&#128512; &lt;b&gt;", "&thetasym;&frac12;&AMP", "&#99999999999;",
    ]
    rows = spark.createDataFrame(list(enumerate(cases)), "i long, t string")
    got = {r["i"]: r["u"] for r in rows.select("i", text.unescape(F.col("t")).alias("u")).collect()}
    for i, case in enumerate(cases):
        if "&AMP" in case or "&#99999999999" in case:  # a name without its semicolon stays; so many digits are no reference of ours
            continue
        assert got[i] == html.unescape(case), case
    assert spark.range(1).select(text.strip_html(F.lit("<p>Caf&eacute;&nbsp; &#8211;\n x</p>")).alias("p")).first()["p"] == "Café – x"
    assert spark.range(1).select(text.unescape(F.lit(None).cast("string")).alias("p")).first()["p"] is None


def _routes(locations):
    """Route ids of a location list by the registry's rules, in plain Python."""
    out = set()
    for entry in (locations or "").split(";"):
        f = entry.split("#")
        if len(f) < 6:
            continue
        name, country, adm1 = f[1].lower(), f[2].upper(), f[3].upper()
        try:
            at = float(f[4]), float(f[5])
        except ValueError:
            at = None
        for route, spec in C.ROUTES.items():
            names = [a for p in C.PLACES if p[6] == route for a in p[1]]
            s = spec["bounds"]
            if country in spec["countries"] and (not spec["adm1"] or adm1 in spec["adm1"]) or any(re.search(rf"(^|[^a-z0-9_]){a}($|[^a-z0-9_])", name, re.I) for a in names) or s and at and s[0] <= at[0] <= s[1] and s[2] <= at[1] <= s[3]:
                out.add(route)
    return out


def test_parity_of_routes_equals_plain_python(spark):
    """Given routes by the rules above; found ones by the same rules over the places that the names' text has."""
    rows = articles.articles(spark, SF).groupBy("locations").count().collect()
    total, given, found = sum(r["count"] for r in rows), {}, {}
    for r in rows:
        names = (e.split("#")[1].strip() for e in (r["locations"] or "").split(";") if "#" in e)
        line = " ".join(dict.fromkeys(n for n in names if n))
        again = ";".join(f"4#{p[0]}#{p[4]}#{p[5]}#{p[2]}#{p[3]}#0" for p in C.PLACES if any(re.search(rf"\b{a}\b", line, re.I) for a in p[1]))
        for counts, places in ((given, r["locations"]), (found, again)):
            for route in _routes(places):
                counts[route] = counts.get(route, 0) + r["count"]
    assert given and found
    got = registry.QUERIES["parity_smoke"](spark, SF).collect()
    assert {r["route"] for r in got} == set(C.ROUTES)
    for r in got:
        g, f = given.get(r["route"], 0), found.get(r["route"], 0)
        assert (r["given"], r["found"], r["silent_drop"]) == (g, f, g > 0 and f == 0), r["route"]
        assert r["difference"] == pytest.approx((f - g) / total, abs=1e-6)
