"""Leaks in scripts without spaces, glued, underscored and with edits in clusters; repeated and deeply nested pages; whole URLs as secrets."""

import random
import time

from riskloom.llm import decontaminate, html_extract, secret_scan


def prose(rng, n, letters="abcdefghijklmnopqrstuvwxyz"):
    return " ".join("".join(rng.choices(letters, k=rng.randint(2, 9))) for _ in range(n))


def found(items, texts):
    return {(row, i) for row, i, *_ in decontaminate.leaks(decontaminate.Items(list(enumerate(items))), texts)}


def test_verbatim_leaks_without_spaces():
    rng = random.Random(21)
    han, kana, thai = ([chr(a + k) for k in range(n)] for a, n in ((0x4E00, 3000), (0x3042, 80), (0x0E01, 45)))
    for script in (han, kana, thai):
        text = lambda n: "".join(rng.choices(script, k=n))  # noqa: E731, B023
        items = [text(rng.randint(16, 90)) for _ in range(60)]
        texts = [text(400) + item + text(400) for item in items]
        got = found(items, texts)
        assert all((k, k) in got for k in range(60)) and len(got) == 60


def test_edited_leaks_without_spaces():
    rng = random.Random(22)
    han = [chr(0x4E00 + k) for k in range(3000)]
    items = ["".join(rng.choices(han, k=rng.randint(40, 120))) for _ in range(60)]
    texts = []
    for item in items:
        chars = list(item)
        for _ in range(len(item) // 7):
            k = rng.randrange(len(chars))
            chars[k : k + rng.randint(0, 1)] = rng.choice([[], [rng.choice(han)]])
        texts.append("。" + "".join(rng.choices(han, k=300)) + "".join(chars) + "".join(rng.choices(han, k=300)))
    got = found(items, texts)
    assert sum((k, k) in got for k in range(60)) >= 57


def test_glued_and_underscored_leaks():
    rng = random.Random(23)
    items = [prose(rng, rng.randint(14, 40)) for _ in range(100)]
    near = [k for k, t in enumerate(items) if t.count(" ") <= decontaminate.most_edits(len(t))]
    assert len(near) > 60
    for way in ("_", "-", ""):
        got = found(items, [f"{prose(rng, 30)} {item.replace(' ', way)} {prose(rng, 30)}" for item in items])
        assert sum((k, k) in got for k in near) >= 0.9 * len(near), way


def test_edits_in_clusters():
    rng = random.Random(24)
    items = [prose(rng, rng.randint(10, 60)) for _ in range(100)]
    texts = []
    for item in items:
        n = decontaminate.most_edits(len(item))
        at = rng.randrange(len(item) - n)
        texts.append(f"{prose(rng, 20)} {item[:at]}{''.join(rng.choices('xyzqv ', k=n))}{item[at + n:]} {prose(rng, 20)}")
    got = found(items, texts)
    assert sum((k, k) in got for k in range(100)) >= 95


def test_items_without_anchors_are_searched():
    items = ["- " * 40 + "!", "?? !! " * 20]
    assert found(items, [f"a {items[0]} b", f"x{items[1]}y", "nothing here"]) == {(0, 0), (1, 1)}


PAGE = "<body><div class=menu><ul><li>Home</li><li>News</li></ul></div><div class=text><p>alpha one {n}</p><p>beta two {n}</p><p>{extra}</p></div><div><p>Bye now</p></div></body>"


def test_pages_listed_twice_change_nothing(spark):
    rows = [(i, "https://h/x", PAGE.format(n=i, extra="x" * (i + 1))) for i in range(6)]
    schema = "page_id long, url string, html string"
    once = {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(rows, schema)).collect()}
    assert once[2] == "alpha one 2\n\nbeta two 2\n\nxxx"
    for times in (2, 3):
        got = html_extract.extract(spark.createDataFrame(rows * times, schema).repartition(5)).collect()
        assert len(got) == 6 * times and {r["page_id"]: r["text"] for r in got} == once and all(r["text"] == once[r["page_id"]] for r in got)
    without = html_extract.extract(spark.createDataFrame([(None, u, h) for _, u, h in rows], schema)).collect()
    assert sorted(r["text"] for r in without) == sorted(once.values()) and {r["page_id"] for r in without} == {None}
    # Two pages of a host are two pages, however often they are listed: too few for a template.
    two = html_extract.extract(spark.createDataFrame(rows[:2] * 2, schema)).collect()
    assert {r["text"] for r in two} == {r["text"] for r in html_extract.extract(spark.createDataFrame(rows[:2], schema)).collect()}


def test_deep_pages_take_time_in_proportion():
    page = "<div class=ad-box>x" * 100_000 + "</span></section>" * 20_000
    began = time.perf_counter()
    opened, blocks = html_extract.parse(page)
    assert len(opened) == len(blocks) == 100_000
    assert html_extract.main_text(page, {1}) and html_extract.main_text(page, set()) == ""
    assert time.perf_counter() - began < 30


def test_a_template_decides_where_names_do_not(spark):
    """No element name, role or label tells the menu and the closing line from the text."""
    page = "<body><div><p>Weather</p><p>Sport</p></div><div><p>Story {n} of many words</p><p>goes on {n}</p></div><div><p>Made in town</p></div></body>"
    pages = spark.createDataFrame([(i, "https://h/x", page.format(n=i)) for i in range(5)], "page_id long, url string, html string")
    assert {r["text"] for r in html_extract.extract(pages).collect()} == {f"Story {i} of many words\n\ngoes on {i}" for i in range(5)}


def test_urls_as_secrets():
    spans = lambda t: [t[s:e] for s, _, e, _ in secret_scan.guessed_spans(t, secret_scan.base_spans(t))]
    assert spans("pwd: https://x.y/Zk39dkQpLm2") == ["https://x.y/Zk39dkQpLm2"]
    assert spans("password is ${DB_PASSWORD} pwd: %DB_PASS%") == []
