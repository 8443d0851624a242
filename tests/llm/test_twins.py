"""Plain versions of the operators' cores, very long texts, and the pipeline on odd rows."""

import base64
import functools
import math
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from riskloom.llm import byte_bpe, common, decontaminate, html_extract, imatch, langid, records, secret_scan, simhash, toxicity

SF = "/root/testdata/sf0.001"


# --- secrets: every segmentation, one by one


def plain_cost(value):
    """The least cost over all segmentations, found by trying them all."""
    by_start = {}
    for i, j, cost in secret_scan.matches(value):
        by_start.setdefault(i, []).append((j, cost))
    unit = math.log10(max(10, 26 * any(c.islower() for c in value) + 26 * any(c.isupper() for c in value) + 10 * any(c.isdigit() for c in value) + 33 * any(not c.isalnum() for c in value)))
    n = len(value)

    @functools.cache
    def least(at, parts, brute):
        """(cost without the order) by number of parts from ``at`` on; ``brute``: the part before is a brute-force stretch."""
        if at == n:
            return {0: 0.0}
        found = {}

        def offer(rest, cost):
            for k, c in rest.items():
                if c + cost < found.get(k + 1, math.inf):
                    found[k + 1] = c + cost

        for j, cost in by_start.get(at, ()):
            offer(least(j, parts, False), cost)
        if not brute:
            for j in range(at + 1, n + 1):
                offer(least(j, parts, True), unit * (j - at))
        return found

    return min(c + math.log10(math.factorial(k)) for k, c in least(0, 0, False).items())


@pytest.mark.parametrize("seed", range(6))
def test_guess_cost_equals_all_segmentations(seed):
    rng = random.Random(seed)
    pieces = ["password", "2019", "0412", "qwerty", "aaaa", "abcd", "xK", "9$", "Summer", "l0ve", "zz", "monkey12"]
    for _ in range(25):
        value = "".join(rng.choice(pieces) for _ in range(rng.randint(1, 3)))[:16]
        assert secret_scan.log_guesses(value, 99) == pytest.approx(plain_cost(value))
        assert (secret_scan.log_guesses(value) >= secret_scan.LOG_GUESSES) == (plain_cost(value) >= secret_scan.LOG_GUESSES)


def plain_base(text):
    """The base spans by the contract's words alone."""
    found = []
    for m in re.finditer(r"""(?ai:password|passwd|secret|token|api_?key)["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[1]) >= 12:
            found.append((m.start(), 0, m.end()))
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(found)


def test_base_spans_of_random_texts():
    rng = random.Random(5)
    pool = ["password", "TOKEN", "api_key", "apikey", "ſecret", "secret", ":", "=", " ", '"', "'", "AKIA", "ABCDEFGHIJKLMNOP", "0123456789abcdef", "deadbeef", "x", "\n", "-", "é"]
    for _ in range(800):
        text = "".join(rng.choice(pool) for _ in range(rng.randint(0, 14)))
        assert [(s, k, e) for s, k, e, _ in secret_scan.base_spans(text)] == plain_base(text), text


# --- HTML: occurrence vectors written out


def plain_template(pages):
    """The nested valid tokens of one host's pages, from whole occurrence vectors."""
    vectors = {}
    for i, (_, source) in enumerate(pages):
        for (token, holder), n in html_extract.page_tokens(source).items():
            vectors.setdefault((token, holder), [0] * len(pages))[i] = n
    frequent = {k: tuple(v) for k, v in vectors.items() if sum(x > 0 for x in v) >= max(2, len(pages) * html_extract.SUPPORT)}
    sizes = Counter(frequent.values())
    vector, holder = {t: v for (t, _), v in frequent.items()}, {t: h for t, h in frequent}
    valid = {t for t in vector if sizes[vector[t]] >= html_extract.LARGE}

    def is_nested(t):
        h, direct = holder[t], True
        while h and h not in valid:
            h, direct = holder[h], False
        return h == 0 and direct or h in valid and (direct or vector[h] == vector[t]) and is_nested(h)

    return {t for t in valid if is_nested(t)}


def test_templates_equal_whole_vectors(spark):
    rng = random.Random(9)
    words = lambda n: " ".join(rng.choice("alpha beta gamma delta epsilon zeta".split()) for _ in range(n))
    pages = []
    for i in range(7):
        items = "".join(f"<li>Link {k}</li>" for k in range(4))
        notice = "<div class=note><p>Join us today</p></div>" if i % 2 else ""
        pages.append((i, f"<body><div><ul>{items}</ul></div>{notice}<article><h1>{words(3)} {i}</h1><p>Sponsored by us</p><p>{words(30)} {i}</p></article><p>Bye</p></body>"))
    frame = spark.createDataFrame([(i, "h", h) for i, h in pages], "page_id long, host string, html string")
    (row,) = html_extract.templates(frame).collect()
    assert set(row["template"]) == plain_template(pages)
    with_template = [html_extract.main_text(h, set(row["template"]), set(row["others"])) for _, h in pages]
    without = [html_extract.main_text(h, set()) for _, h in pages]
    assert all(a != b and "Sponsored by us" not in a and "Sponsored by us" in b for a, b in zip(with_template, without))


def test_copies_of_a_page_keep_their_text(spark):
    """A text on two pages of three is no template: the article around it is on all of them."""
    body = "<body><article><h1>{t}</h1>{p}</article><p>Bye</p></body>"
    same = "".join(f"<p>Paragraph {k} of the story</p>" for k in range(6))
    pages = spark.createDataFrame([(0, "https://h/a", body.format(t="One", p=same)), (1, "https://h/b", body.format(t="One", p=same)), (2, "https://h/c", body.format(t="Two", p="<p>Other words</p>"))], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_extract.extract(pages).collect()}
    assert got[0] == got[1] and got[0].count("Paragraph") == 6 and got[2] == "Two\n\nOther words"


def test_body_under_odd_class_names(spark):
    body = '<body><div class="share-price related-work"><p>Body {n} of the story</p></div><div class="comment-{n}"><p>Own words {n}</p></div><p>End</p></body>'
    pages = spark.createDataFrame([(i, "https://h/x", body.format(n=i)) for i in range(6)] + [(9, "https://h/x", "<p>" + "w " * 300_000 + "</p>")], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in html_extract.extract(pages).collect()}
    assert "Own words 3" in got[3]["text"] and got[9]["n_chars"] == 599_999


# --- linear models: one gram after the other


def plain_grams(word, orders, buckets, whole):
    w = f"<{word}>"
    m, mul, mix = (1 << 64) - 1, 0x100000001B3, 0x9E3779B97F4A7C15
    found = []
    for n in range(1, max(orders) + 1):
        for i in range(len(w) - n + 1):
            h = 0
            for c in w[i : i + n]:
                h = (h * mul + ord(c)) & m
            if n in orders:
                found.append((((h + n) * mix & m) >> 40) % buckets)
    if whole:
        total = 0
        for place, c in enumerate(w):
            x = ord(c) * ((place + 1) * mix & m) & m
            total += (x ^ x >> 31) * mul
        found.append((((total & m) * mix & m) >> 40) % buckets)
    return found


def test_toxicity_scores_equal_plain_bags():
    rng = np.random.default_rng(3)
    model = toxicity.Model(rng.normal(0, 1, toxicity.BUCKETS).astype(np.float32), -0.5)
    texts = ["one", "One two. THREE!", "a b c d e f g", "", " \n", "é-x ü y z"]
    got = toxicity.Scorer(model).scores(texts)
    half = toxicity.BAG // 2
    for text, score in zip(texts, got):
        means = []
        for w in text.lower().split():
            g = plain_grams(toxicity.clean(w), toxicity.ORDERS, toxicity.BUCKETS, True)
            means.append(np.mean([model.gram[b] for b in g]))
        bags = [np.mean(means[max(0, i - half) : i + half + 1]) for i in range(len(means))]
        z = max(bags) + model.bias if bags else min(model.bias, model.bias)
        assert score == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-4)


def test_language_equals_plain_decoding():
    rng = np.random.default_rng(4)
    code = langid.codewords(4)
    bits = code.shape[1]
    model = langid.Model(["a", "b", "c", "d"], code, rng.normal(0, 1, (langid.BUCKETS, bits)).astype(np.float32), rng.normal(0, 0.1, bits).astype(np.float32), rng.uniform(0.2, 1, bits))
    texts = ["Hello wörld 12", "x", "la casa es de, Papel!", "123", None]
    langs, score, _ = langid.Predictor(model).predict(texts)
    for text, lang, s in zip(texts, langs, score):
        grams = [b for w in (text or "").lower().split() if (x := langid.letters(w)) for b in plain_grams(x, langid.ORDERS, langid.BUCKETS, False)]
        if not grams:
            assert (lang, s) == ("und", 0.0)
            continue
        f = sum(model.weight[b].astype(float) for b in grams) / len(grams) * 10 + model.bias
        loss = [sum(t * math.log1p(math.exp(-c * x)) for c, x, t in zip(row, f, model.trust)) for row in code]
        p = np.exp(-np.array(loss))
        assert lang == model.langs[int(np.argmin(loss))] and s == pytest.approx(p.max() / p.sum(), abs=1e-3)


# --- very long texts, whole


def test_very_long_texts():
    rng = random.Random(2)
    vocabulary = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9))) for _ in range(4000)]
    text = " ".join(rng.choices(vocabulary, k=150_000)) + " password = aB3dE6gH9jK2mN5p"
    start = text.index("password")
    assert secret_scan.joined(secret_scan.base_spans(text)) == f"assign:{start}:{len(text)}"
    enc = byte_bpe.ByteBpe(byte_bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken")), P.PATTERN)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    assert enc.encode(text) == tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary(text)
    model = toxicity.fit(["bad words"] * 10 + ["good words"] * 30, [1] * 10 + [0] * 30)
    assert toxicity.Scorer(model).scores([text + " bad bad bad"])[0] > toxicity.Scorer(model).scores([text])[0] - 1e-9
    two = langid.fit(["the cat sat on the mat"] * 20 + ["le chat est sur la table"] * 20, ["en"] * 20 + ["fr"] * 20)
    parts = langid.Predictor(two).totals([text])[0]
    words = Counter(text.lower().split())
    assert parts[-1] == pytest.approx(sum(n * len(plain_grams(langid.letters(w), langid.ORDERS, langid.BUCKETS, False)) for w, n in words.items() if langid.letters(w)))
    terms = imatch.Hasher().terms(text)
    assert len(terms) == len(set(text.lower().split()))
    ids = records.ChunkEncoder(common.read_bytes(P.path("word_bpe_49k.json"))).encode(text)
    from tokenizers import Tokenizer

    assert np.frombuffer(ids, "<u2").tolist() == Tokenizer.from_file(P.path("word_bpe_49k.json")).encode(text, add_special_tokens=False).ids


# --- pipeline


def test_pipeline_of_odd_rows(spark, tmp_path):
    """Null and repeated ids, null and empty texts, ties, a very long text, and columns whose names clash."""
    import corpus_pipeline

    real = spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"], "clash", 1) for r in real]
    long = " ".join(real[0]["text"].split() * 200)[:400_000]
    rows += [(None, real[1]["text"] + " tail words here", "en", "s", 9, "c", 2), (real[2]["doc_id"], "another text of the same id stands here alone", "en", "s", 9, "c", 2)]
    rows += [(900_001, None, None, None, None, None, None), (900_002, "", "en", "s", 0, "", 0), (900_003, "12 34 !", "en", "s", 7, "", 0), (900_004, long, "en", "s", len(long), "", 0), rows[5], rows[5]]
    schema = "doc_id long, text string, lang string, source string, n_chars long, lang_pred string, fp int"
    folder = str(tmp_path)
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, "an item that stands in no document at all, surely, as it says")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.count()
        docs = stage(spark, docs, folder)
        assert docs.columns == schema.replace(" long", "").replace(" string", "").replace(" int", "").split(", "), name
        docs = common.cut(docs)
        assert docs.count() <= before
        if name == "language_id":
            left = {r["doc_id"] for r in docs.collect()}
            assert not {900_001, 900_002, 900_003} & left and 900_004 in left
    got = corpus_pipeline.run(spark, folder).collect()
    assert len(got) == docs.count() and all(r["n_tokens"] > 0 for r in got)
    empty = str(tmp_path / "empty")
    spark.createDataFrame([], schema).write.parquet(f"{empty}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{empty}/benchmark.parquet")
    assert corpus_pipeline.run(spark, empty).count() == 0


def test_stages_keep_near_copies_once_and_drop_leaks(spark):
    prose = random.Random(31)
    words = lambda n: " ".join("".join(prose.choices("abcdefghijklmnop", k=5)) for _ in range(n))
    base, item = words(400), words(15)
    docs = spark.createDataFrame([(5, base), (3, base), (8, base + " x"), (9, words(50)), (10, words(20) + " " + item + " " + words(20))], "doc_id long, text string")
    kept = {r["doc_id"] for r in simhash.keep_one(docs).collect()}
    assert 3 in kept and 5 not in kept and {9, 10} <= kept
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert {r["doc_id"] for r in decontaminate.keep_uncontaminated(docs, bench).collect()} == {5, 3, 8, 9}
