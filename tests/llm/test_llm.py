"""Operators against brute force, exact round trips and held-out accuracy, on small fixtures."""

import base64
import hashlib
import random
import zlib

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from riskloom.llm import byte_bpe, chat_format, common, decontaminate, html_extract, imatch, langid, records, secret_scan, simhash, subwords, toxicity
from riskloom.llm.graph import components

SF = "/root/testdata/sf0.001"
RANKS = P.path("byte_bpe_multi_50k.tiktoken")
EDGE = [None, "", " ", "a", "The the THE", "x" * 3000, "word " * 2000, "  lead\n\n tail  ", "é ß 中文 🙂 y", "12 345,67!? don't I'LL", "\t\x0b\x1c end"]


def frame(spark, texts, ids=None):
    """Rows with a null id, repeated rows, and extra columns whose names clash with results."""
    rows = [(i, t, "en", "s", "clash", 7) for i, t in zip(ids or range(len(texts)), texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, fingerprint string, score int")


@pytest.fixture(scope="module")
def edge(spark):
    return frame(spark, [*EDGE, "a", "a"], [*range(len(EDGE)), 3, None])


@pytest.fixture(scope="module")
def corpus():
    return duckdb.sql(f"SELECT doc_id, text, lang FROM '{SF}/documents.parquet' ORDER BY doc_id").fetchall()


def tik():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def empty(spark):
    return frame(spark, ["x"]).where("false")


# --- byte-level BPE


def test_bpe_equals_library_and_decodes(spark, edge):
    enc = tik()
    got = sorted(map(tuple, byte_bpe.digests(edge, RANKS, P.PATTERN).collect()), key=str)
    want = []
    for r in edge.collect():
        ids = enc.encode_ordinary(r["text"] or "")
        want.append((r["doc_id"], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    back = byte_bpe.decode_ids(byte_bpe.encode_ids(edge, RANKS, P.PATTERN), RANKS, P.PATTERN)
    assert sorted(bytes(r["raw"]) for r in back.collect()) == sorted((r["text"] or "").encode() for r in edge.collect())
    assert byte_bpe.digests(empty(spark), RANKS, P.PATTERN).count() == 0


def test_bpe_fuzz():
    enc, own = tik(), byte_bpe.ByteBpe(byte_bpe.read_ranks(RANKS), P.PATTERN)
    rng = random.Random(4)
    pool = list("abcdeéß中🙂 \n\t  ,.'19") + ["the", " of", "  ", " ", "\x1c", "'ll"]
    for _ in range(1500):
        t = "".join(rng.choice(pool) for _ in range(rng.randint(0, 25)))
        assert own.encode(t) == enc.encode_ordinary(t), t


def test_perfect_hash_is_minimal():
    keys = [str(i).encode() for i in range(3000)]
    h = byte_bpe.MinimalPerfectHash(keys, list(range(3000)))
    assert [h.get(k) for k in keys] == list(range(3000)) and h.n == 3000
    assert h.get(b"absent") == -1 and h.get(b"") == -1


# --- SimHash


def brute_fingerprint(text):
    w = (text or "").encode().lower().split()
    s = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h)) if h else 0


def brute_groups(fps):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


def test_simhash_equals_brute_force(spark, edge, corpus):
    docs = edge.select("doc_id", "text").union(spark.createDataFrame([(d + 100, t) for d, t, _ in corpus], "doc_id long, text string"))
    rows = docs.collect()
    fps = [brute_fingerprint(r["text"]) for r in rows]
    roots = brute_groups(fps)
    least = {}
    for r, root in zip(rows, roots):
        if r["doc_id"] is not None:
            least[root] = min(least.get(root, 1 << 60), r["doc_id"])
    want = sorted(((r["doc_id"], f"{f:016x}", least.get(root)) for r, f, root in zip(rows, fps, roots)), key=str)
    assert sorted(map(tuple, simhash.near_duplicates(docs).collect()), key=str) == want
    assert simhash.near_duplicates(empty(spark)).count() == 0


@pytest.mark.parametrize("crowd", [0, 3, 1000])
def test_links_keep_every_connection(spark, crowd):
    rng = random.Random(crowd)
    fps = {rng.getrandbits(64) for _ in range(60)}
    for f in list(fps)[:40]:
        for _ in range(4):
            fps.add(f ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
            fps.add(f ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    fps = sorted(fps)
    found = components(simhash.links(spark.createDataFrame([(simhash.signed(f),) for f in fps], "fp long"), crowd=crowd))
    label = {r["node"]: r["label"] for r in found.collect()}
    ours = [label.get(simhash.signed(f), simhash.signed(f)) for f in fps]
    roots = brute_groups(fps)
    assert len(set(ours)) == len(set(roots)) == len(set(zip(ours, roots)))


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 200), (5, 5)], "a long, b long")
    label = {r["node"]: r["label"] for r in components(edges).collect()}
    assert len({label[i] for i in range(61)}) == 1 and label[100] == label[200] != label[0]


def test_keep_one(spark):
    docs = frame(spark, ["a b c d e f"] * 3 + ["other words here now", None, ""], [5, 5, 9, 7, 8, None])
    kept = simhash.keep_one(docs)
    assert sorted(r["doc_id"] for r in kept.collect()) == [5, 7, 8] and kept.columns == docs.columns
    nameless = frame(spark, ["p q r", "p q r"], [None, None])
    assert simhash.keep_one(nameless).count() == 1
    mixed = frame(spark, ["p q r", "p q r", "x y z", "x y z"], [None, 4, None, None])
    assert sorted((r["doc_id"] or 0, r["text"]) for r in simhash.keep_one(mixed).collect()) == [(0, "x y z"), (4, "p q r")]
    assert simhash.keep_one(empty(spark)).count() == 0


def test_keep_one_of_repeated_ids_and_odd_names(spark):
    texts = ["one text of its own", "another text, the same id", "a third one stands here", "another text, the same id"]
    docs = spark.createDataFrame([(i, t, "k", 1, 2.0, "c") for i, t in zip([5, 5, 2, 2], texts)], "doc_id long, text string, kept_id string, _fp int, key_one double, `a.b` string")
    kept = simhash.keep_one(docs)
    assert sorted((r["doc_id"], r["text"]) for r in kept.collect()) == sorted([(5, texts[0]), (2, texts[2]), (2, texts[1])])
    assert kept.columns == docs.columns


def test_simhash_of_a_very_long_text():
    rng = random.Random(6)
    text = " ".join(rng.choice("abcdefgh") * rng.randint(1, 5) for _ in range(40_000))
    assert simhash.fingerprint(text) == brute_fingerprint(text)


# --- language ID


def test_language_held_out(corpus):
    train = [(t, lang) for d, t, lang in corpus if zlib.crc32(str(d).encode()) % 4 != 2]
    model = langid.fit(*map(list, zip(*train)))
    held = [(t, lang) for d, t, lang in corpus if zlib.crc32(str(d).encode()) % 4 == 2]
    got, score, unclear = langid.Predictor(model).predict([t for t, _ in held])
    assert np.mean([g == lang for g, (_, lang) in zip(got, held)]) > 0.95
    assert ((0 <= score) & (score <= 1)).all() and unclear.mean() < 0.1


def test_language_edges(spark, edge):
    model = langid.fit(["the cat sat on the mat"] * 20 + ["le chat est sur la table"] * 20, ["en"] * 20 + ["fr"] * 20)
    got = langid.identify(edge, model).collect()
    assert len(got) == edge.count() and {r["lang_pred"] for r in got} <= {"en", "fr", "und"}
    blank = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(frame(spark, [None, "12 !", "chat"]), model).collect()}
    assert blank[0] == blank[1] == ("und", 0.0) and blank[2][0] == "fr"
    assert {r["lang_pred"] for r in langid.identify(edge, langid.fit([], [])).collect()} == {"und"}
    assert langid.Predictor(langid.fit(["a"], ["en"])).predict(["b", None])[0] == ["en", "und"]
    assert langid.sample(empty(spark)) == ([], [])
    assert langid.keep_identified(edge, model).columns == edge.columns


@pytest.mark.parametrize("classes", [0, 1, 2, 5, 7, 12])
def test_codewords_differ(classes):
    code = langid.codewords(classes)
    assert len({tuple(r) for r in code}) == (classes if classes > 1 else min(classes, 1))


def test_sums_follow_grams():
    words = ["abc", "", "dé", "abc"]
    bucket, first = subwords.grams(words, (1, 2, 3), 1 << 10, whole=True)
    weights = np.random.default_rng(0).random((1 << 10, 2))
    got = subwords.sums(weights, bucket, first)
    assert np.allclose(got[0], got[3]) and np.allclose(got[2], weights[bucket[first[2] : first[3]]].sum(0))


# --- toxicity


def test_toxicity_finds_words_and_misspellings():
    rng = random.Random(3)
    plain = "the of and table river walks under quiet green houses over some later window paper".split()
    texts, labels = [], []
    for i in range(400):
        ws = [rng.choice(plain) for _ in range(30)]
        if i % 4 == 0:
            ws[rng.randrange(30)] = rng.choice(["horrible", "disgusting", "worthless"])
        texts.append(" ".join(ws))
        labels.append(int(i % 4 == 0))
    scorer = toxicity.Scorer(toxicity.fit(texts, labels))
    high = scorer.scores(["the river is disgusting", "quiet worthless paper"])
    low = scorer.scores(["quiet green houses", "the table", ""])
    assert high.min() > 0.7 > 0.5 > low.max()
    assert scorer.scores(["the disgustingg river"])[0] > low.max()


def test_toxicity_edges(spark, edge):
    model = toxicity.fit(["bad words"] * 10 + ["good words"] * 30, [1] * 10 + [0] * 30)
    got = toxicity.score(edge, model).collect()
    assert len(got) == edge.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    assert toxicity.Scorer(toxicity.fit([], [])).scores(["x"])[0] < 1e-6
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (5, 0), (5, 0)], "doc_id long, toxic int")
    texts, marks = toxicity.sample(edge, labels)
    assert marks == ([0] if zlib.crc32(b"5") % 3 != 1 else [])


# --- records


def test_records_round_trip(spark, edge, tmp_path):
    path = P.path("word_bpe_49k.json")
    folder = f"file://{tmp_path}/r"
    manifest = records.write(edge, path, folder)
    got = [tuple(r) for r in records.read(spark, folder, manifest).orderBy("start").collect()]
    library = Tokenizer.from_file(path)
    want, start = [], 0
    rows = sorted(edge.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0))
    for r in rows:
        ids = [*library.encode(r["text"] or "", add_special_tokens=False).ids, 2]
        want.append((r["doc_id"], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(got, key=str) == sorted(want, key=str)
    first = manifest.orderBy("part", "number").first()
    uri = f"{folder}/{first['file']}"
    assert records.record(uri, uri[:-4] + ".idx", first["records"] - 1)[1][-1] == 2


def test_damage_is_seen():
    data = records.frame(b"payload one") + records.frame(b"two")
    assert [bytes(p) for _, p in records.frames(data)] == [b"payload one", b"two"]
    for at in (0, 9, 14, len(data) - 1):
        broken = bytearray(data)
        broken[at] ^= 1
        with pytest.raises(ValueError):
            list(records.frames(bytes(broken)))


def test_chunk_encoder_equals_library():
    path = P.path("word_bpe_49k.json")
    own, library = records.ChunkEncoder(common.read_bytes(path)), Tokenizer.from_file(path)
    rng = random.Random(8)
    pool = list("abXY é É ß İΣſ²½Ⅷ_ '\"<>|.,!?\t\n\r\x1c\u0085中🙂0129ª") + ["'ll", "'S", "<|endoftext|>", "of,"]
    for _ in range(1500):
        t = "".join(rng.choice(pool) for _ in range(rng.randint(0, 14)))
        assert np.frombuffer(own.encode(t), "<u2").tolist() == library.encode(t, add_special_tokens=False).ids, t


def test_records_of_nothing(spark, tmp_path):
    assert records.write(empty(spark), P.path("word_bpe_49k.json"), f"file://{tmp_path}/n").count() == 0


# --- decontamination


def plain_distance(pattern, text):
    before = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        now = [i]
        for j, e in enumerate(text, 1):
            now.append(min(before[j] + 1, now[j - 1] + 1, before[j - 1] + (c != e)))
        before = now
    return min(before)


def test_edit_distance():
    rng = random.Random(1)
    for _ in range(200):
        p = "".join(rng.choice("abc") for _ in range(rng.randint(1, 12)))
        t = "".join(rng.choice("abc") for _ in range(rng.randint(0, 20)))
        assert decontaminate.edit_distance(p, t)[0] == plain_distance(p, t)


def test_leaks_recall_and_clean_documents(corpus):
    items = duckdb.sql(f"SELECT item_id, text FROM '{SF}/benchmark.parquet'").fetchall()
    index = decontaminate.Items(items)
    rng = random.Random(2)
    bodies = [t for _, t, _ in corpus]
    texts, want = [], set()
    for k, (_, x) in enumerate(items):
        y = list(x)
        for _ in range(int(0.05 * len(y))):
            p = rng.randrange(len(y))
            y[p : p + 1] = rng.choice([[], ["q"], [y[p], "z"]])
        base = rng.choice(bodies)
        cut = base.rfind(" ", 0, len(base) // 2) + 1
        texts.append(base[:cut] + "".join(y) + " " + base[cut:])
        want.add((k, index.items[k][0]))
    got = {(row, index.items[i][0]) for row, i, _, _ in decontaminate.leaks(index, texts)}
    assert len(want & got) >= 0.9 * len(want)
    clean = [" ".join(rng.sample(t.split(), len(t.split()))) for t in bodies]
    assert not decontaminate.leaks(index, clean)


def test_leak_rows(spark, edge):
    bench = spark.createDataFrame([(1, "short item"), (2, None), (3, ""), (1, "short item"), (None, "a much longer benchmark item that has well over fifty characters in it, certainly")], "item_id long, text string")
    docs = edge.unionByName(frame(spark, ["here a SHORT\n item stands", "x a much longer benchmark item that has well over fifty characters in it, certainly y"], [50, 51]))
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(docs, bench).collect()}
    assert got == {(50, 1), (51, None)}
    kept = decontaminate.keep_uncontaminated(docs, bench)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 2
    assert decontaminate.find_leaks(docs, bench.where("false")).count() == 0
    # Many blocks in files find what one broadcast block finds.
    in_blocks = decontaminate.source(bench, 40)
    assert in_blocks.shared is None and in_blocks.count > 2 and sum(len(b.items) for b in in_blocks.blocks()) == 2
    assert sorted(map(tuple, decontaminate.find_leaks(docs, bench, 40).collect()), key=str) == sorted(map(tuple, decontaminate.find_leaks(docs, bench).collect()), key=str)
    assert decontaminate.keep_uncontaminated(docs, bench, 40).count() == docs.count() - 2


def test_leak_in_a_very_long_text():
    words = random.Random(12)
    prose = lambda n: " ".join("".join(words.choices("abcdefghijklmnop", k=6)) for _ in range(n))
    item = prose(20)
    edited = item[:60] + "zz" + item[63:]
    found = decontaminate.leaks(decontaminate.Items([(1, item)]), [prose(60_000) + " " + edited + " " + prose(60_000)])
    assert [(row, k, d) for row, k, d, _ in found] == [(0, 0, plain_distance(item, edited))]


# --- I-Match


@pytest.mark.parametrize("low, high", [(20, 44), (45, 80), (81, 150), (151, 400)])
def test_leaks_with_a_fifth_edited(low, high):
    g, letters = random.Random(low), "abcdefghijklmnopqrstuvwxyz "
    word = lambda: "".join(g.choices(letters[:-1], k=g.randint(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    items = [prose(90)[: g.randint(low, high)].strip() for _ in range(100)]
    texts = []
    for item in items:
        chars = list(item)
        for _ in range(len(item) // 5):
            k = g.randrange(len(chars))
            chars[k : k + g.randint(0, 1)] = g.choice([[], [g.choice(letters)]])
        texts.append(f"{prose(30)} {''.join(chars)} {prose(30)}")
    found = {(row, i) for row, i, *_ in decontaminate.leaks(decontaminate.Items(list(enumerate(items))), texts)}
    assert sum((k, k) in found for k in range(100)) >= 90


def test_imatch_next_and_edited(spark, edge):
    rows = sorted(edge.where("doc_id is not null").dropDuplicates(["doc_id"]).collect(), key=lambda r: r["doc_id"])
    docs = spark.createDataFrame([(r["doc_id"], r["text"]) for r in rows], "doc_id long, text string")
    got = {r["doc_id"]: r for r in imatch.fingerprints(docs).collect()}
    assert len(got) == len(rows)
    for k, r in enumerate(rows):
        text, follower = r["text"] or "", rows[(k + 1) % len(rows)]["text"] or ""
        n = len(text) // 2
        assert got[r["doc_id"]]["edited_sha256"] == hashlib.sha256((text[: len(text) - n] + follower[:n]).encode()).hexdigest()
        assert got[r["doc_id"]]["n_chars"] == len(text)
    assert imatch.fingerprints(edge).count() == edge.count()
    assert imatch.fingerprints(empty(spark)).count() == 0


def brute_lexicon(texts):
    seen = {}
    for t in texts:
        for w in set((t or "").lower().split()):
            seen[w] = seen.get(w, 0) + 1
    n = len(texts)
    low, high = max(2, -(-n * 25 // 100_000)), max(2, n * 2 // 100)
    return {w for w, c in seen.items() if low <= c <= high}


def test_imatch_lexicon_is_exact(spark, corpus):
    texts = [t for _, t, _ in corpus] + [None, "", "twice", "twice"]
    docs = frame(spark, texts)
    want = sorted(imatch.term_hash(w) for w in brute_lexicon(texts))
    assert imatch.lexicon(docs).tolist() == want and "twice" in brute_lexicon(texts)
    assert imatch.lexicon(empty(spark)).tolist() == []


def brute_fingerprint_of(text, lexicon):
    """The fingerprint by definition: per draw and rate, the sum over the terms of the subset."""
    words = set((text or "").lower().split())
    terms = {imatch.term_hash(w) for w in words & lexicon} or {imatch.term_hash(w) for w in words}
    m = (1 << 64) - 1
    out = []
    for draw in range(imatch.DRAWS):
        levels = []
        for t in terms:
            luck = t * int(imatch._SALTS[0, draw]) & m
            luck ^= luck >> 32
            luck = luck * int(imatch._SALTS[1, draw]) & m
            value = (t ^ (luck << 7 & m)) * 0x9E3779B97F4A7C15 & m
            value ^= value >> 29
            top = (luck >> 40) | 1
            levels.append((min(imatch.LEVELS - 1, 63 - (top.bit_length() - 1) - 40), value & 0xFFFFFFFF))
        for level in range(imatch.LEVELS):
            inside = [v for k, v in levels if k >= level]
            out.append(((sum(inside) * 0xD6E8FEB86659FD93 & m) >> 32) % 0xFFFF + 1 if inside else 0)
    return np.array(out, "<u2").tobytes().hex()


def test_imatch_fingerprints_equal_brute_force(spark, corpus):
    rows = [(d, t) for d, t, _ in corpus][:60] + [(1000, ""), (1001, None), (1002, "only hapaxlegomenon"), (1003, "b a a b"), (1004, "a b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    lexicon = brute_lexicon([t for _, t in rows])
    got = {r["doc_id"]: r for r in imatch.fingerprints(docs).collect()}
    rows.sort()
    for k, (d, t) in enumerate(rows):
        follower = rows[(k + 1) % len(rows)][1] or ""
        assert got[d]["fingerprint"] == brute_fingerprint_of(t, lexicon)
        assert got[d]["edited_fingerprint"] == brute_fingerprint_of(imatch.edited(t or "", follower), lexicon)
        assert got[d]["next_fingerprint"] == brute_fingerprint_of(follower, lexicon)
    assert got[1003]["fingerprint"] == got[1004]["fingerprint"] and got[1003]["near_next"] == 1


def test_imatch_tells_halves_from_strangers(spark, corpus):
    got = imatch.fingerprints(spark.createDataFrame([(d, t) for d, t, _ in corpus], "doc_id long, text string")).collect()
    near, far = [r["near_edited"] for r in got], [r["near_next"] for r in got]
    assert np.mean([(a > b) + (a == b) / 2 for a in near for b in far]) > 0.9


# --- HTML


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var a="</p>";</script></head><body><header><h1>Site</h1></header><nav><ul><li><a href=x>Home</a></ul></nav>
<div class="cookie-notice">We use cookies</div><!-- <p>no</p> --><article><h1>Title &amp; {n}</h1><p><b>First &lt;b&gt;<br>line {n}<p>Second&nbsp;  para {n}</p><div class="ad">Buy</div><form><p>Name</p></form>
<section class="comments"><p>me too</p></section><aside>More</aside></article><footer>&copy; x</footer></body>"""


def test_main_text(spark):
    rows = [(i, f"https://h{i % 2}.example/p", PAGE.format(n=i), "clash") for i in range(8)]
    rows += [(8, None, None, ""), (9, "odd", "", ""), (10, "https://h0.example/", "just text <b>bold</b>", ""), (0, "https://h0.example/p", PAGE.format(n=0), "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = html_extract.extract(pages).collect()
    assert len(got) == len(rows)
    by = {r["page_id"]: r for r in got}
    assert by[3]["text"] == "Title & 3\n\nFirst <b> line 3\n\nSecond para 3" and by[3]["n_chars"] == len(by[3]["text"])
    assert by[8]["text"] == by[9]["text"] == "" and by[10]["text"] == "just text bold"
    assert html_extract.extract(pages.where("false")).count() == 0


def test_template_without_article(spark):
    body = "<html><body><div class=top><p>Menu words</p></div><div class=c><p>Story {n} begins here with many words</p><p>and goes on {n}</p></div><div class=end><p>Bye now</p></div></body></html>"
    pages = spark.createDataFrame([(i, "https://h/x", body.format(n=i)) for i in range(6)], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_extract.extract(pages).collect()}
    assert got[2] == "Story 2 begins here with many words\n\nand goes on 2"


def test_template_inside_article(spark):
    body = (
        "<html><body><article><h1>Title {n}</h1><div><p>Read our offer</p></div><p class=related-work>Earlier work {n}</p>"
        "<div class=share>Share {n}</div><p>Story {n}</p></article><div>Bye</div></body></html>"
    )
    pages = spark.createDataFrame([(i, "https://h/x", body.format(n=i)) for i in range(6)], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_extract.extract(pages).collect()}
    assert got[2] == "Title 2\n\nEarlier work 2\n\nStory 2"


def test_shorter_parts_stay(spark):
    two = "<body><article><p>{}</p></article><article><p>{}</p></article></body>".format("long " * 600, "short " * 50)
    loose = "<body><div><p>{}</p></div><div><p>{}</p></div></body>".format("long " * 600, "short " * 50)
    pages = spark.createDataFrame([(0, "https://a/x", two), (1, "https://b/x", loose)], "page_id long, url string, html string")
    for r in html_extract.extract(pages).collect():
        assert r["text"] == ("long " * 600).strip() + "\n\n" + ("short " * 50).strip()


def test_salted_templates_equal_broadcast_ones(spark, monkeypatch):
    pages = spark.createDataFrame([(i, "https://h/x", PAGE.format(n=i)) for i in range(6)], "page_id long, url string, html string")
    before = sorted(map(tuple, html_extract.extract(pages).collect()))
    monkeypatch.setattr(html_extract, "BROADCAST", -1)
    assert sorted(map(tuple, html_extract.extract(pages).collect())) == before


# --- chat


def test_preference_pairs(spark):
    rows = [
        (0, "chosen", 0, "user", "hi"), (0, "chosen", 1, "assistant", "yes"), (0, "chosen", 2, "user", "more"),
        (0, "rejected", 0, "user", "hi"), (0, "rejected", 1, "assistant", "no"),
        (1, "chosen", 0, "user", "alone"), (2, "both", 0, "user", "same"), (2, "chosen", 64, "assistant", "x"), (2, "rejected", 64, "assistant", "é🙂"), (2, "both", 0, "user", "same"),
        (3, "chosen", 0, "a", "p"), (3, "chosen", 0, "a", "q"), (3, "rejected", 0, "a", "q"), (None, "both", 1, "user", "x"), (6, "both", None, "user", "x"), (7, "odd", 1, "user", "x"), (8, "both", 1, None, None),
    ]
    turns = spark.createDataFrame([(*r, "clash", 1) for r in rows], "pair_id long, side string, turn long, role string, text string, prompt string, part int")
    got = {(r["pair_id"], r["part"]): r for r in chat_format.format_pairs(turns).collect()}
    show = lambda role, text: f"<|{role}|>\n{text}\n<|end|>\n"
    assert set(got) == {(0, 0), (1, 0), (2, 0), (2, 1), (3, 0), (8, 0)}
    first = got[0, 0]
    assert (first["prompt"], first["chosen"], first["rejected"]) == (show("user", "hi"), show("assistant", "yes") + show("user", "more"), show("assistant", "no"))
    a, b = map(int, first["chosen_loss"].split(":"))
    assert first["chosen"][a:b] == "yes\n<|end|>\n" and first["rejected_loss"] == f"{a}:{b - 1}"
    assert (got[1, 0]["prompt"], got[1, 0]["chosen"], got[1, 0]["rejected"], got[1, 0]["chosen_loss"]) == ("", show("user", "alone"), "", "")
    assert got[2, 0]["prompt"] == show("user", "same") and got[2, 0]["n_prompt"] == 1 and got[2, 0]["chosen"] == ""
    a, b = map(int, got[2, 1]["rejected_loss"].split(":"))
    assert got[2, 1]["rejected"][a:b] == "é🙂\n<|end|>\n" and got[2, 1]["prompt"] == ""
    assert got[3, 0]["prompt"] == "" and got[3, 0]["chosen"] == show("a", "p") + show("a", "q") and got[3, 0]["chosen_loss"] == ""
    assert got[8, 0]["prompt"] == show("", "")
    assert chat_format.format_pairs(turns.where("false")).count() == 0


def test_pairs_are_made_of_neighbours(spark):
    rows = [(0, 0, "user", "q"), (0, 1, "assistant", "one"), (0, 2, "user", "then"), (5, 0, "assistant", "two"), (6, 0, "user", "no answer"), (63, 3, "assistant", "three"), (64, 0, "assistant", "other block"), (0, 1, "assistant", "one")]
    turns = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, side string")
    got = {r["pair_id"]: r for r in chat_format.format_pairs(chat_format.paired(turns)).collect()}
    answer = lambda r, s: r[s][len("<|assistant|>\n") :].split("\n")[0]
    assert [(k, answer(got[k], "chosen"), answer(got[k], "rejected")) for k in (0, 5, 63)] == [(0, "one", "two"), (5, "two", "three"), (63, "three", "one")]
    assert got[0]["chosen"].endswith("then\n<|end|>\n") and got[0]["n_prompt"] == 1
    assert got[6]["chosen"] == got[64]["rejected"] == "" and got[64]["n_prompt"] == 1
    long = spark.createDataFrame([(9, k, "user" if k % 2 else "assistant", "w " * 20_000) for k in range(200)], "conv_id long, turn long, role string, text string")
    parts = chat_format.format_pairs(chat_format.paired(long)).collect()
    assert sorted(r["part"] for r in parts) == [0, 1, 2, 3] and sum(len(r["prompt"]) for r in parts) > 200 * 40_000


def test_chat_equals_sql(spark):
    got = chat_format.query(spark, SF)
    want = duckdb.sql(chat_format.SQL.replace("FROM conversations", f"FROM '{SF}/conversations.parquet'"))
    names = sorted(got.columns)
    at = [want.columns.index(c) for c in names]
    assert sorted(repr([r[c] for c in names]) for r in got.collect()) == sorted(repr([r[i] for i in at]) for r in want.fetchall())


# --- secrets


def test_base_spans():
    text = "Api_Key = 'abcdefghijkl' passwd:short token=\"0123456789abcdef0123\" AKIAABCDEFGHIJKLMN AKIA1 deadbeefdeadbeef00"
    got = secret_scan.joined(secret_scan.base_spans(text))
    want = [("assign", text.index("Api"), text.index("abcdefghijkl") + 12), ("assign", text.index("token"), text.index("0123\" ") + 4), ("hex", text.index("0123456789"), text.index("0123\" ") + 4)]
    want += [("access", text.index("AKIA"), text.index("AKIA") + 18), ("hex", text.index("dead"), len(text))]
    assert got == ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(want, key=lambda x: x[1]))


def test_costs_order_and_context():
    cost = secret_scan.log_guesses
    assert cost("password1") < cost("qwertyuiop") + 1 < cost("x9$Kq2!vLm")
    assert cost("aaaaaaaaaaaa") < 4 and cost("20240101") < 6 and cost("") == 0
    spans = lambda t: secret_scan.guessed_spans(t, secret_scan.base_spans(t))
    assert [t[s:e] for t in ["pwd: x9$Kq2!vLm ok"] for s, _, e, _ in spans(t)] == ["x9$Kq2!vLm"]
    assert not spans("password: password1!") and not spans("secret: your_secret_here") and not spans("nothing at all x9$Kq2!vLm")
    assert secret_scan.redacted("a token = abcdefghijklmnop b") == "a token = [SECRET] b"


def test_cost_alone_decides():
    spans = lambda t: [t[s:e] for s, _, e, _ in secret_scan.guessed_spans(t, secret_scan.base_spans(t))]
    for value in ["hGkQzLwPxVtRmB", "QwzXkPvRtLmN", "$Tr0ub4qZ9!xLp", "$2b$12$KIXqT9rWvZ3bN5mJ8sLcHe", "yourQz7LwPx9VtRmB", "z" * 300 + "x9$Kq2!vLmT7"]:
        assert spans(f"pwd: {value} ok") == [value]
    assert spans("://bob:QwzXkPvRtLmN@host") == ["QwzXkPvRtLmN"]
    for value in ["${DB_PASSWORD}", "$DB_PASSWORD", "%PASSWORD%", "your_secret_here", "changeme", "********", "z" * 600]:
        assert not spans(f"pwd: {value} ok")


def test_scan_rows(spark, edge):
    got = secret_scan.scan(edge).collect()
    assert len(got) == edge.count() and all(r["spans"] == "" and r["base_sha256"] == hashlib.sha256(b"").hexdigest() for r in got)
    docs = edge.withColumn("n_chars", F.length("text"))
    out = secret_scan.redact(docs)
    assert out.schema == docs.schema and sorted(map(str, out.collect())) == sorted(map(str, docs.collect()))


# --- pipeline


def test_pipeline_equals_stages_by_hand(spark, corpus, tmp_path):
    import corpus_pipeline

    items = duckdb.sql(f"SELECT item_id, text FROM '{SF}/benchmark.parquet'").fetchall()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(*langid.sample(docs))
    langs, _, unclear = langid.Predictor(model).predict([t for _, t, _ in corpus])
    left = [(d, t) for (d, t, _), lang, u in zip(corpus, langs, unclear) if lang != "und" and not u]
    roots = brute_groups([brute_fingerprint(t) for _, t in left])
    first = {}
    for (d, _), root in zip(left, roots):
        first[root] = min(first.get(root, d), d)
    left = [(d, t) for d, t in left if d in set(first.values())]
    hit = {row for row, *_ in decontaminate.leaks(decontaminate.Items(items), [t for _, t in left])}
    exact = {i for i, (_, t) in enumerate(left) if any(decontaminate.squeeze(x) in decontaminate.squeeze(t) for _, x in items)}
    assert exact <= hit
    enc = tik()
    want = {}
    for i, (d, t) in enumerate(left):
        if i not in hit:
            want[d] = len(enc.encode_ordinary(secret_scan.redacted(t)))
    assert {r["doc_id"]: r["n_tokens"] for r in corpus_pipeline.run(spark, SF).collect()} == want
