"""Group alignment, periodic runs and backtracking BPE against brute force and the libraries, on small fixtures."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from riskloom.llm import backtrack_bpe, common, cross_align, periodic
from riskloom.llm.records import byte_letters

from test_llm import EDGE, SF, empty, frame

A, B, WORDS = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"), P.path("word_bpe_49k.json")
ODD = ["", " ", "a  b", "\n x\n\n y ", "▁ literal", "x" * 3000, "<|endoftext|> and </s>", "a\x00b\x1c c\x85 d​ e", "é ß 中文🙂 y", "word " * 500, None]


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


# --- groups of two tokenizers


def brute_alignment(texts):
    """Per (doc_id, text): the contract's row, from whole texts encoded by the libraries."""
    a, b = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    back = {c: n for n, c in byte_letters().items()}
    piece = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    found, counts = [], Counter()
    for doc_id, text in texts:
        ids_a = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        raw_a, raw_b = [bytes(back[c] for c in a.id_to_token(i)) for i in ids_a], [piece(i) for i in ids_b]
        if not text or not (b"".join(raw_a) == b"".join(raw_b) == (" " + text).encode()):
            found.append((doc_id, [], [], [], ""))
            continue
        ends_a, ends_b = (dict(zip(np.cumsum([len(x) for x in raw]).tolist(), range(len(raw)))) for raw in (raw_a, raw_b))
        both = sorted(ends_a.keys() & ends_b.keys())
        linked = [(ids_a[ends_a[e]], ids_b[ends_b[e]]) for e in both]
        counts.update(linked)
        groups, x, y = [], 0, 0
        for e in both:
            groups.append(f"{','.join(map(str, ids_a[x : ends_a[e] + 1]))}|{','.join(map(str, ids_b[y : ends_b[e] + 1]))}")
            x, y = ends_a[e] + 1, ends_b[e] + 1
        found.append((doc_id, ids_a, ids_b, linked, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    best = Counter()
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    return sorted([(d, len(x), len(y), len(li), len(li), sum(counts[p] == best[p[1]] for p in li), sum(counts[p] for p in li), h) for d, x, y, li, h in found], key=str)


def test_alignment_equals_brute_force(spark):
    texts = [*EDGE, *ODD, "a", "a", "Straße des 17. Juni", "the the the"]
    docs = frame(spark, texts, [*range(len(texts) - 3), 3, None, 3])
    want = brute_alignment([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert rows(cross_align.digests(docs, A, B)) == want
    assert cross_align.digests(empty(spark), A, B).count() == 0


def test_alignment_of_many_blocks(spark):
    """Documents in many partitions, and so in many dictionaries, give what one dictionary gives."""
    docs = common.table(spark, SF, "documents").where("doc_id < 40")
    want = brute_alignment([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert rows(cross_align.digests(docs.repartition(7), A, B)) == want


def test_chunks_encode_as_whole_texts():
    made = cross_align.Pair(common.read_bytes(A), common.read_bytes(B))
    assert made.separable and made.quick
    rng = random.Random(11)
    pool = [*"abcdeéß中🙂 \n\t  ,.'19\x1c\x85᠎​\xa0　²_", "the", " of", "  ", " ", "'ll", "▁", "<|endoftext|>", "<s>", "\x00", "́"]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(1, 25))) for _ in range(3000)]
    for text, found in zip(texts, made.encode(texts)):
        made_whole = made.joined(text, made.a.encode(" " + text, add_special_tokens=False).ids, made.b.encode(text))
        assert ";".join(c.joined for c in found) == made_whole.joined, text


def test_links_of_groups_and_weights(spark):
    size = [b"a", b"bb", b"ccc"]
    assert cross_align.expand("0,1|2", size, size) == {(1, 2): 1}
    assert cross_align.expand("0,1|2", size, size, "overlap") == {(0, 2): 1, (1, 2): 1}
    assert cross_align.expand("1,1|0,2", size, size, "overlap") == {(1, 0): 1, (1, 2): 2}
    assert cross_align.expand("0,0|1", size, size, "overlap") == {(0, 1): 2}
    docs = frame(spark, ["x x x", "x"])
    once, all_times = (sum(r["count"] for r in cross_align.link_counts(docs, A, B, weight=w).collect()) for w in ("docs", "freq"))
    assert (once, all_times) == (2, 4)
    assert [len(r["groups"]) for r in sorted(cross_align.alignments(docs, A, B).collect())] == [3, 1]
    with pytest.raises(ValueError):
        cross_align.link_counts(docs, A, B, rule="none")


# --- periodic runs


def brute_runs(words):
    out = []
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            if j > i and length >= max(6, 4 * q) and not any(q % p == 0 and a <= i and a + n >= i + length for a, n, p in out):
                out.append((i, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_equal_brute_force():
    rng = random.Random(12)
    for _ in range(300):
        docs = []
        for _ in range(rng.randint(0, 8)):
            words = [b"%d" % rng.randrange(rng.choice([1, 2, 3, 5])) for _ in range(rng.randint(0, 60))]
            if rng.random() < 0.5 and words:
                a, p = rng.randrange(len(words)), rng.randint(1, 12)
                words = words[:a] + (words[a : a + p] * 20)[: rng.randint(1, 60)] + words[a:]
            docs.append(words)
        assert periodic.runs_of(docs) == [brute_runs(w) for w in docs]


def test_long_and_nested_runs():
    assert periodic.runs_of([[b"a"] * 50_000]) == [[(0, 50_000, 1)]]
    assert periodic.runs_of([[b"x", *([b"a", b"b"] * 20_000), b"y"]]) == [[(1, 40_000, 2)]]
    nested = ([b"a"] * 6 + [b"b"]) * 4
    assert periodic.runs_of([nested]) == [brute_runs(nested)]


def test_periodic_digests_equal_brute_force(spark):
    texts = [*EDGE, "a b a b a b a b", "tic tac " * 9 + "end", "x\x0bx\x0cx\rx x x x", "a a a a a", "a", "a"]
    docs = frame(spark, texts, [*range(len(texts) - 3), 3, None, 3])
    want = []
    for r in docs.collect():
        words = (r["text"] or "").encode().split()
        h = zlib.crc32(str(r["doc_id"]).encode())
        if r["doc_id"] is not None and h % 10 == 0 and words:
            n, g = len(words), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
        runs = brute_runs(words)
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
        sha = lambda s: hashlib.sha256(s).hexdigest()
        kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
        want.append((r["doc_id"], len(runs), *top, 1000 * top[1] // top[2] if runs else None, sha("".join("%d,%d,%d\n" % x for x in runs).encode()), sha(kept)))
    assert rows(periodic.digests(docs, periodic.planted)) == sorted(want, key=str)
    assert rows(periodic.runs(docs.where("text like 'tic%'"))) == [(12, 0, 18, 2)]
    assert [r["text"] for r in periodic.collapsed(docs.where("text like 'tic%'")).collect()] == ["tic tac end"]
    assert periodic.digests(empty(spark)).count() == 0


# --- backtracking BPE


def test_backtracking_equals_library(spark):
    library, made = Tokenizer.from_file(WORDS), backtrack_bpe.Backtracker(common.read_bytes(WORDS))
    rng = random.Random(13)
    pool = [*"abcdeéßİΣ中🙂 \n\t  ,.'19\x1c\x85᠎​\xa0́ÀÅ<|>_²", "the", "  ", "'ll", "<|endoftext|>", "<|startoftext|>", "\x00", "ing", "aaaa"]
    letters = "abcdefghijklmnopqrstuvwxyzetaoinsh"
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(1, 25))) for _ in range(4000)]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randint(1, 30))) for _ in range(4000)]
    for text in [*texts, *[t or "" for t in ODD + EDGE]]:
        want = library.encode(text, add_special_tokens=False).ids
        ids = np.frombuffer(made.encode(text), "<u4").astype(np.int64)
        assert ids.tolist() == want, text
        assert made.decode(ids).decode() == library.decode(want, skip_special_tokens=False), text
    docs = frame(spark, [*EDGE, *ODD, "a"], [*range(len(EDGE) + len(ODD)), None])
    want = []
    for r in docs.collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        sha = lambda b: hashlib.sha256(b).hexdigest()
        want.append((r["doc_id"], len(ids), sha(np.array(ids, "<u4").tobytes()), sha(library.decode(ids, skip_special_tokens=False).encode())))
    assert rows(backtrack_bpe.digests(docs, WORDS)) == sorted(want, key=str)
    assert backtrack_bpe.digests(empty(spark), WORDS).count() == 0
    back = backtrack_bpe.decode_ids(backtrack_bpe.encode_ids(docs, WORDS), WORDS)
    assert back.where("doc_id = 4").first()["text"] == "the</w> the</w> the</w>" and back.count() == docs.count()


def test_every_token_encodes_to_itself():
    """The table admits all tokens of the file, and a word of one token is that token."""
    made = backtrack_bpe.Backtracker(common.read_bytes(WORDS))
    assert len(made.vocabulary.tokens) == 49_406
    ended = [(t[:-1], i) for t, i in made.vocabulary.tokens.items() if t.endswith(backtrack_bpe.END)]
    for word, token in random.Random(14).sample(ended, 3000):
        assert made.tokens_of(word) == [token]


def test_only_bpe_with_word_ends():
    with pytest.raises(ValueError):
        backtrack_bpe.Backtracker(common.read_bytes(A))
