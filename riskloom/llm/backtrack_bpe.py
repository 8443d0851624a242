"""BPE with word ends by backtracking over longest matches; decoding by an offset table.

A sequence of tokens is the BPE encoding of a word exactly if each token
encodes to itself and each two neighbours are compatible, that is, merging
their joint text gives just these two. So the encoder takes the longest token
at a place (an Aho-Corasick automaton over the word gives the longest token
that ends at a place, the one kept per token leads to the next shorter one
with the same start) and keeps it if it is compatible with the token before;
otherwise it tries the next shorter, and steps back when none is left.
Places from which no encoding goes on are marked, so every place is left for
good at most once: time is linear in the word.

Compatibility is looked up in a table of pairs, filled as pairs occur. It is
decided by taking back the merges of both tokens from the last one on: a merge
across the border spoils the pair if it would have come before the merges that
swallowed its two sides (in the left token earlier or at the same rank, since
of equal merges the left one comes first).

Normalizer, split pattern and special tokens are those of the tokenizer file,
applied by the library; special tokens' strings in texts become their ids, as
the library has it. Texts are encoded by chunks between spaces (white space
becomes a space and no match of the split pattern holds one; whether that is
so is checked on the file), each distinct chunk once per worker.

Decoding concatenates entries of one buffer of token strings, found by a table
of their offsets; tokens are joined by spaces, as the library does for a
tokenizer without a decoder.

Contract: one row per input row, whole texts. A null text is the empty text:
no tokens, hashes of nothing. A null ``doc_id`` stays null, repeated rows give
repeated rows, extra columns are ignored. No shuffle.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common
from .records import APART, CLOSING, PARTS, PLAIN, byte_letters, known_split

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
#: Distinct chunks, words and pairs remembered by one worker.
CACHE = 200_000
#: Stands for the end of a word; no byte-level letter.
END = "\0"
SUFFIX = "</w>"
NEVER = 1 << 60


class Vocabulary:
    """The merges of a BPE with word ends: what each token is made of, and when."""

    def __init__(self, model: dict) -> None:
        if model["type"] != "BPE" or model["end_of_word_suffix"] != SUFFIX or model["dropout"] or model["byte_fallback"]:
            raise ValueError("the tokenizer file isn't a BPE with word ends")
        vocab = model["vocab"]
        self.spelt = {i: t for t, i in vocab.items()}
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}  # (left, right): (when, what they make)
        self.made: dict[int, tuple[int, int, int]] = {}  # token: (when, left, right)
        for when, merge in enumerate(model["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            left, right, token = vocab[a], vocab[b], vocab[a + b]
            self.rank[left, right] = when, token
            self.made.setdefault(token, (when, left, right))
        if any(max(self.when(x), self.when(y)) >= t for t, x, y in self.made.values()):
            raise ValueError("a merge comes before one of its parts")
        self.compatible = common.BoundedCache(self._compatible, CACHE)
        # Tokens that their own text doesn't encode to never occur; single letters have no parts.
        whole = {i for i in self.spelt if i not in self.made}
        for token, (when, left, right) in sorted(self.made.items(), key=lambda t: t[1]):
            if left in whole and right in whole and self._border(left, right, when):
                whole.add(token)
        self.tokens = {self.text(i): i for i in whole}

    def when(self, token: int) -> int:
        return self.made[token][0] if token in self.made else -1

    def text(self, token: int) -> str:
        spelt = self.spelt[token]
        return spelt.removesuffix(SUFFIX) + END if spelt.endswith(SUFFIX) and spelt != SUFFIX else spelt

    def _compatible(self, pair: tuple[int, int]) -> bool:
        return self._border(*pair, NEVER)

    def _border(self, left: int, right: int, until: int) -> bool:
        """Whether no merge before ``until`` crosses the border of two tokens while they are formed."""
        last_left = last_right = until  # when the present left and right neighbour of the border are swallowed
        while True:
            crossing = self.rank.get((left, right))
            if crossing is not None and crossing[0] < last_left and crossing[0] <= last_right and crossing[0] < until:
                return False
            a, b = self.when(left), self.when(right)
            if a < 0 and b < 0:
                return True
            if b >= a:  # of equal merges the right one came last
                last_right = b
                right = self.made[right][1]
            else:
                last_left = a
                left = self.made[left][2]


class Backtracker:
    """Encoder and decoder of a tokenizer file with word ends."""

    def __init__(self, spec: bytes) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import ahocorasick
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_buffer(spec)
        file = json.loads(spec)
        vocabulary = self.vocabulary = Vocabulary(file["model"])
        if file["decoder"] is not None:
            raise ValueError("the tokenizer file has a decoder of its own")
        self.compatible = vocabulary.compatible
        self.automaton = ahocorasick.Automaton()
        # Words are read backwards, so that "longest token that ends here" is the longest that starts at a place.
        for text, token in vocabulary.tokens.items():
            self.automaton.add_word(text[::-1], (len(text), token))
        self.automaton.make_automaton()
        self.shorter = self._shorter(vocabulary.tokens)
        self.size = {token: len(text) for text, token in vocabulary.tokens.items()}
        special = file["added_tokens"]
        if any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in special):
            raise ValueError("special tokens with rules of their own")
        self.special = {t["content"]: t["id"] for t in special}
        self.marks = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if special else None
        self.by_space = self._by_space()
        self.known = known_split(file)
        self.letters = byte_letters()
        spelt = {**vocabulary.spelt, **{i: t for t, i in self.special.items()}}
        # The offset table: entry i of the buffer is token i and a space.
        entries = [(spelt.get(i, "") + " ").encode() for i in range(max(spelt) + 1)]
        self.buffer = np.frombuffer(b"".join(entries), np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(e) for e in entries])])
        self.words = common.BoundedCache(self._word, CACHE)
        self.chunks = common.BoundedCache(self._chunk, CACHE)

    @staticmethod
    def _shorter(tokens: dict[str, int]) -> dict[int, int]:
        """Token: the longest shorter token with the same start (-1: none)."""
        out = {}
        for text, token in tokens.items():
            out[token] = next((tokens[text[:n]] for n in range(len(text) - 1, 0, -1) if text[:n] in tokens), -1)
        return out

    def _by_space(self) -> bool:
        """Whether chunks between spaces can be encoded apart."""
        return [p for p, _ in self.library.pre_tokenizer.pre_tokenize_str("a b  c")] == ["a", "b", "c"]

    def tokens_of(self, word: str) -> list[int]:
        """Ids of a word in byte-level letters."""
        text = word + END
        n = len(text)
        longest = [-1] * n
        for end, (_, token) in self.automaton.iter(text[::-1]):
            # The automaton reports the tokens that end at a place from the longest on.
            if longest[n - 1 - end] < 0:
                longest[n - 1 - end] = token
        size, shorter, compatible = self.size, self.shorter, self.compatible
        out: list[int] = []
        dead = bytearray(n + 1)
        at, token = 0, longest[0]
        while at < n:
            while token >= 0:
                after = at + size[token]
                if not dead[after] and (not out or compatible[out[-1], token]):
                    break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at = after
                token = longest[at] if at < n else -1
                continue
            if not out:
                raise ValueError(f"no encoding of {word!r}")
            dead[at] = 1
            token = out.pop()
            at -= size[token]
            token = shorter[token]
        return out

    def _word(self, word: str) -> bytes:
        return array("I", self.tokens_of(word)).tobytes()

    def _plain(self, text: str) -> bytes:
        """Ids of a text without special tokens' strings."""
        parts = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return b"".join([self.words[p] for p, _ in parts])

    def _part(self, part: str) -> bytes:
        """Ids of one match of the known split pattern, lower-cased."""
        return self.words[part if part.isascii() else part.encode().decode("latin-1").translate(self.letters)]

    def _chunk(self, chunk: str) -> bytes:
        if self.known:
            if chunk.isascii() and chunk.isalpha():
                return self.words[chunk.lower()]
            if chunk[-1:] in CLOSING and chunk[:-1].isascii() and chunk[:-1].isalpha():
                return self.words[chunk[:-1].lower()] + self.words[chunk[-1]]
            if PLAIN.fullmatch(chunk) and not APART.search(chunk):
                return b"".join([self._part(p) for p in PARTS.findall(chunk.lower())])
        if self.marks is None or not self.marks.search(chunk):
            return self._plain(chunk) if chunk else b""
        return b"".join([array("I", [self.special[p]]).tobytes() if p in self.special else self._plain(p) for p in self.marks.split(chunk) if p])

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as unsigned 32-bit integers."""
        if not self.by_space:
            return self._chunk(text)
        chunks = self.chunks
        return b"".join([chunks[c] for c in text.split(" ")])

    def decode(self, ids: np.ndarray) -> bytes:
        """Token strings of the ids, joined by spaces, as UTF-8."""
        if not len(ids):
            return b""
        starts, ends = self.offsets[ids], self.offsets[ids + 1]
        sizes = ends - starts
        at = np.cumsum(sizes)
        where = np.repeat(starts - (at - sizes), sizes) + np.arange(at[-1])
        return self.buffer[where[:-1]].tobytes()


def coder(spec: bytes) -> Backtracker:
    """The worker's coder, made once for a broadcast tokenizer file."""
    return common.held(spec, lambda: Backtracker(spec))


def digests(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Token counts and hashes of ids and decoded text of every whole text. No shuffle."""
    spec = docs.sparkSession.sparkContext.broadcast(common.read_bytes(tokenizer_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, sha = coder(spec.value), hashlib.sha256
        for part in common.pieces(batches):
            rows = []
            for text in part.column(1).to_pylist():
                raw = made.encode(text)
                ids = np.frombuffer(raw, "<u4").astype(np.int64)
                rows.append((len(ids), sha(raw).hexdigest(), sha(made.decode(ids)).hexdigest()))
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([part.column(0), *columns], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return common.texts(docs).mapInArrow(run, SCHEMA)


def encode_ids(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """``doc_id, ids array<int>`` of every whole text."""
    spec = docs.sparkSession.sparkContext.broadcast(common.read_bytes(tokenizer_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = coder(spec.value)
        for part in common.pieces(batches):
            ids = [np.frombuffer(made.encode(t), "<i4") for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return common.texts(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode_ids(coded: DataFrame, tokenizer_path: str) -> DataFrame:
    """``doc_id, text`` from ``doc_id, ids``; null ids give null. Unknown ids are an error."""
    spec = coded.sparkSession.sparkContext.broadcast(common.read_bytes(tokenizer_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = coder(spec.value)
        for part in common.pieces(batches):
            text = [None if ids is None else made.decode(np.array(ids, np.int64)).decode() for ids in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(text, pa.string())], ["doc_id", "text"])

    return coded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``op13_backtrack_bpe``: all of ``documents`` by the word-end tokenizer, and back."""
    import public_tokenizers

    return digests(common.table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
