"""Byte-level BPE encoding and decoding.

Two tiers resolve a pre-token: a minimal perfect hash over the vocabulary
answers pre-tokens that are tokens as they stand; the rest is merged by a heap
of ranked pairs over linked byte spans. Texts are cut at single spaces first
(a place where no match of the pattern can cross), so the pattern runs once
per distinct chunk rather than once per occurrence.

Contract: one row per input row. A null text is the empty text: no tokens,
the hash of the empty string. Repeated rows give repeated results; a null
``doc_id`` stays null; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession

from . import common

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
#: Distinct chunks remembered by one worker.
CACHE = 250_000
#: A run of white space that a cut at single spaces would change.
UNSAFE = re.compile(r"\s \s|\s \Z")


class MinimalPerfectHash:
    """Hash-and-displace over a fixed key set: n keys, n slots, no collisions.

    Keys are dealt to buckets; buckets of several keys get the first
    displacement that puts all of them on free slots, single keys take a free
    slot outright (stored as a negative number). ``get`` compares the stored
    key, so foreign keys are told apart.
    """

    def __init__(self, keys: list[bytes], values: list[int]) -> None:
        n = self.n = max(1, len(keys))
        self.buckets = max(1, n // 2)
        hashed = np.array([xxhash.xxh64_intdigest(k) for k in keys], np.uint64)
        order: list[list[int]] = [[] for _ in range(self.buckets)]
        for i, h in enumerate(hashed.tolist()):
            order[h % self.buckets].append(i)
        taken = np.zeros(n, bool)
        slot_of = np.zeros(len(keys), np.int64)
        self.shift = [0] * self.buckets
        singles = []
        for b in sorted(range(self.buckets), key=lambda b: -len(order[b])):
            members = order[b]
            if len(members) < 2:
                if members:
                    singles.append(b)
                continue
            h = hashed[members]
            d = 1
            while True:
                slots = self._slots(h, d)
                if len(set(slots.tolist())) == len(members) and not taken[slots].any():
                    break
                d += 1
            taken[slots] = True
            slot_of[members] = slots
            self.shift[b] = d
        free = iter(np.flatnonzero(~taken).tolist())
        for b in singles:
            slot = next(free)
            slot_of[order[b][0]] = slot
            self.shift[b] = -slot - 1
        self.keys: list[bytes | None] = [None] * n
        self.values = [0] * n
        for i, s in enumerate(slot_of.tolist()):
            self.keys[s], self.values[s] = keys[i], values[i]

    def _slots(self, h: np.ndarray, d: int) -> np.ndarray:
        mixed = (h ^ np.uint64((d * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xD6E8FEB86659FD93)
        return ((mixed >> np.uint64(20)) % np.uint64(self.n)).astype(np.int64)

    def get(self, key: bytes) -> int:
        """The value of ``key``, -1 if it isn't one of the keys."""
        h = xxhash.xxh64_intdigest(key)
        d = self.shift[h % self.buckets]
        if d < 0:
            slot = -d - 1
        else:
            mixed = ((h ^ ((d * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)) * 0xD6E8FEB86659FD93) & 0xFFFFFFFFFFFFFFFF
            slot = (mixed >> 20) % self.n
        return self.values[slot] if self.keys[slot] == key else -1


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a pre-token that is no token itself: lowest rank first, leftmost on ties."""
    n = len(piece)
    end = list(range(1, n + 1))  # end[i]: where the span that starts at i ends; 0 once it is swallowed
    before = list(range(-1, n - 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, e = heapq.heappop(heap)
        j = end[i]
        if not j or j >= n or end[j] != e:
            continue  # one of its two spans has changed since
        end[i], end[j] = e, 0
        if e < n:
            before[e] = i
            if (r := ranks.get(piece[i : end[e]])) is not None:
                heapq.heappush(heap, (r, i, end[e]))
        if (p := before[i]) >= 0 and (r := ranks.get(piece[p:e])) is not None:
            heapq.heappush(heap, (r, p, e))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class ByteBpe:
    """Encoder and decoder for a rank file and a pre-token pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, whole: MinimalPerfectHash | None = None) -> None:
        self.ranks = ranks
        self.pattern = regex.compile(pattern)
        self.whole = whole or MinimalPerfectHash(list(ranks), list(ranks.values()))
        self.bytes_of = {str(i): b for b, i in self.ranks.items()}
        self.pieces = common.BoundedCache(self._piece, CACHE // 2)
        self.chunks = common.BoundedCache(self._chunk, CACHE)

    def _piece(self, piece: str) -> str:
        raw = piece.encode("utf-8", "surrogatepass")
        found = self.whole.get(raw)
        return str(found) if found >= 0 else ",".join(map(str, merge(raw, self.ranks)))

    def _chunk(self, chunk: str) -> str:
        return self.run(" " + chunk)

    def run(self, text: str) -> str:
        """Decimal ids of a stretch of text, matched by the pattern as a whole."""
        return ",".join([self.pieces[m] for m in self.pattern.findall(text)])

    def encode_joined(self, text: str) -> str:
        """Decimal ids of a whole text, joined by commas."""
        if not text:
            return ""
        if UNSAFE.search(text):
            return self.run(text)
        first, *rest = text.split(" ")
        if not rest:
            return self.run(first)
        chunks = self.chunks
        tail = ",".join([chunks[c] for c in rest])
        return f"{self.run(first)},{tail}" if first else tail

    def encode(self, text: str) -> list[int]:
        joined = self.encode_joined(text)
        return [int(x) for x in joined.split(",")] if joined else []

    def decode_joined(self, joined: str) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, joined.split(","))) if joined else b""

    def decode(self, ids: list[int]) -> bytes:
        return b"".join([self.bytes_of[str(i)] for i in ids])


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks by token from a rank file (its size is fixed by the vocabulary)."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, common.read_bytes(path).splitlines()) if a}


class Vocabulary(NamedTuple):
    """What the executors need; made on the driver and broadcast, a few MB."""

    ranks: dict[bytes, int]
    whole: MinimalPerfectHash
    pattern: str


_vocabularies: dict[tuple[str, str], Vocabulary] = {}


def vocabulary(path: str, pattern: str) -> Vocabulary:
    if (path, pattern) not in _vocabularies:
        ranks = read_ranks(path)
        _vocabularies[path, pattern] = Vocabulary(ranks, MinimalPerfectHash(list(ranks), list(ranks.values())), pattern)
    return _vocabularies[path, pattern]


def coder(made: Vocabulary) -> ByteBpe:
    """The worker's coder, made once for a broadcast vocabulary."""
    return common.held(made, lambda: ByteBpe(made.ranks, made.pattern, made.whole))


def digests(docs: DataFrame, rank_path: str, pattern: str) -> DataFrame:
    """Token counts and hashes of ids and decoded bytes of every whole text. No shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary(rank_path, pattern))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(shared.value)
        sha = hashlib.sha256
        for batch in common.pieces(batches):
            counts, ids_hash, back_hash = [], [], []
            for text in batch.column(1).to_pylist():
                joined = bpe.encode_joined(text)
                counts.append(joined.count(",") + 1 if joined else 0)
                ids_hash.append(sha(joined.encode("ascii")).hexdigest())
                back_hash.append(sha(bpe.decode_joined(joined)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(back_hash, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return common.texts(docs).mapInArrow(run, SCHEMA)


def encode_ids(docs: DataFrame, rank_path: str, pattern: str) -> DataFrame:
    """``doc_id, ids array<int>`` of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary(rank_path, pattern))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(shared.value)
        for batch in common.pieces(batches):
            ids = pa.array([bpe.encode(t) for t in batch.column(1).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], ["doc_id", "ids"])

    return common.texts(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode_ids(coded: DataFrame, rank_path: str, pattern: str) -> DataFrame:
    """``doc_id, raw binary`` from ``doc_id, ids``; null ids give null."""
    shared = coded.sparkSession.sparkContext.broadcast(vocabulary(rank_path, pattern))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(shared.value)
        for batch in common.pieces(batches):
            raw = [None if ids is None else bpe.decode(ids) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], ["doc_id", "raw"])

    return coded.select("doc_id", "ids").mapInArrow(run, "doc_id long, raw binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``op4_byte_bpe``: all of ``documents`` by the multilingual rank file."""
    import public_tokenizers

    return digests(common.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
