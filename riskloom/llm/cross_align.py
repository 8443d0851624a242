"""Cross-tokenizer alignment through a dictionary of groups.

Two tokenizers cut the same bytes (a space and the text). Offsets where tokens
of both end cut the tokens into groups; a group is its A ids and its B ids. A
corpus repeats few groups very often, so work is done once per distinct group:

1. Encoding (no shuffle): documents are taken in blocks of some MB. A block
   interns its groups in a dictionary of its own and keeps, per document, the
   sorted local numbers of its groups. Both go to a table in the shared folder.
2. The blocks' dictionaries are summed to one of the corpus (occurrences and
   documents by group key; each block has already summed its own). The links
   of each distinct group are expanded once and weighed by the group's count,
   which gives the count of every id pair and the best pair of every B id.
3. What a group is worth goes back by group key to the blocks' dictionaries,
   and from there, block by block, to the documents. A group that every
   document has is one row per block, never one per document.

Texts are encoded in chunks that start at a space after a character that is no
white space: neither the split pattern of A nor a piece of B crosses such a
place (whether B has a piece with an inner space is checked when it is
loaded; if it has, texts are encoded uncut). Distinct chunks are encoded once
by each worker.

Contract: one row per input row. Texts that are null or empty, and those whose
joined token bytes differ from the space and the text (a literal U+2581), have
no tokens: zeros and an empty ``groups_sha256``. Repeated rows and ids give
repeated rows and count again; a null ``doc_id`` stays null; extra columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from collections.abc import Iterator
from itertools import accumulate
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .records import PLAIN, byte_letters

#: A block closes at so many bytes of text or rows.
BLOCK_BYTES, BLOCK_ROWS = 8 << 20, 1 << 16
#: Distinct chunks remembered by one worker in a generation (of two), and the characters of one that is kept at most.
CACHE, LONG = 300_000, 64
#: The split pattern of byte-level BPE (a fixed value).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Links of a group: tokens that end together, or tokens that share a byte.
RULES = ("end", "overlap")
#: Characters that some engine takes for white space, or that are invisible.
BLANK = "\\s\x1c-\x1f\x85\u180e\u200b-\u200d\u2060\ufeff"
CUT = re.compile(f"(?<=[^{BLANK}]) ")
UNSAFE = re.compile(f"^ |[{BLANK}] ")


class Chunk(NamedTuple):
    """A stretch of text encoded by both: its group keys ``a1,a2|b1`` in order, joined by semicolons; no tokens if the bytes differ."""

    joined: str
    n_a: int
    n_b: int


NONE = Chunk("", 0, 0)


class Pair:
    """Both tokenizers, with the bytes of every id."""

    def __init__(self, a_spec: bytes, b_spec: bytes) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_buffer(a_spec)
        self.a.encode_special_tokens = True
        back = {c: b for b, c in byte_letters().items()}
        self.a_bytes = {i: bytes(back[c] for c in t) for t, i in self.a.get_vocab(with_added_tokens=False).items()}
        self.b = SentencePieceProcessor(model_proto=b_spec)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("\u2581", " ").encode() for i, p in enumerate(pieces)]
        self.space = self.b.piece_to_id("\u2581")
        self.separable = not any("\u2581" in p.lstrip("\u2581") for p in pieces)
        self.quick = self._by_rank(json.loads(a_spec)["model"])
        self.young: dict[str, Chunk] = {}
        self.old: dict[str, Chunk] = {}

    def _by_rank(self, model: dict):
        """The same merges in a library that takes ids for ranks (a third of the time); None if A's ids aren't in merge order."""
        n = len(self.a_bytes) - len(model["merges"])
        made = ("".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model["merges"])
        if n != 256 or any(model["vocab"][t] != n + k for k, t in enumerate(made)):
            return None
        import tiktoken

        return tiktoken.Encoding("a", pat_str=SPLIT, mergeable_ranks={t: i for i, t in self.a_bytes.items()}, special_tokens={})

    def ids_a(self, chunk: str) -> list[int]:
        """A's ids of a space and ``chunk``."""
        if self.quick and PLAIN.fullmatch(chunk):
            return self.quick.encode_ordinary(" " + chunk)
        return self.a.encode(" " + chunk, add_special_tokens=False).ids

    def ids_b(self, chunks: list[str]) -> list[list[int]]:
        """B's ids of a space and each chunk."""
        return [ids if c else [self.space] for c, ids in zip(chunks, self.b.encode(chunks, num_threads=1))]

    def joined(self, chunk: str, ids_a: list[int], ids_b: list[int]) -> Chunk:
        raw_a, raw_b = [self.a_bytes[i] for i in ids_a], [self.b_bytes[i] for i in ids_b]
        want = (" " + chunk).encode()
        if b"".join(raw_a) != want or b"".join(raw_b) != want:
            return NONE
        n_a, n_b = len(ids_a), len(ids_b)
        if n_a == 1 or n_b == 1:
            return Chunk(f"{','.join(map(str, ids_a))}|{','.join(map(str, ids_b))}", n_a, n_b)
        ends_a, ends_b = accumulate(map(len, raw_a)), accumulate(map(len, raw_b))
        keys, i, j = [], 0, 0
        while i < n_a:
            first_a, first_b = i, j
            end_a, end_b, i, j = next(ends_a), next(ends_b), i + 1, j + 1
            if end_a == end_b:
                keys.append(f"{ids_a[first_a]}|{ids_b[first_b]}")
                continue
            while end_a != end_b:
                if end_a < end_b:
                    end_a, i = next(ends_a), i + 1
                else:
                    end_b, j = next(ends_b), j + 1
            keys.append(f"{','.join(map(str, ids_a[first_a:i]))}|{','.join(map(str, ids_b[first_b:j]))}")
        return Chunk(";".join(keys), n_a, n_b)

    def whole(self, text: str) -> Chunk:
        return self.joined(text, self.ids_a(text), self.ids_b([text])[0])

    def cut(self, text: str | None) -> list[str]:
        """Chunks of a text, each standing for itself after a space; none of an empty text."""
        if not text:
            return []
        if not self.separable:
            return [text]
        return CUT.split(text) if UNSAFE.search(text) else text.split(" ")

    def learn(self, wanted: set[str]) -> None:
        """All ``wanted`` chunks into the young generation; a full one becomes the old one, whose chunks return on use."""
        if len(self.young) >= CACHE:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        new = []
        for c in wanted - young.keys():
            if c in old:
                young[c] = old[c]
            else:
                new.append(c)
        for c, ids in zip(new, self.ids_b(new)):
            young[c] = self.joined(c, self.ids_a(c), ids)

    def encode(self, texts: list[str | None]) -> list[list[Chunk]]:
        """The chunks of each text; none if it has no tokens."""
        cuts = list(map(self.cut, texts))
        wanted = set().union(*cuts)
        self.learn(wanted)
        out = []
        for text, chunks in zip(texts, cuts):
            found = list(map(self.young.__getitem__, chunks))
            if NONE in found:
                whole = self.whole(text)
                found = [whole] if whole.n_a else []
            out.append(found)
        for c in wanted:
            if len(c) > LONG:
                self.young.pop(c)
        return out


def expand(key: str, a_bytes, b_bytes, rule: str = "end") -> dict[tuple[int, int], int]:
    """Links of one group: how often each (A id, B id) is linked in it."""
    ids_a, ids_b = ([int(x) for x in side.split(",")] for side in key.split("|"))
    ends_a, ends_b = np.cumsum([len(a_bytes[i]) for i in ids_a]).tolist(), np.cumsum([len(b_bytes[i]) for i in ids_b]).tolist()
    links: dict[tuple[int, int], int] = {}
    if rule == "end":
        at_b = dict(zip(ends_b, ids_b))
        pairs = [(i, at_b[e]) for i, e in zip(ids_a, ends_a) if e in at_b]
    else:
        pairs, j = [], 0
        for i, e, start in zip(ids_a, ends_a, [0, *ends_a]):
            while ends_b[j] <= start:
                j += 1
            k = j
            while True:
                pairs.append((i, ids_b[k]))
                if ends_b[k] >= e:
                    break
                k += 1
    for p in pairs:
        links[p] = links.get(p, 0) + 1
    return links


class Codes(dict):
    """Local numbers of a chunk's groups, by the chunk's joined keys."""

    def __init__(self) -> None:
        super().__init__({"": b""})
        self.local: dict[str, int] = {}

    def __missing__(self, joined: str) -> bytes:
        local = self.local
        code = array("I", [local.setdefault(k, len(local)) for k in joined.split(";")]).tobytes()
        if len(joined) <= 16 * LONG:
            self[joined] = code
        return code


class Block:
    """Documents of one block and the dictionary of their groups."""

    def __init__(self, name: int) -> None:
        self.name, self.size = name, 0
        self.codes = Codes()
        self.docs: list[tuple] = []

    def add(self, doc_id: int | None, chunks: list[Chunk], size: int) -> None:
        joined, n_a, n_b = zip(*chunks) if chunks else ((), (), ())
        held = np.sort(np.frombuffer(b"".join(map(self.codes.__getitem__, joined)), "<u4"))
        digest = hashlib.sha256(";".join(joined).encode()).hexdigest() if chunks else ""
        self.docs.append((doc_id, sum(n_a), sum(n_b), digest, held))
        self.size += size

    def full(self) -> bool:
        return self.size >= BLOCK_BYTES or len(self.docs) >= BLOCK_ROWS

    def rows(self) -> Iterator[pa.RecordBatch]:
        n = len(self.docs)
        if n:
            doc_id, n_a, n_b, digest, held = zip(*self.docs)
            yield batch(n, block=[self.name] * n, doc_id=doc_id, n_a=n_a, n_b=n_b, n_groups=list(map(len, held)), groups_sha256=digest, codes=[h.tobytes() for h in held])
        if local := self.codes.local:
            m = len(local)
            every = np.concatenate([d[4] for d in self.docs])
            once = np.concatenate([d[4][np.append(True, np.diff(d[4]) != 0)] if len(d[4]) else d[4] for d in self.docs])
            yield batch(m, block=[self.name] * m, local=range(m), key=list(local), freq=np.bincount(every, minlength=m), docs=np.bincount(once, minlength=m))


CODED = "block long, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, codes binary, local int, key string, freq long, docs long"
KINDS = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
FIELDS = [(name, KINDS[kind]) for name, kind in (f.split() for f in CODED.split(", "))]


def batch(n: int, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f], t) if f in columns else pa.nulls(n, t) for f, t in FIELDS], [f for f, _ in FIELDS])


def specs(spark: SparkSession, a_path: str, b_path: str):
    """The two vocabulary files, broadcast (a few MB whatever the corpus)."""
    return spark.sparkContext.broadcast((common.read_bytes(a_path), common.read_bytes(b_path)))


def pair(shared: tuple[bytes, bytes]) -> Pair:
    return common.held(shared, lambda: Pair(*shared))


def coded(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Document rows and dictionary rows of all blocks, written to the shared folder and read back."""
    spark = docs.sparkSession
    shared = specs(spark, a_path, b_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = pair(shared.value)
        first = TaskContext.get().partitionId() << 32
        block = Block(first)
        for part in common.pieces(batches):
            sizes = common.row_bytes(part).tolist()
            for doc_id, chunks, size in zip(part.column(0).to_pylist(), made.encode(part.column(1).to_pylist()), sizes):
                block.add(doc_id, chunks, size)
                if block.full():
                    yield from block.rows()
                    block = Block(block.name + 1)
        yield from block.rows()

    folder = common.run_folder(spark, "groups") + "/coded"
    common.texts(docs).mapInArrow(run, CODED).write.option("compression", "zstd").parquet(folder)
    return spark.read.schema(CODED).parquet(folder)


def dictionary(table: DataFrame) -> DataFrame:
    """``key, freq, docs`` of every distinct group of the corpus."""
    return table.where("key IS NOT NULL").groupBy("key").agg(F.sum("freq").alias("freq"), F.sum("docs").alias("docs"))


def links(groups: DataFrame, a_path: str, b_path: str, rule: str = "end") -> DataFrame:
    """``key, a, b, n``, with the other columns of ``groups``: the links of each distinct group, expanded once."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    shared = specs(groups.sparkSession, a_path, b_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = pair(shared.value)
        for part in common.pieces(batches, rows=1 << 14):
            rows, a, b, n = [], [], [], []
            for i, key in enumerate(part.column("key").to_pylist()):
                for (x, y), times in expand(key, made.a_bytes, made.b_bytes, rule).items():
                    rows.append(i), a.append(x), b.append(y), n.append(times)
            kept = part.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(n, pa.int64())], [*kept.schema.names, "a", "b", "n"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in groups.schema)
    return groups.mapInArrow(run, f"{fields}, a int, b int, n long")


def pair_counts(linked: DataFrame, weight: str = "freq") -> DataFrame:
    """``a, b, count, best``: links of each id pair weighed by ``freq`` (occurrences) or ``docs`` (documents), and its B id's highest."""
    counts = linked.groupBy("a", "b").agg(F.sum(F.col("n") * F.col(weight)).alias("count"))
    return counts.withColumn("best", F.max("count").over(Window.partitionBy("b")))


def link_counts(docs: DataFrame, a_path: str, b_path: str, rule: str = "end", weight: str = "freq") -> DataFrame:
    """``a, b, count, best`` of the corpus: an id-to-id translation table with its counts."""
    return pair_counts(links(dictionary(coded(docs, a_path, b_path)), a_path, b_path, rule), weight)


def alignments(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """``doc_id, groups array<struct<a, b>>`` of every whole text, in order. No shuffle."""
    shared = specs(docs.sparkSession, a_path, b_path)
    kind = pa.list_(pa.struct([("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))]))

    def sides(key: str) -> dict:
        a, b = key.split("|")
        return {"a": list(map(int, a.split(","))), "b": list(map(int, b.split(",")))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = pair(shared.value)
        for part in common.pieces(batches):
            found = [[sides(k) for c in chunks for k in c.joined.split(";")] for chunks in made.encode(part.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, kind)], ["doc_id", "groups"])

    return common.texts(docs).mapInArrow(run, "doc_id long, groups array<struct<a: array<int>, b: array<int>>>")


RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def summed(left: pa.Table, right: pa.Table) -> pa.Table:
    """Documents of one block and what its groups are worth, by local number."""
    order = np.argsort(right.column("local").to_numpy())
    worth = [right.column(c).to_numpy()[order] for c in ("n_links", "n_best", "count_sum")]
    held = [np.frombuffer(c, "<u4") for c in left.column("codes").to_pylist()]
    columns = {f: left.column(f) for f in ("doc_id", "n_a", "n_b", "n_groups")}
    for name, values in zip(("n_links", "n_best", "count_sum"), worth):
        columns[name] = pa.array([int(values[h].sum()) if len(h) else 0 for h in held], pa.int64())
    return pa.table(columns | {"groups_sha256": left.column("groups_sha256")})


def digests(docs: DataFrame, a_path: str, b_path: str, rule: str = "end", weight: str = "freq") -> DataFrame:
    """Per document: tokens, groups, links, links of the best pair of their B id, the links' counts summed, and the groups' hash."""
    table = coded(docs, a_path, b_path)
    linked = links(dictionary(table), a_path, b_path, rule)
    worth = (
        linked.join(pair_counts(linked, weight), ["a", "b"])
        .groupBy("key")
        .agg(
            F.sum("n").alias("n_links"),
            F.sum(F.when(F.col("count") == F.col("best"), F.col("n")).otherwise(0)).alias("n_best"),
            F.sum(F.col("n") * F.col("count")).alias("count_sum"),
        )
    )
    groups = table.where("key IS NOT NULL").select(F.col("block").alias("of"), "local", "key").join(worth, "key").drop("key")
    bodies = table.where("key IS NULL").select("block", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "codes")
    return bodies.groupBy("block").cogroup(groups.groupBy("of")).applyInArrow(summed, RESULT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``op11_align``: all of ``documents``, byte-level BPE against pieces with byte fallback."""
    import public_tokenizers

    return digests(common.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
