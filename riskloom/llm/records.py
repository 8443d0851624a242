"""Token-ID output as length-delimited binary records, with an offset index.

A record file is a sequence of frames: the payload's length (unsigned 64-bit,
little-endian), a masked checksum of those eight bytes, the payload, and a
masked checksum of the payload. The checksum is CRC-32 (the C implementation
that ships with Python), masked by a rotation of 15 bits and an added
constant, so that stored checksums of checksums stay apart. A payload is one
serialised sequence: ``doc_id`` (signed 64-bit), flags (1: the id is null; 2:
wide) and the ids, unsigned, little-endian, of 16 bits each where the whole
vocabulary and the end id fit, else (wide) of 32. Beside every record file stands an index
file of (offset, payload length) pairs, one per record, for shuffled reads.

Documents are dealt by ranges of ``doc_id`` (ties by a hash of the text, so a
repeated id may span files), sorted, and written under a run's own folder in
the shared storage: each task attempt writes its own file names, and the
files of the attempts that succeeded make the manifest, so a lost executor or
a speculative twin leaves an unlisted file at most. Files close at
``FILE_BYTES``, which bounds what a reader holds.

Tokenization is that of the library's tokenizer file; strings of its special
tokens in texts become their ids, as the library has it. With the known
normalizer and split pattern text is encoded by space-delimited chunks, each
distinct chunk once (white space is dropped, so no token spans it); chunks of
plain Latin letters take the model of the library directly, everything else
its whole pipeline. Any other tokenizer file encodes whole texts.

Contract: one row per input row. A null text is the empty text (its only id is
the end id). Null doc_ids sort first. Repeated rows are repeated records.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

END_ID = 2
FILE_BYTES = 16 << 20
FRAME = struct.Struct("<QI")
#: Manifests of up to this many files are broadcast (about 100 bytes a file).
BROADCAST_FILES = 100_000
HEAD = struct.Struct("<qI")
TAIL = struct.Struct("<I")
ENTRY = np.dtype([("offset", "<u8"), ("length", "<u8")])
MASK_DELTA = 0xA282EAD8
CACHE = 350_000


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK_DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return b"".join([length, TAIL.pack(masked(length)), payload, TAIL.pack(masked(payload))])


def serialise(doc_id: int | None, ids: bytes, wide: bool) -> bytes:
    return HEAD.pack(doc_id or 0, (doc_id is None) | wide << 1) + ids


def restored(payload: memoryview) -> tuple[int | None, np.ndarray]:
    """(doc_id, ids as little-endian unsigned 32-bit integers) of a payload."""
    doc_id, flags = HEAD.unpack_from(payload)
    ids = np.frombuffer(payload, "<u4" if flags & 2 else "<u2", offset=HEAD.size).astype("<u4")
    return None if flags & 1 else doc_id, ids


def frames(data: bytes | pa.Buffer) -> Iterator[tuple[int, memoryview]]:
    """(offset, payload) of each record; raises ValueError on a damaged file."""
    view, at = memoryview(data), 0
    while at < len(view):
        length, crc = FRAME.unpack_from(view, at)
        if masked(bytes(view[at : at + 8])) != crc:
            raise ValueError(f"damaged length at {at}")
        payload = view[at + FRAME.size : at + FRAME.size + length]
        if len(payload) != length or TAIL.unpack_from(view, at + FRAME.size + length)[0] != masked(payload):
            raise ValueError(f"damaged record at {at}")
        yield at, payload
        at += FRAME.size + length + TAIL.size


def record(uri: str, index_uri: str, number: int) -> tuple[int | None, np.ndarray]:
    """(doc_id, ids) of one record by its number, through the index: a shuffled read of two short ranges."""
    fs, path = pafs.FileSystem.from_uri(index_uri)
    with fs.open_input_file(path) as f:
        offset, length = np.frombuffer(f.read_at(ENTRY.itemsize, number * ENTRY.itemsize), ENTRY)[0].tolist()
    fs, path = pafs.FileSystem.from_uri(uri)
    with fs.open_input_file(path) as f:
        raw = f.read_at(FRAME.size + length + TAIL.size, offset)
    (_, payload), *_ = frames(raw)
    return restored(payload)


class Files:
    """Record and index files of one task, closed at ``FILE_BYTES``."""

    def __init__(self, folder: str, part: int, size: int = FILE_BYTES) -> None:
        self.fs, self.folder = pafs.FileSystem.from_uri(folder)
        self.part, self.size, self.attempt = part, size, uuid.uuid4().hex[:12]
        self.number, self.out = 0, None

    def add(self, payload: bytes, count: int) -> Iterator[dict]:
        if self.out is None:
            self.name = f"{self.folder}/part-{self.part:06d}-{self.number:05d}-{self.attempt}"
            self.fs.create_dir(self.folder, recursive=True)
            self.out, self.offset, self.entries, self.tokens = self.fs.open_output_stream(self.name + ".rec"), 0, [], 0
        raw = frame(payload)
        self.out.write(raw)
        self.entries.append((self.offset, len(payload)))
        self.offset += len(raw)
        self.tokens += count
        if self.offset >= self.size:
            yield from self.close()

    def close(self) -> Iterator[dict]:
        if self.out is None:
            return
        self.out.close()
        with self.fs.open_output_stream(self.name + ".idx") as index:
            index.write(np.array(self.entries, ENTRY).tobytes())
        yield {"file": os.path.basename(self.name) + ".rec", "part": self.part, "number": self.number, "records": len(self.entries), "tokens": self.tokens}
        self.number, self.out = self.number + 1, None


MANIFEST = "file string, part int, number int, records long, tokens long"
#: Letters of the Latin blocks, all composed: for text of these (and ASCII) the normalizer is lower case alone.
PLAIN = re.compile(r"[\x21-\x7e¡-ɏ]+")
#: What these blocks have that the two regex engines class differently.
APART = re.compile(r"[_²³¹¼½¾]|<\|")
PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|[0-9]|[^\w\s]+")
CLOSING = frozenset(",.;:!?")
#: The split pattern and normalizers (fixed values) for which chunks may be encoded apart.
KNOWN_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
KNOWN_FORMS = ["NFC", "Replace", "Lowercase"]


def known_split(file: dict) -> bool:
    """Whether a tokenizer file lower-cases, drops white space and splits by the known pattern, with plain special tokens."""
    try:
        split, levels = file["pre_tokenizer"]["pretokenizers"]
        forms = [n["type"] for n in file["normalizer"]["normalizers"]]
        plain = not any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in file["added_tokens"])
        return plain and split["pattern"]["Regex"] == KNOWN_SPLIT and levels["type"] == "ByteLevel" and not levels["use_regex"] and forms == KNOWN_FORMS
    except (KeyError, TypeError, ValueError):
        return False


def byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on."""
    stay = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(stay)]
    return {b: chr(b) for b in stay} | {b: chr(256 + i) for i, b in enumerate(rest)}


class ChunkEncoder:
    """Encodes whole texts through a cache of space-delimited chunks."""

    def __init__(self, spec: bytes) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_buffer(spec)
        self.known = known_split(json.loads(spec))
        self.model = self.tokenizer.model
        self.letters = byte_letters()
        self.wide = self.tokenizer.get_vocab_size() > 1 << 16
        self.code = "I" if self.wide else "H"
        self.parts = common.BoundedCache(self._part, CACHE)
        self.chunks = common.BoundedCache(self._chunk, CACHE)

    def _whole(self, text: str) -> bytes:
        return array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _part(self, part: str) -> bytes:
        spelt = part if part.isascii() else part.encode().decode("latin-1").translate(self.letters)
        return array(self.code, [t.id for t in self.model.tokenize(spelt)]).tobytes()

    def _chunk(self, chunk: str) -> bytes:
        if chunk.isascii() and chunk.isalpha():
            return self._part(chunk.lower())
        if chunk[-1:] in CLOSING and chunk[:-1].isascii() and chunk[:-1].isalpha():
            return self.chunks[chunk[:-1]] + self.parts[chunk[-1]]
        if not chunk:
            return b""
        if not PLAIN.fullmatch(chunk) or APART.search(chunk):
            return self._whole(chunk)
        return b"".join([self.parts[p] for p in PARTS.findall(chunk.lower())])

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned integers of 16 or (``wide``) 32 bits."""
        if not self.known or "<|" in text:
            return self._whole(text)
        if text.isascii():
            text = text.lower()
        chunks = self.chunks
        return b"".join([chunks[c] for c in text.replace("\n", " ").split(" ")])


def encoder(spec: bytes) -> ChunkEncoder:
    """The worker's encoder, made once for a broadcast tokenizer file."""
    return common.held(spec, lambda: ChunkEncoder(spec))


def write(docs: DataFrame, tokenizer_path: str, folder: str, end_id: int = END_ID) -> DataFrame:
    """Write all of ``docs`` as record files into ``folder`` (a URI all executors reach); returns the manifest, already computed."""
    spark = docs.sparkSession
    spec = spark.sparkContext.broadcast(common.read_bytes(tokenizer_path))
    parts = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, files = encoder(spec.value), None
        wide, tail = made.wide or end_id >> 16 > 0, array(made.code, [end_id]).tobytes()
        if wide != made.wide:
            raise ValueError("the end id doesn't fit beside the vocabulary's ids")
        done: list[dict] = []
        for batch in common.pieces(batches):
            part = batch.column(2)[0].as_py()
            files = files or Files(folder, part)
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = made.encode(text) + tail
                done += files.add(serialise(doc_id, ids, wide), len(ids) // (4 if wide else 2))
        if files:
            done += files.close()
        yield pa.RecordBatch.from_pylist(done, schema=pa.schema([("file", pa.string()), ("part", pa.int32()), ("number", pa.int32()), ("records", pa.int64()), ("tokens", pa.int64())]))

    tie = F.xxhash64("text")
    ranged = common.texts(docs).withColumn("tie", tie).repartitionByRange(parts, "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    return common.cut(ranged.select("doc_id", "text", F.spark_partition_id().alias("part")).mapInArrow(run, MANIFEST))


def parsed(content: pa.Buffer, base: int) -> pa.RecordBatch:
    """One row per record of a file; ``base`` is the number of ids before it."""
    ids, starts, sizes, crcs = [], [], [], []
    for _, payload in frames(content):
        doc_id, body = restored(payload)
        ids.append(doc_id)
        starts.append(base)
        sizes.append(len(body))
        crcs.append(zlib.crc32(body))
        base += sizes[-1]
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (ids, starts, sizes, crcs)], ["doc_id", "start", "n_tokens", "ids_crc32"])


def read(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every record of the manifest's files, read back from them.

    ``start`` counts the ids of all records before, in file order. The sums
    over files run over one row per ``FILE_BYTES`` of ids.
    """
    before = F.sum("tokens").over(Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1))
    listed = manifest.select("file", F.coalesce(before, F.lit(0)).alias("base"))
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.rec").load(folder)
    found = raw.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    # One short row per FILE_BYTES of ids; beyond BROADCAST_FILES of them the contents are shuffled instead.
    if manifest.count() <= BROADCAST_FILES:
        listed = F.broadcast(listed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content, base in zip(batch.column(0), batch.column(1).to_pylist()):
                yield parsed(content.as_buffer(), base)

    return found.join(listed, "file").select("content", "base").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``op2_records``: all of ``documents`` by the word-end tokenizer, written and read back."""
    import public_tokenizers

    folder = common.run_folder(spark, "records")
    manifest = write(common.table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), folder)
    if manifest.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    return read(spark, folder, manifest)
