"""SimHash near-duplicate groups with pigeonring candidate filtering.

A fingerprint sets each bit that is set in over half of the XXH64 hashes of a
text's word shingles. Two fingerprints link at Hamming distance ``TAU`` or
less. With the 64 bits cut into a ring of ``SEGMENTS`` parts, the pigeonring
principle says that a linked pair has a start on the ring from which every
chain of l consecutive parts differs in at most floor(l * TAU / SEGMENTS)
bits. The longest chain whose budget is still zero is an equality key, so
candidates come from an equi-join; the longer chains prune candidates before
the full Hamming check.

Keys that many distinct fingerprints share (near copies by the thousand) are
not paired: their members go to an exact linear form, where every fingerprint
is filed under itself and its 64 one-bit neighbours. Two fingerprints within
distance 2 share a file, two in a file are within 2, and a file holds at most
65 distinct fingerprints, so a star per file keeps every connection.

Contract: one row per input row. Null and empty texts have fingerprint zero
and link like any other; repeated rows give repeated results; a null
``doc_id`` gets the smallest non-null id of its group (null if it has none).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .graph import components

TAU = 2
#: Parts of the ring; 5 gives keys of two parts, 25 or 26 bits.
SEGMENTS = 5
#: A key with more distinct fingerprints than this takes the linear form.
CROWD = 48
SHINGLE = 3
#: Shingles of a text whose bits are counted at once.
BLOCK = 1 << 14


def fingerprint(text: str, size: int = SHINGLE) -> int:
    """The fingerprint of one text, as an unsigned integer."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    if len(words) <= size:
        return xxhash.xxh64_intdigest(b" ".join(words), 42)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[: -size] + 1).tolist()]
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    stops = ends[size - 1 :].tolist()
    for at in range(0, len(starts), BLOCK):
        hashes = np.array([digest(joined[s:e], 42) for s, e in zip(starts[at : at + BLOCK], stops[at : at + BLOCK])], ">u8")
        counts += np.unpackbits(hashes.view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(starts)).tobytes(), "big")


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def row_keys() -> list[Column]:
    """Two hashes of a row's id and text: together 128 bits that tell rows apart."""
    return [F.xxhash64("text", "doc_id"), F.xxhash64(F.lit(29), "doc_id", "text")]


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """``doc_id, fp`` (the 64 bits as a signed long) and the row's keys ``k1, k2`` of every whole text. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.pieces(batches):
            found = [signed(fingerprint(t, size)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64()), batch.column(2), batch.column(3)], ["doc_id", "fp", "k1", "k2"])

    one, two = row_keys()
    return common.texts(docs).select("doc_id", "text", one.alias("k1"), two.alias("k2")).mapInArrow(run, "doc_id long, fp long, k1 long, k2 long")


def ring(segments: int = SEGMENTS) -> list[tuple[int, int]]:
    """(first bit, bits) of each part."""
    edges = [round(i * 64 / segments) for i in range(segments + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def chain_masks(segments: int = SEGMENTS) -> list[list[int]]:
    """For each start, the masks of the chains of 1, 2, ... consecutive parts (signed 64-bit)."""
    masks = [((1 << n) - 1) << a for a, n in ring(segments)]
    return [[signed(sum(masks[(s + k) % segments] for k in range(length))) for length in range(1, segments + 1)] for s in range(segments)]


def passes_ring(difference: Column, segments: int, tau: int) -> Column:
    """Whether some start has all its chains within their proportional budgets."""
    starts = []
    for chains in chain_masks(segments):
        within = F.lit(True)
        for length, mask in enumerate(chains, 1):
            within = within & (F.bit_count(difference.bitwiseAND(F.lit(mask))) <= length * tau // segments)
        starts.append(within)
    out = starts[0]
    for s in starts[1:]:
        out = out | s
    return out


def links(fps: DataFrame, segments: int = SEGMENTS, tau: int = TAU, crowd: int = CROWD) -> DataFrame:
    """Edges ``a, b`` that connect all fingerprints (column ``fp``, distinct) at distance ``tau`` or less.

    Every edge is a true link or, under a crowded key, a step between two
    fingerprints of one file; connectivity is that of all links.
    """
    if tau > 2:
        raise ValueError("the linear form files one-bit neighbours, which is exact up to distance 2")
    free = max(length for length in range(1, segments + 1) if length * tau < segments)
    keys = [
        F.struct(F.lit(s).alias("start"), F.col("fp").bitwiseAND(F.lit(chains[free - 1])).alias("bits"))
        for s, chains in enumerate(chain_masks(segments))
    ]
    filed = fps.select("fp", F.explode(F.array(*keys)).alias("k")).select("fp", "k.start", "k.bits")
    sizes = filed.groupBy("start", "bits").agg(F.count("*").alias("n")).where("n > 1")
    grouped = filed.join(sizes, ["start", "bits"])
    few = common.cut(grouped)
    small, large = few.where(F.col("n") <= crowd), few.where(F.col("n") > crowd)
    left, right = small.select("start", "bits", F.col("fp").alias("a")), small.select("start", "bits", F.col("fp").alias("b"))
    difference = F.col("a").bitwiseXOR(F.col("b"))
    pairs = (
        left.join(right, ["start", "bits"])
        .where(F.col("a") < F.col("b"))
        .where(passes_ring(difference, segments, tau))
        .where(F.bit_count(difference) <= tau)
        .select("a", "b")
    )
    crowded = large.select("fp").distinct()
    flips = [F.col("fp")] + [F.col("fp").bitwiseXOR(F.lit(signed(1 << i))) for i in range(64)]
    stars = (
        crowded.select("fp", F.explode(F.array(*flips)).alias("file"))
        .groupBy("file")
        .agg(F.collect_list("fp").alias("members"))  # at most 65 distinct fingerprints
        .where(F.size("members") > 1)
        .select(F.array_min("members").alias("a"), F.explode("members").alias("b"))
        .where("a <> b")
    )
    return pairs.union(stars)


def labelled(firsts: DataFrame) -> DataFrame:
    """``firsts``, one row per fingerprint ``fp``, with ``label``: the same for all fingerprints of a group."""
    labels = components(links(firsts.select("fp")))
    return firsts.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))


def groups(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """``doc_id, fp, label, component_id`` of every row; ``label`` names the group whether or not it has an id."""
    marked = common.cut(fingerprints(docs, size).select("doc_id", "fp"))
    named = labelled(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    smallest = named.groupBy("label").agg(F.min("first_id").alias("component_id"))
    by_fp = common.cut(named.join(smallest, "label").select("fp", "label", "component_id"))
    return marked.join(by_fp, "fp", "left").select("doc_id", "fp", "label", "component_id")


def near_duplicates(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """``doc_id, fingerprint, component_id``."""
    hexed = F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint")
    return groups(docs, size).select("doc_id", hexed, "component_id")


def keep_one(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """One row of ``docs`` per group, with all its columns: the one with the smallest id.

    Rows are told apart by id and text, so a repeated id on different texts
    keeps one row in each of its groups. Of equal ids in a group the text
    with the smallest hash stays, of rows equal in both any one; a row without
    an id stays only where its whole group has none. Columns may have any
    names. The choice is made on hashes; whole rows are shuffled once, after
    rows equal in id and text have been made one on the map side.
    """
    marked = common.cut(fingerprints(docs, size))
    order = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "k1", "k2")
    chosen = labelled(marked.groupBy("fp").agg(F.min(order).alias("first"))).groupBy("label").agg(F.min("first").alias("first"))
    one, two = (_unused(docs, stem) for stem in ("key_one", "key_two"))
    keys = common.cut(chosen.select(F.col("first.k1").alias(one), F.col("first.k2").alias(two)))
    # The keys are those of texts(): ids as longs, null texts empty.
    body, doc_id = F.coalesce(F.col("text").cast("string"), F.lit("")), F.col("doc_id").cast("long")
    rows = docs.withColumns({one: F.xxhash64(body, doc_id), two: F.xxhash64(F.lit(29), doc_id, body)})
    return rows.dropDuplicates([one, two]).join(keys, [one, two], "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])


def _unused(docs: DataFrame, stem: str) -> str:
    """A column name that ``docs`` doesn't have."""
    taken = {c.lower() for c in docs.columns}
    while stem in taken:
        stem += "_"
    return stem


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``op7_simhash``: groups of all of ``documents``."""
    return near_duplicates(common.table(spark, sf_dir, "documents"))
