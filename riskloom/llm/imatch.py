"""I-Match document fingerprints over randomised lexicon subsets.

Terms inside a band of inverse document frequency make the lexicon: terms in
at least ``MIN_SHARE`` and at most ``MAX_SHARE`` of all documents (and in two
documents at least). Frequencies are counted exactly, by 64-bit term hash, over
all documents. Sorted distinct lexicon terms are hashed under several random
subsets of the lexicon: ``DRAWS`` random draws, each at ``LEVELS`` nested
sampling rates 1, 1/2, 1/4, ... . A subset's hash is equal for two texts iff
their terms agree inside the subset (up to 16-bit collisions), so the share of
agreeing subsets at sparse rates follows the overlap of the term sets, while
equal texts agree everywhere.

The lexicon is broadcast. A document of d distinct terms adds d to the sum of
all frequencies, and a lexicon term takes ``MIN_SHARE`` of the documents, so
the lexicon holds at most the mean of d over ``MIN_SHARE`` terms of 8 bytes,
however many documents there are (8 MB at 250 distinct terms a document). A
text whose terms all fall outside the band is hashed over all its terms.

Contract: one row per input row, "next" in ascending doc_id (nulls first, ties
by a hash of the text), the last followed by the first. Null texts are empty;
an empty text has the fingerprint without any hash. Likeness of equal
fingerprints is 1, of a fingerprint without hashes and any other 0.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: The band: at least this many documents and this share of them, at most that share.
MIN_DF, MIN_SHARE, MAX_SHARE = 2, 0.00025, 0.02
#: Term counts that a task gathers before it passes them on.
GATHERED = 400_000
DRAWS, LEVELS = 16, 12
#: Subsets with a hash on either side that a level needs to be read on its own.
ENOUGH = 8
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, next_fingerprint string, near_edited double, near_next double"


def words_of(text: str) -> list[str]:
    return text.lower().split()


def term_hash(word: str) -> int:
    return xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass")) or 1


class Hasher:
    """64-bit hashes of words, remembered for frequent ones, and those of a lexicon (sorted hashes), where there is one."""

    def __init__(self, lexicon: np.ndarray | None = None) -> None:
        self.lexicon = lexicon
        self.known = common.BoundedCache(term_hash, 200_000)

    def terms(self, text: str) -> np.ndarray:
        """Sorted distinct term hashes of a text, of those in the lexicon."""
        known = self.known
        found = np.unique(np.array([known[w] for w in set(words_of(text))], np.uint64))
        if self.lexicon is None or not len(found):
            return found
        if not len(self.lexicon):
            return found[:0]
        at = self.lexicon.searchsorted(found)
        return found[self.lexicon.take(at, mode="clip") == found]

    def fingerprint(self, text: str) -> np.ndarray:
        """The hashes of all subsets, over all terms if none is in the lexicon."""
        terms = self.terms(text)
        if not len(terms):
            terms = np.unique(np.array([term_hash(w) for w in set(words_of(text))], np.uint64))
        return subsets(terms)


def frequencies(docs: DataFrame) -> DataFrame:
    """``term, n``: the number of documents of each term (a signed hash), over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        held: list[np.ndarray] = []
        terms, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

        def merged():
            both = np.concatenate([terms, *held])
            weight = np.concatenate([counts, np.ones(len(both) - len(terms), np.int64)])
            held.clear()
            distinct, place = np.unique(both, return_inverse=True)
            return distinct, np.bincount(place, weight, len(distinct)).astype(np.int64)

        def out():
            return pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), pa.array(counts)], ["term", "n"])

        for batch in common.pieces(batches):
            held += [hasher.terms(text) for text in batch.column(0).to_pylist()]
            if sum(map(len, held)) > GATHERED:
                terms, counts = merged()
                if len(terms) > GATHERED:
                    yield out()
                    terms, counts = terms[:0], counts[:0]
        terms, counts = merged()
        yield out()

    return common.texts(docs).select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))


def lexicon(docs: DataFrame) -> np.ndarray:
    """Sorted term hashes inside the band (their number is bounded, see above)."""
    rows = docs.count()
    low, high = max(MIN_DF, math.ceil(MIN_SHARE * rows)), max(MIN_DF, math.floor(MAX_SHARE * rows))
    found = frequencies(docs).where(F.col("n").between(low, high)).select("term").toArrow()
    return np.sort(found.column("term").to_numpy().view(np.uint64))


_SALTS = np.random.default_rng(99).integers(1, 1 << 63, (2, DRAWS), dtype=np.uint64) | np.uint64(1)


def subsets(terms: np.ndarray) -> np.ndarray:
    """DRAWS x LEVELS 16-bit hashes of the sorted distinct terms; 0 for an empty subset."""
    if not len(terms):
        return np.zeros((DRAWS, LEVELS), np.uint16)
    luck = terms[:, None] * _SALTS[0]
    luck ^= luck >> np.uint64(32)
    luck *= _SALTS[1]
    level = np.minimum(LEVELS - 1, 63 - np.log2((luck >> np.uint64(40) | np.uint64(1)).astype(np.float64)).astype(np.int64) - 40)
    value = (terms[:, None] ^ (luck << np.uint64(7))) * np.uint64(0x9E3779B97F4A7C15)
    value ^= value >> np.uint64(29)
    place = level + np.arange(DRAWS) * LEVELS
    # A sum of mixed term hashes stands for the hash of the sorted list: it depends on the set alone.
    low = np.bincount(place.ravel(), (value & np.uint64(0xFFFFFFFF)).ravel().astype(np.float64), DRAWS * LEVELS).reshape(DRAWS, LEVELS)
    some = np.bincount(place.ravel(), minlength=DRAWS * LEVELS).reshape(DRAWS, LEVELS)
    total = np.cumsum(low[:, ::-1], axis=1)[:, ::-1].astype(np.uint64)
    filled = np.cumsum(some[:, ::-1], axis=1)[:, ::-1] > 0
    mixed = total * np.uint64(0xD6E8FEB86659FD93)
    return np.where(filled, (mixed >> np.uint64(32)) % np.uint64(0xFFFF) + np.uint64(1), 0).astype(np.uint16)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of agreeing subsets at the rate where it is highest and enough subsets speak."""
    if np.array_equal(a, b):
        return 1.0
    agree, any_ = ((a == b) & (a != 0)).sum(0), ((a != 0) | (b != 0)).sum(0)
    spoken = any_ >= ENOUGH
    if not spoken.any():
        return float(agree.sum() / max(1, any_.sum()))
    return float((agree[spoken] / any_[spoken]).max())


def edited(text: str, follower: str) -> str:
    """The last half of the text's code points replaced by the first as many of its follower."""
    n = len(text) // 2
    return text[: len(text) - n] + follower[:n]


def compared(text: str, follower: str, hasher: Hasher, own: np.ndarray, following: np.ndarray) -> tuple:
    other = edited(text, follower)
    changed = hasher.fingerprint(other)
    return (
        len(text),
        hashlib.sha256(other.encode("utf-8", "surrogatepass")).hexdigest(),
        own.tobytes().hex(),
        changed.tobytes().hex(),
        following.tobytes().hex(),
        likeness(own, changed),
        likeness(own, following),
    )


OUT = pa.schema(
    [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string())]
    + [("next_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
)


def chained(batches: Iterator[pa.RecordBatch], hasher: Hasher) -> Iterator[pa.RecordBatch]:
    """Rows ``doc_id, text, part`` in order, each compared with its follower; the last row of a part is left to ``bridged``."""
    last = None
    for batch in common.pieces(batches):
        rows = []
        for doc_id, text, part in zip(*(c.to_pylist() for c in batch.columns)):
            mark = hasher.fingerprint(text)
            if last is not None and last[3] == part:
                rows.append((last[0], *compared(last[1], text, hasher, last[2], mark)))
            last = (doc_id, text, mark, part)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), OUT)] if rows else [pa.array([], f.type) for f in OUT], schema=OUT)


def bridged(batches: Iterator[pa.RecordBatch], hasher: Hasher) -> Iterator[pa.RecordBatch]:
    """Rows ``doc_id, text, follower`` compared."""
    for batch in batches:
        rows = []
        for doc_id, text, follower in zip(*(c.to_pylist() for c in batch.columns)):
            rows.append((doc_id, *compared(text, follower, hasher, hasher.fingerprint(text), hasher.fingerprint(follower))))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), OUT)], schema=OUT)


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the columns of ``SCHEMA`` of every row, beside its edited text and the next row."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(lexicon(docs))

    def hasher() -> Hasher:
        chosen = shared.value
        return common.held(chosen, lambda: Hasher(chosen))

    body = common.texts(docs).withColumn("tie", F.xxhash64("text"))
    parts = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    bounds = body.agg(F.percentile_approx("doc_id", [k / parts for k in range(1, parts)], 100 * parts)).first()[0] or []
    bounds = sorted(set(bounds))  # fewer than ``parts`` numbers
    part = F.coalesce(sum((F.col("doc_id") > F.lit(b)).cast("int") for b in bounds) if bounds else F.lit(0), F.lit(0)).alias("part")
    body = body.select("doc_id", "text", "tie", part)
    dealt = body.repartitionByRange(parts, "part").sortWithinPartitions("part", "doc_id", "tie").select("doc_id", "text", "part")
    inner = dealt.mapInArrow(lambda b: chained(b, hasher()), SCHEMA)
    # The first and the last row of each part, by their keys and then with their texts: two rows a part.
    key = F.struct("doc_id", "tie")
    edges = body.groupBy("part").agg(F.min(key).alias("low"), F.max(key).alias("high"))
    order = edges.select("part", "low", "high", F.lead("part").over(Window.orderBy("part")).alias("after"), F.min("part").over(Window.partitionBy(F.lit(0))).alias("least"))
    order = common.cut(order.select("part", "low", "high", F.coalesce("after", "least").alias("after")))
    wanted = order.select(F.explode(F.array("low", "high")).alias("k")).select(F.col("k.doc_id").alias("id"), F.col("k.tie").alias("t")).distinct()
    held = body.join(F.broadcast(wanted), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("tie") == F.col("t")))
    held = common.cut(held.groupBy("doc_id", "tie").agg(F.first("text").alias("text")))
    tails = order.select("high.*", "after").toDF("doc_id", "tie", "after")
    heads = order.select(F.col("part").alias("after"), F.col("low.doc_id").alias("d"), F.col("low.tie").alias("t"))
    texts = held.select(F.col("doc_id").alias("d"), F.col("tie").alias("t"), F.col("text").alias("follower"))
    same = tails["doc_id"].eqNullSafe(held["doc_id"]) & (tails["tie"] == held["tie"])
    waiting = tails.join(held, same).select(tails["doc_id"], "text", "after").join(heads, "after")
    following = waiting["d"].eqNullSafe(texts["d"]) & (waiting["t"] == texts["t"])
    outer = waiting.join(texts, following).select("doc_id", "text", "follower").mapInArrow(lambda b: bridged(b, hasher()), SCHEMA)
    return inner.union(outer)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``op9_imatch``: all of ``documents``."""
    return fingerprints(common.table(spark, sf_dir, "documents"))
