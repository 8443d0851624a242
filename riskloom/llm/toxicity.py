"""Toxicity: subword-bag embeddings averaged into a linear softmax.

A bag holds the character n-grams of a word and its neighbours (``BAG`` words)
and the words themselves; the average of their embeddings goes to a linear
softmax over the two classes. Embeddings and softmax are trained jointly, in
numpy, on whole labelled texts: the label holds for the text, so its bags share
the gradient, first evenly and later by their logits, and the highest bag
answers for it. (One bag over a whole text dilutes a toxic passage by its
length; the README has figures.) An unseen misspelling shares n-gram vectors
with the word it comes from.

The fit sees at most ``MAX_POSITIVE`` and ``MAX_NEGATIVE`` labelled texts of at
most ``MAX_CHARS`` characters, picked by a hash of the id; scoring covers every
bag of every whole text and shuffles nothing.

Contract: one row per input row. A null or empty text, or one without a word,
gets the score of an empty bag. Labels that are null, or repeated with
different values, are left out of the fit. Without both classes among the
labels every score is the share of label 1 (0 without any label).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, subwords

MAX_POSITIVE, MAX_NEGATIVE, MAX_CHARS = 1500, 2500, 60_000
BUCKETS, DIM, ORDERS = 1 << 16, 8, (3, 4, 5)
#: Words of a bag (odd): one and its neighbours to both sides, fewer at the ends of a text.
BAG = 3
EPOCHS, RATE, DECAY = 110, 0.03, 2e-3
SHARP = (0.5, 4.0)
THRESHOLD = 0.7
EDGES = re.compile(r"^[\W_]+|[\W_]+$")


def words_of(text: str) -> list[str]:
    return text.lower().split()


def clean(word: str) -> str:
    return word if word.isalnum() else EDGES.sub("", word)


class Model(NamedTuple):
    """Per n-gram logit contributions (embedding times softmax difference) and the bias."""

    gram: np.ndarray
    bias: float


class Bags:
    """The bags around all words of some texts, given where each text begins (with an end mark)."""

    def __init__(self, start: np.ndarray, bag: int) -> None:
        self.start, self.filled = start, np.flatnonzero(np.diff(start))
        place, size = np.arange(int(start[-1]), dtype=np.int32), np.diff(start)
        half = np.int32(bag // 2)
        self.low = np.maximum(np.repeat(start[:-1].astype(np.int32), size), place - half)
        self.high = np.minimum(np.repeat(start[1:].astype(np.int32), size), place + half + 1)
        self.size = (self.high - self.low).astype(np.float32)

    def means(self, values: np.ndarray) -> np.ndarray:
        """Mean of the values in each word's bag."""
        running = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
        return ((running[self.high] - running[self.low]) / self.size).astype(np.float32)

    def spread(self, shares: np.ndarray) -> np.ndarray:
        """What each word gets if each bag deals its share evenly to its words: the transpose of ``means``."""
        each = shares / self.size
        deltas = np.bincount(self.low, each, len(each) + 1) - np.bincount(self.high, each, len(each) + 1)
        return np.cumsum(deltas)[:-1]

    def highest(self, means: np.ndarray) -> np.ndarray:
        """The highest bag of each text; nan for a text without words."""
        top = np.full(len(self.start) - 1, np.nan)
        if len(self.filled):
            top[self.filled] = np.maximum.reduceat(means, self.start[:-1][self.filled])
        return top


def entropy(y: np.ndarray, z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z) - y * z


def fit(texts: list[str], labels: list[int], seed: int = 7) -> Model:
    """Train embeddings and softmax jointly on whole texts."""
    share = float(np.mean(labels)) if labels else 0.0
    if not 0 < share < 1:
        return Model(np.zeros(BUCKETS, np.float32), -30.0 if share == 0 else 30.0)
    rng = np.random.default_rng(seed)
    vocabulary: dict[str, int] = {}
    rows = []
    for text in texts:  # numbers, not words, are kept of each text
        rows.append(np.array([vocabulary.setdefault(c, len(vocabulary)) for w in words_of(text) if (c := clean(w))], np.int32))
    start = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
    seq = np.concatenate([np.zeros(0, np.int32), *rows])
    bucket, first = subwords.grams(list(vocabulary), ORDERS, BUCKETS, whole=True)
    bucket = bucket.astype(np.int32)
    size = np.maximum(1, np.diff(first)).astype(np.float32)
    y = np.asarray(labels, np.float64)
    held = rng.random(len(y)) < 0.15
    if not held.any() or held.all():
        held = np.arange(len(y)) % 7 == 3
    owner, bags = np.repeat(np.arange(len(y), dtype=np.int32), np.diff(start)), Bags(start, BAG)
    embed = rng.normal(0, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    soft = rng.normal(0, 1, (2, DIM)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (embed, soft, bias)]
    best, kept = np.inf, None
    for epoch in range(1, EPOCHS + 1):
        u = soft[1] - soft[0]
        means = bags.means((subwords.sums(embed @ u, bucket, first) / size)[seq])
        top = np.nan_to_num(bags.highest(means))
        gap = float(bias[1] - bias[0])
        check = float(entropy(y, top + gap)[held].mean())
        if check < best and epoch > EPOCHS // 2:
            best, kept = check, Model((embed @ u).astype(np.float32), gap)
        # The bags of a text share its gradient, first evenly, later the highest bag takes it.
        sharp = SHARP[0] + (SHARP[1] - SHARP[0]) * min(1.0, 2 * epoch / EPOCHS)
        weight = np.exp(np.clip(sharp * (means - top.astype(np.float32)[owner]), -30, 0))
        weight /= np.bincount(owner, weight, len(y)).astype(np.float32)[owner]
        z = np.bincount(owner, weight * means, len(y)) + gap
        d = np.where(held, 0, 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / (~held).sum()
        grad_word = np.bincount(seq, bags.spread(weight * d.astype(np.float32)[owner]), len(vocabulary))
        per_gram = np.bincount(bucket, np.repeat(grad_word / size, np.diff(first)), BUCKETS).astype(np.float32)
        to_u = embed.T @ per_gram
        grads = (np.outer(per_gram, u) + (DECAY / BUCKETS) * embed, np.stack([-to_u, to_u]), np.array([-d.sum(), d.sum()], np.float32))
        for param, grad, m in zip((embed, soft, bias), grads, moments):
            m[0] += 0.1 * (grad - m[0])
            m[1] += 0.01 * (grad * grad - m[1])
            param -= RATE * (m[0] / (1 - 0.9**epoch)) / (np.sqrt(m[1] / (1 - 0.99**epoch)) + 1e-7)
    return kept or Model((embed @ (soft[1] - soft[0])).astype(np.float32), float(bias[1] - bias[0]))


class Scorer:
    """Scores whole texts; keeps the contributions of the words it has met."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.table = subwords.WordTable(self._rows, 1)

    def _rows(self, words: list[str]) -> np.ndarray:
        bucket, first = subwords.grams([clean(w) for w in words], ORDERS, BUCKETS, whole=True)
        return (subwords.sums(self.model.gram, bucket, first) / np.maximum(1, np.diff(first)))[:, None]

    def scores(self, texts: list[str]) -> np.ndarray:
        seq, start = self.table.numbers([words_of(t) for t in texts])
        bags = Bags(start, BAG)
        top = bags.highest(bags.means(self.table.rows[seq, 0]))
        z = np.where(np.isnan(top), 0.0, top) + self.model.bias
        z = np.where(np.isnan(top), np.minimum(z, self.model.bias), z)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def sample(docs: DataFrame, labels: DataFrame) -> tuple[list[str], list[int]]:
    """The bounded training rows: labelled texts outside the held-out fold, picked by a hash of the id."""
    marks = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .where(F.col("toxic").isin(0, 1) & (common.crc_mod("doc_id", 3) != 1))
        .groupBy("doc_id")
        .agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most"))
        .where("toxic = most")
        .drop("most")
    )
    order = [F.xxhash64("doc_id", F.lit(11)), F.col("doc_id")]
    picked = marks.where("toxic = 1").orderBy(*order).limit(MAX_POSITIVE).union(marks.where("toxic = 0").orderBy(*order).limit(MAX_NEGATIVE))
    bodies = common.texts(docs).where(F.length("text") <= MAX_CHARS)
    # at most MAX_POSITIVE + MAX_NEGATIVE ids: bounded, so broadcast; repeated ids give repeated rows, again bounded
    rows = bodies.join(F.broadcast(picked), "doc_id").dropDuplicates(["doc_id"]).orderBy(*order).select("text", "toxic").toPandas()
    return rows["text"].tolist(), rows["toxic"].tolist()


def scorer(shared) -> Scorer:
    """The worker's scorer of a broadcast model."""
    model = shared.value
    return common.held(model, lambda: Scorer(model))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # one float a bucket: fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = scorer(shared)
        for batch in common.pieces(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made.scores(batch.column(1).to_pylist()), pa.float64())], ["doc_id", "score"])

    scored = common.texts(docs).mapInArrow(run, "doc_id long, score double")
    return scored.select(
        "doc_id",
        F.coalesce(common.crc_mod("doc_id", 3) == 1, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``op1_toxicity``: fit on labelled rows outside the held-out fold, score all of ``documents``."""
    docs, labels = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")
    return score(docs, fit(*sample(docs, labels)))
