"""Language identification by error-correcting output codes.

Every language has a codeword; one binary classifier per bit, linear in
hashed character n-grams, predicts that bit. Decoding sums, over the bits, the
logistic loss of each classifier's margin against the codeword, weighted by
how reliable the bit was on texts kept out of the fit; the codeword with the
least loss wins, and a lead below ``CLEAR`` over the next one is flagged as
ambiguous.

The fit sees snippets of about ``PER_LANG`` texts of each language, fewer
where the languages are so many that these would exceed ``MAX_TEXTS`` (texts
of at most ``MAX_CHARS`` characters, picked by a hash of the id); no language
is left out, and only the snippets come to the driver. Prediction reads every
whole text, adds up in blocks of words and shuffles nothing.

Contract: one row per input row. A null text, or one without a letter, is
``und`` with score 0. Null languages are left out of the fit; without any
language to learn, every text is ``und``. With one language, every text with a
letter gets it, with score 1.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, subwords

PER_LANG, MAX_TEXTS, MAX_CHARS = 500, 20_000, 60_000
BUCKETS, ORDERS = 1 << 15, (1, 2, 3)
#: Words of a training snippet and snippets of a text; scores are linear, so snippets train what whole texts use.
SNIPPET, SNIPPETS = 30, 3
#: Characters of a snippet that reach the driver; a longer one ends at the word before, or in its only word.
SNIPPET_CHARS = 1000
#: Words whose numbers are added up at once, and bytes of numbers kept by word.
BLOCK, TABLE_BYTES = 1 << 16, 16 << 20
EPOCHS, RATE = 4, 0.5
#: The least lead of the best over the second class's probability.
CLEAR = 0.1
UNKNOWN = "und"


class Model(NamedTuple):
    langs: list[str]
    code: np.ndarray  # language x bit, +1 or -1
    weight: np.ndarray  # bucket x bit
    bias: np.ndarray
    trust: np.ndarray  # of each bit


def codewords(classes: int, seed: int = 3) -> np.ndarray:
    """All distinct splits for up to 7 classes; beyond, the random dense code with the largest least distance of 50 draws."""
    if classes < 2:
        return np.zeros((classes, 0), np.int8)
    if classes <= 7:
        columns = range(1, 1 << (classes - 1))
        return np.array([[1 if c == 0 or not col >> (c - 1) & 1 else -1 for col in columns] for c in range(classes)], np.int8)
    rng, bits = np.random.default_rng(seed), int(np.ceil(10 * np.log2(classes)))
    best, most = None, -1
    for _ in range(50):
        code = rng.choice(np.array([-1, 1], np.int8), (classes, bits))
        apart = (bits - code.astype(int) @ code.T.astype(int)) // 2
        least = int(apart[~np.eye(classes, dtype=bool)].min())
        if least > most:
            best, most = code, least
    return best


def letters(word: str) -> str:
    return word if word.isalpha() else "".join(filter(str.isalpha, word))


def words_of(text: str | None) -> list[str]:
    return (text or "").lower().split()


def snippets(text: str | None, rng: np.random.Generator) -> list[list[str]]:
    """Up to ``SNIPPETS`` runs of words with letters of a text, anywhere in it; a short text is one."""
    ws = [x for w in words_of(text) if (x := letters(w))]
    found = []
    for _ in range(SNIPPETS if len(ws) > SNIPPET else 1 if ws else 0):
        at = int(rng.integers(0, max(1, len(ws) - SNIPPET + 1)))
        found.append(ws[at : at + SNIPPET])
    return found


def shortened(words: list[str], chars: int = SNIPPET_CHARS) -> str:
    """The words, joined, as far as they fit into ``chars`` characters."""
    joined = " ".join(words)
    if len(joined) <= chars:
        return joined
    return joined[:chars].rpartition(" ")[0] or joined[:chars]


def fit(texts: list[str], langs: list[str], seed: int = 5) -> Model:
    """One logistic classifier per bit, by AdaGrad over snippets of whole texts."""
    names = sorted(set(langs))
    code = codewords(len(names))
    bits = code.shape[1]
    weight, bias = np.zeros((BUCKETS, bits), np.float32), np.zeros(bits, np.float32)
    if not bits:
        return Model(names, code, weight, bias, np.zeros(0))
    rng, rows, target = np.random.default_rng(seed), [], []
    number = {n: i for i, n in enumerate(names)}
    for text, lang in zip(texts, langs):
        for ws in snippets(text, rng):
            rows.append(ws)
            target.append(number[lang])
    if not rows:
        return Model([], code[:0], weight, bias, np.zeros(bits))
    y = code[np.asarray(target)].astype(np.float32)
    order = rng.permutation(len(rows))
    checked, order = order[: len(rows) // 10], order[len(rows) // 10 :]
    slope, slope_b = np.full_like(weight, 1e-6), np.full_like(bias, 1e-6)

    def features(ids):
        flat = [w for i in ids for w in rows[i]]
        bucket, first = subwords.grams(flat, ORDERS, BUCKETS)
        per = np.repeat(np.arange(len(ids)), [len(rows[i]) for i in ids])
        doc = np.repeat(per, np.diff(first))
        return bucket, doc, 1.0 / np.bincount(doc, minlength=len(ids))

    def margins(bucket, doc, scale):
        return np.stack([np.bincount(doc, weight[bucket, b], len(scale)) for b in range(bits)], 1) * scale[:, None] * 10 + bias

    for _ in range(EPOCHS):
        rng.shuffle(order)
        for at in range(0, len(order), 128):
            ids = order[at : at + 128]
            bucket, doc, scale = features(ids)
            f = margins(bucket, doc, scale)
            d = -y[ids] / (1 + np.exp(np.clip(y[ids] * f, -30, 30))) / len(ids)
            for b in range(bits):
                g = np.bincount(bucket, (d[:, b] * scale * 10)[doc], BUCKETS).astype(np.float32)
                slope[:, b] += g * g
                weight[:, b] -= RATE * g / np.sqrt(slope[:, b])
            gb = d.sum(0)
            slope_b += gb * gb
            bias -= RATE * gb / np.sqrt(slope_b)
    trust = np.ones(bits)
    if len(checked):
        right = (np.sign(margins(*features(checked))) == y[checked]).mean(0)
        trust = np.clip(2 * right - 1, 0.05, 1)
    return Model(names, code, weight, bias, trust)


class Predictor:
    def __init__(self, model: Model) -> None:
        self.model = model
        width = model.code.shape[1] + 1
        self.table = subwords.WordTable(self._rows, width, min(250_000, max(1000, TABLE_BYTES // (4 * width))))
        # Logistic losses are sums over bits, so all languages are two matrix products.
        self.plus, self.minus = ((model.code.T > 0) * model.trust[:, None], (model.code.T < 0) * model.trust[:, None])

    def _rows(self, words: list[str]) -> np.ndarray:
        clean = [letters(w) for w in words]
        bucket, first = subwords.grams(clean, ORDERS, BUCKETS)
        size = np.diff(first) * np.fromiter(map(bool, clean), bool, len(clean))
        return np.concatenate([subwords.sums(self.model.weight, bucket, first) * (size > 0)[:, None], size[:, None]], 1)

    def totals(self, texts: list[str | None]) -> np.ndarray:
        """Sums of the numbers of all words of each text, ``BLOCK`` words at a time."""
        seq, start = self.table.numbers([words_of(t) for t in texts])
        out = np.zeros((len(texts), self.table.rows.shape[1]))
        filled = np.flatnonzero(np.diff(start))
        begin, end = start[:-1][filled], start[1:][filled]
        for a in range(0, len(seq), BLOCK):
            b = min(a + BLOCK, len(seq))
            here = slice(int(np.searchsorted(end, a, "right")), int(np.searchsorted(begin, b, "left")))
            first = np.maximum(begin[here], a) - a
            out[filled[here]] += np.add.reduceat(self.table.rows[seq[a:b]], first, axis=0, dtype=np.float64)
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language, probability of it among the codewords, whether it is ambiguous) of each text."""
        m = self.model
        totals = self.totals(texts)
        known = (totals[:, -1] > 0) & bool(m.langs)
        langs, score, unclear = [UNKNOWN] * len(texts), np.zeros(len(texts)), ~known
        if len(m.langs) == 1:
            return [m.langs[0] if k else UNKNOWN for k in known], known.astype(float), unclear
        if not m.langs:
            return langs, score, unclear
        f = totals[:, :-1] / np.maximum(1, totals[:, -1:]) * 10 + m.bias
        loss = np.logaddexp(0, -f) @ self.plus + np.logaddexp(0, f) @ self.minus
        p = np.exp(loss.min(1, keepdims=True) - loss)
        p /= p.sum(1, keepdims=True)
        best = loss.argmin(1)
        ranked = np.sort(p, 1)
        unclear = unclear | (ranked[:, -1] - ranked[:, -2] < CLEAR)
        return [m.langs[b] if k else UNKNOWN for b, k in zip(best, known)], np.where(known, ranked[:, -1], 0.0), unclear


def sample(docs: DataFrame) -> tuple[list[str], list[str]]:
    """(snippets, their languages) of the bounded training rows: texts with a language outside the held-out fold."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & (common.crc_mod("doc_id", 4) != 2) & (F.length("text").between(1, MAX_CHARS)))
    counted = rows.groupBy("lang").count()
    counts = counted.orderBy(F.desc("count"), "lang").limit(MAX_TEXTS + 1).collect()
    if not counts:
        return [], []
    if len(counts) > MAX_TEXTS:
        raise ValueError(f"more than {MAX_TEXTS} different languages: the column doesn't hold languages")
    each = max(1, min(PER_LANG, MAX_TEXTS // len(counts)))
    part = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], min(1.0, each / r["count"]))])
    luck = F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 30)) / float(1 << 30)
    order = F.xxhash64("doc_id", F.lit(17))
    picked = rows.where(luck < F.try_element_at(part, F.col("lang"))).select(order.alias("luck"), "doc_id", "text", "lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.pieces(batches):
            out = []
            for lucky, doc_id, text, lang in zip(*(c.to_pylist() for c in batch.columns)):
                out += [(lucky, doc_id, k, shortened(ws), lang) for k, ws in enumerate(snippets(text, np.random.default_rng(lucky & (1 << 63) - 1)))]
            columns = zip(*out) if out else ([],) * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, SNIPPET_ROWS)], schema=SNIPPET_ROWS)

    cut = picked.mapInArrow(run, "luck long, doc_id long, k int, snippet string, lang string")
    # A shuffle of what was picked; the limit keeps the driver's share bounded if ids repeat without end.
    found = cut.orderBy("luck", "doc_id", "k", "snippet", "lang").limit(2 * SNIPPETS * MAX_TEXTS).select("snippet", "lang").toPandas()
    return found["snippet"].tolist(), found["lang"].tolist()


SNIPPET_ROWS = pa.schema([("luck", pa.int64()), ("doc_id", pa.int64()), ("k", pa.int32()), ("snippet", pa.string()), ("lang", pa.string())])


def predictor(shared) -> Predictor:
    """The worker's predictor of a broadcast model."""
    model = shared.value
    return common.held(model, lambda: Predictor(model))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, ambiguous`` of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x bits floats: fixed by the languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = predictor(shared)
        for batch in common.pieces(batches):
            langs, score, unclear = made.predict(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(langs, pa.string()), pa.array(score, pa.float64()), pa.array(unclear, pa.bool_())],
                ["doc_id", "lang_pred", "score", "ambiguous"],
            )

    found = common.texts(docs, fill=False).mapInArrow(run, "doc_id long, lang_pred string, score double, ambiguous boolean")
    held = F.coalesce(common.crc_mod("doc_id", 4) == 2, F.lit(False)).alias("held_out")
    return found.select("doc_id", held, "lang_pred", "score", "ambiguous")


def keep_identified(docs: DataFrame, model: Model) -> DataFrame:
    """The documents with a recognised language: those without a letter, and those between languages, go."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def decide(_, body):
        langs, _, unclear = predictor(shared).predict(body)
        return [lang != UNKNOWN and not u for lang, u in zip(langs, unclear)]

    return common.keep_rows(docs, decide)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``op5_langid``: fit outside the held-out fold, predict all of ``documents``."""
    docs = common.table(spark, sf_dir, "documents")
    return identify(docs, fit(*sample(docs)))
