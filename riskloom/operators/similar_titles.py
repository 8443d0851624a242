"""Near-duplicate titles in time: the earliest canonical title claims those like it within a window.

The similarity is that of matching blocks, ``2 M / (|a| + |b|)`` with M
matched characters, so it has no metric to index; the filters below only use
that a ratio of t needs M >= t (|a| + |b|) / 2 matched characters, and that
two blocks are parted by an unmatched character of either title. A title of n
characters then loses at most ``losses(n)`` of its n - 1 pairs of neighbouring
characters to any title that similar, so one more of its rarest distinct pairs
always holds one that both titles have (a prefix filter). Titles of up to four
characters differ by at most one character from those like them, and meet
under what is left without it.
"""

from __future__ import annotations

import difflib
import functools
import math
from collections import deque
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import shared
from . import components

THRESHOLD, SECONDS = 0.85, 7200
#: Letters from the most common on: pairs of other characters are taken to be rarer.
LETTERS = " etaoinshrdlu"
SHORT = 4


def clean(title: Column) -> Column:
    return F.lower(F.trim(title))


@functools.lru_cache(1 << 12)
def similarity(late: str, early: str) -> float:
    """Matching-block similarity of a title with an earlier one."""
    return 1.0 if late == early else difflib.SequenceMatcher(None, late, early).ratio()


def alike(late: str, early: str, threshold: float = THRESHOLD) -> bool:
    """Whether the similarity reaches the threshold; its cheap upper bounds are taken first."""
    if late == early:
        return True
    if 2.0 * min(len(late), len(early)) < threshold * (len(late) + len(early)):
        return False
    m = difflib.SequenceMatcher(None, late, early)
    return m.quick_ratio() >= threshold and similarity(late, early) >= threshold


def losses(n: int, threshold: float = THRESHOLD) -> int:
    """How many of its n - 1 neighbouring pairs a title of n characters may lack in one that reaches the threshold."""
    least = (1.5 * threshold - 1) * 2 * n / (2 - threshold) - 1
    return n - 1 - max(1, math.ceil(least - 1e-9))


@functools.lru_cache(1 << 12)
def keys(title: str, threshold: float = THRESHOLD) -> tuple[str, ...]:
    """Index keys of a title, rarest first: titles that reach the threshold share one."""
    if not 0.8 <= threshold <= 1:
        raise ValueError("the filter holds for thresholds from 0.8")
    n = len(title)
    # A short title and one like it are the same but for one character of the longer one.
    found = {"-" + title[:i] + title[i + 1 :] for i in range(n)} | {"-" + title} if n <= SHORT + 1 else set()
    if n > SHORT:
        common = lambda c: len(LETTERS) - LETTERS.index(c) if c in LETTERS else 0
        pairs = sorted({title[i : i + 2] for i in range(n - 1)}, key=lambda p: (common(p[0]) + common(p[1]), p))
        return (*sorted(found), *pairs[: losses(n, threshold) + 1])
    return tuple(sorted(found))


def _keys_of(threshold: float):
    @F.pandas_udf("array<string>")
    def found(titles: pd.Series) -> pd.Series:
        return titles.map(lambda t: keys(t, threshold))

    return found


def node(t: Column) -> Column:
    """What stands for a text in pairs and parts. Texts that share one by chance come to one part, where texts are compared themselves."""
    return F.xxhash64(t)


def similar_texts(titles: DataFrame, threshold: float = THRESHOLD, seconds: int = SECONDS) -> DataFrame:
    """``a, b`` (``a < b``): the nodes of different texts that are alike in either order and come within two cells of the window.

    ``titles`` has ``t`` and ``cell``. Texts repeated in a cell count once, so
    equal titles make no pairs; the index is keyed by cell and key, both as
    one hash. Its rows are numbers: texts come to the candidate pairs at the
    end, every text of a node, so chance only makes more candidates.
    """
    once = titles.select("t", "cell").distinct().withColumns({"node": node(F.col("t")), "n": F.length("t"), "keys": _keys_of(threshold)("t")})
    once = shared.cut(once.select("t", "cell", "node", "n", F.transform("keys", lambda k: F.xxhash64(k)).alias("keys")))
    key = F.xxhash64("cell", "key").alias("k")
    here = once.select("node", "n", "cell", F.explode("keys").alias("key")).select(F.col("node").alias("x"), F.col("n").alias("nx"), key)
    near = once.select("node", "n", "keys", F.explode(F.array(F.col("cell") - 1, F.col("cell"))).alias("cell"))
    near = near.select("node", "n", "cell", F.explode("keys").alias("key")).select(F.col("node").alias("y"), F.col("n").alias("ny"), key)
    long_enough = 2.0 * F.least("nx", "ny") >= threshold * (F.col("nx") + F.col("ny"))
    met = here.join(near, "k").where((F.col("x") != F.col("y")) & long_enough)
    pairs = met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()

    @F.pandas_udf("boolean")
    def reached(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([alike(x, y, threshold) or alike(y, x, threshold) for x, y in zip(a, b)])

    texts = once.select("node", "t").distinct()
    told = pairs.join(texts.toDF("a", "ta"), "a").join(texts.toDF("b", "tb"), "b")
    return told.where(reached("ta", "tb")).select("a", "b").distinct()


def claims(threshold: float, seconds: int):
    """Arrow batches of ``part, id, at, t``, each part together and in time order: who copies whom.

    Holds the canonical titles of one window of one part, whatever its size.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, deque()
        for batch in batches:
            out = []
            for p, row, at, t in zip(*(c.to_pylist() for c in batch.columns)):
                if p != part:
                    part = p
                    held.clear()
                while held and at - held[0][0] > seconds:
                    held.popleft()
                copied = next((i for _, i, text in held if alike(t, text, threshold)), None)
                if copied is None:
                    held.append((at, row, t))
                out.append(copied)
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(out, pa.int64())], ["id", "duplicate_of"])

    return run


def resolve(titles: DataFrame, threshold: float = THRESHOLD, seconds: int = SECONDS) -> DataFrame:
    """``id, duplicate_of``: in time order (ties by id), a title copies the earliest similar one that copies none itself.

    Only titles that hang together by likeness can decide about each other:
    each such part is read once in time order, its canonical titles of the
    last window held. A part of any size so needs the memory of one window,
    though its order makes it the work of one task. Titles that are null or
    blank, or have no time, copy none.
    """
    rows = titles.select("id", clean("title").alias("t"), F.unix_micros(F.col("event_time").cast("timestamp")).alias("us")).where("t <> '' AND us IS NOT NULL")
    rows = rows.select("id", "t", (F.col("us") / 1e6).alias("at"), F.floor(F.col("us") / 1e6 / seconds).alias("cell"))
    named = components.components(shared.cut(similar_texts(rows, threshold, seconds)))
    rows = rows.withColumn("node", node(F.col("t")))
    parts = rows.join(named, "node", "left").select(F.coalesce("label", "node").alias("part"), "id", "at", "t")
    dealt = parts.repartition("part").sortWithinPartitions("part", "at", "id")
    return titles.select("id").join(dealt.mapInArrow(claims(threshold, seconds), "id long, duplicate_of long"), "id", "left")


def settle(edges: DataFrame, known: DataFrame) -> DataFrame:
    """``id, duplicate_of`` of the late ends of ``edges`` (``late, early, at``), given ``known`` decisions of other titles.

    A title is a copy once the earliest of the early ones that aren't copies
    is known to be an original, and an original once all are copies. For the
    few pairs of a batch: each round settles the earliest open title at least.
    """
    order = F.struct("at", F.col("early").alias("id"))
    open_edges = shared.cut(edges.select("late", "early", order.alias("order")))
    late = open_edges.select(F.col("late").alias("id")).distinct()
    settled = shared.cut(known.unionByName(open_edges.select(F.col("early").alias("id")).distinct().join(late, "id", "left_anti").join(known.select("id"), "id", "left_anti").withColumn("duplicate_of", F.lit(None).cast("long"))))
    while not open_edges.isEmpty():
        seen = open_edges.join(settled.select(F.col("id").alias("early"), F.col("duplicate_of").isNull().alias("original")), "early", "left")
        firsts = seen.groupBy("late").agg(F.min(F.when(F.col("original"), F.col("order"))).alias("first"), F.min(F.when(F.col("original").isNull(), F.col("order"))).alias("waits"))
        done = F.col("waits").isNull() | (F.col("first").isNotNull() & (F.col("first") < F.col("waits")))
        fresh = shared.cut(firsts.where(done).select(F.col("late").alias("id"), F.col("first.id").alias("duplicate_of")))
        settled = shared.cut(settled.unionByName(fresh))
        open_edges = shared.cut(open_edges.join(fresh.select(F.col("id").alias("late")), "late", "left_anti"))
    return settled.join(late, "id", "left_semi")
