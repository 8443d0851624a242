"""Periodic runs of words, from the suffix tree of each document.

A run is a stretch of consecutive words with smallest period q, of at least
``max(MIN_LENGTH, MIN_COPIES * q)`` words, that neither neighbour extends.

The documents of a slice are searched together, each with symbols and an end
mark of its own, so that no suffix of one meets a suffix of another:

1. Suffixes are sorted by prefix doubling; only those not yet told apart are
   sorted again, so plain prose is done after two or three rounds and only a
   long repeat costs more. The sorted suffixes and their common prefixes are
   the suffix tree: a node is a range of them with its depth.
2. At every node the leaves outside its largest child are looked at (the
   smaller half): leaf i of a node of depth D starts the branching tandem
   repeat of two blocks of D words if i + D is a leaf too and the words after
   both differ; leaf i ends one if i - D is. n log n looks in all.
3. A branching repeat is the last of its run, so it is rotated to the left as
   far as the words agree. Repeats are taken by their end and by growing D;
   one whose D is a multiple of the period of a run with the same end, and
   which lies in it, is that run again.

Contract: one row per input row, whole texts. A null text has no words. A
null ``doc_id`` stays null, repeated rows give repeated rows, extra columns are
ignored, an empty table gives no rows. No shuffle; a text is one row and so
one task, whose memory is about 200 bytes a word of its longest text.
"""

from __future__ import annotations

import hashlib
import zlib
from array import array
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common

MIN_LENGTH, MIN_COPIES = 6, 4
#: Leaves looked at in one go.
LOOKS = 1 << 20

Run = tuple[int, int, int]
Arrange = Callable[[int | None, list[bytes]], list[bytes]]


def words_of(text: str | None) -> list[bytes]:
    """Maximal stretches without the six ASCII white-space characters, as UTF-8."""
    return text.encode().split() if text else []


class Suffixes:
    """Sorted suffixes of the symbols ``s`` and the common prefix of each with the one before.

    Documents end in a symbol that occurs once, so no common prefix crosses one.
    """

    def __init__(self, s: np.ndarray) -> None:
        n = len(s)
        self.order = np.argsort(s, kind="stable")
        head = np.ones(n, bool)
        head[1:] = s[self.order[1:]] != s[self.order[:-1]]
        rank = np.empty(n, np.int64)
        rank[self.order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
        split: list[tuple[np.ndarray, np.ndarray]] = []
        slots = self._open(np.arange(n), head)
        h = 1
        while len(slots):
            at = self.order[slots]
            split.append((at, rank[at]))
            key = rank[at] * (n + 1) + rank[at + h]
            by = np.argsort(key, kind="stable")
            at, key = at[by], key[by]
            self.order[slots] = at
            head = np.ones(len(slots), bool)
            head[1:] = key[1:] != key[:-1]
            rank[at] = np.maximum.accumulate(np.where(head, slots, 0))
            slots = self._open(slots, head)
            h *= 2
        self.slot = rank
        self.common = self._common(split)

    @staticmethod
    def _open(slots: np.ndarray, head: np.ndarray) -> np.ndarray:
        """Slots whose suffix isn't alone in its class."""
        alone = head.copy()
        alone[:-1] &= head[1:]
        return slots[~alone]

    def _common(self, split: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Longest common prefixes of neighbours: ranks are taken back round by round, from the longest prefixes compared down."""
        found = np.zeros(len(self.order), np.int64)
        if not split:
            return found
        rank = self.slot.copy()
        # Only suffixes that shared their first symbol with another can have one.
        near = np.sort(self.slot[split[0][0]])
        near = near[near > 0]
        a, b, length = self.order[near - 1], self.order[near], np.zeros(len(near), np.int64)
        for k in range(len(split) - 1, -1, -1):
            at, old = split[k]
            rank[at] = old
            same = rank[a + length] == rank[b + length]
            length[same] += 1 << k
        found[near] = length
        return found


def nodes(common_prefix: np.ndarray) -> tuple[np.ndarray, ...]:
    """Inner nodes but the root: first and last slot, depth, first and last slot of the largest child."""
    first, last, depth, child_first, child_last = (array("q") for _ in range(5))
    inner = np.flatnonzero(common_prefix > 0)
    if not len(inner):
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    values = common_prefix[inner]
    # [depth, first slot, first and last slot of the largest child] of the open nodes
    open_nodes: list[list[int]] = []

    def close(until: int, end: int) -> tuple[int, int]:
        """Close nodes deeper than ``until``; the outermost one closed."""
        a = b = end
        while open_nodes and open_nodes[-1][0] > until:
            d, a, x, y = open_nodes.pop()
            first.append(a), last.append(end), depth.append(d), child_first.append(x), child_last.append(y)
            b = end
            if open_nodes and open_nodes[-1][0] >= until and b - a > open_nodes[-1][3] - open_nodes[-1][2]:
                open_nodes[-1][2], open_nodes[-1][3] = a, b
        return a, b

    before = -1
    for r, d in zip(inner.tolist(), values.tolist()):
        if r != before + 1:
            close(0, before)
        before = r
        a, b = close(d, r - 1)
        if not open_nodes or open_nodes[-1][0] < d:
            open_nodes.append([d, a, a, b])
    close(0, before)
    return tuple(np.frombuffer(x, np.int64) for x in (first, last, depth, child_first, child_last))


def branching(s: np.ndarray, tree: Suffixes) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(start, D) of the branching tandem repeats, some of them twice, in portions."""
    first, last, depth, child_first, child_last = nodes(tree.common)
    # The smaller half of a node: the slots before and after its largest child.
    of = np.concatenate([np.arange(len(first))] * 2)
    lows, highs = np.concatenate([first, child_last + 1]), np.concatenate([child_first, last + 1])
    sizes = highs - lows
    kept = sizes > 0
    of, lows, sizes = of[kept], lows[kept], sizes[kept]
    ends = np.cumsum(sizes)
    n = len(s)
    at = 0
    while at < len(sizes):
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + LOOKS, side="right")))
        size, node = sizes[at:upto], of[at:upto]
        offset = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        leaf = tree.order[np.repeat(lows[at:upto], size) + offset]
        node = np.repeat(node, size)
        d, a, b = depth[node], first[node], last[node]
        for start, other in ((leaf, leaf + d), (leaf - d, leaf - d)):
            inside = (other >= 0) & (other < n)
            slot = tree.slot[np.where(inside, other, 0)]
            inside &= (slot >= a) & (slot <= b)
            i, p = start[inside], d[inside]
            # The words after both blocks; they exist, as both suffixes go on for D words and an end mark.
            ends_here = s[i + p] != s[i + 2 * p]
            yield i[ends_here], p[ends_here]
        at = upto


def leftmost(s: np.ndarray, i: int, d: int, low: int) -> int:
    """The smallest start >= ``low`` from which words agree with those ``d`` later, up to ``i``."""
    step = 64
    while i > low:
        a = max(low, i - step)
        apart = np.flatnonzero(s[a:i] != s[a + d : i + d])
        if len(apart):
            return a + int(apart[-1]) + 1
        i, step = a, step * 2
    return i


def runs_of(documents: list[list[bytes]]) -> list[list[Run]]:
    """The runs (start, length, period) of each document, by start and period."""
    sizes = np.array([len(d) for d in documents], np.int64)
    found: list[list[Run]] = [[] for _ in documents]
    number: defaultdict[bytes, int] = defaultdict(count().__next__)
    codes = [np.fromiter(map(number.__getitem__, d), np.int64, len(d)) for d in documents]
    width = len(number) + 1
    # A document's words and its end mark, apart from those of all others.
    s = np.concatenate([np.append(c, width - 1) + k * width for k, c in enumerate(codes)]) if documents else sizes
    base = np.cumsum(sizes + 1) - sizes - 1
    if not len(s):
        return found
    tree = Suffixes(s)
    starts, periods = [], []
    for i, d in branching(s, tree):
        # What four copies need: two more blocks before, and the word before that fits.
        low = base[np.searchsorted(base, i, side="right") - 1]
        back = i - (MIN_COPIES - 2) * d
        likely = back >= low
        i, d, back = i[likely], d[likely], back[likely]
        likely = (s[back] == s[i]) & (s[i - d] == s[i]) & (s[i - 1] == s[i - 1 + d])
        starts.append(i[likely]), periods.append(d[likely])
    if not starts:
        return found
    i, d = np.concatenate(starts), np.concatenate(periods)
    pairs = np.unique(np.stack([i + 2 * d, d, i]), axis=1)
    owner = np.searchsorted(base, pairs[2], side="right") - 1
    end_before, here = -1, []
    for end, d, i, k in zip(*pairs.tolist(), owner.tolist()):
        if end != end_before:
            end_before, here = end, []
        if any(d % q == 0 and i >= a for a, q in here):
            continue
        low = int(base[k])
        a = leftmost(s, i, d, low)
        if end - a >= MIN_COPIES * d:
            here.append((a, d))
            if end - a >= max(MIN_LENGTH, MIN_COPIES * d):
                found[k].append((a - low, end - a, d))
    for rows in found:
        rows.sort(key=lambda r: (r[0], r[2]))
    return found


def kept_words(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words without those that a run holds after its first period."""
    if not runs:
        return words
    gone = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        gone[start + period] += 1
        gone[start + length] -= 1
    return [w for w, g in zip(words, np.cumsum(gone).tolist()) if not g]


def searched(docs: DataFrame, fields: list[tuple[str, pa.DataType, str]], row: Callable, arrange: Arrange | None = None) -> DataFrame:
    """``row(doc_id, words, runs)`` yields the result rows of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.pieces(batches):
            ids = part.column(0).to_pylist()
            words = [words_of(t) for t in part.column(1).to_pylist()]
            if arrange:
                words = [arrange(i, w) for i, w in zip(ids, words)]
            rows = [r for i, w, found in zip(ids, words, runs_of(words)) for r in row(i, w, found)]
            columns = zip(*rows) if rows else [()] * len(fields)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t, _) in zip(columns, fields)], [f for f, _, _ in fields])

    return common.texts(docs).mapInArrow(run, ", ".join(f"{f} {kind}" for f, _, kind in fields))


def longs(*names: str) -> list[tuple[str, pa.DataType, str]]:
    return [(n, pa.int64(), "long") for n in names]


def texts_of(*names: str) -> list[tuple[str, pa.DataType, str]]:
    return [(n, pa.string(), "string") for n in names]


def runs(docs: DataFrame) -> DataFrame:
    """``doc_id, start, length, period``: one row per run of every whole text."""
    return searched(docs, longs("doc_id", "start", "length", "period"), lambda i, words, found: [(i, *r) for r in found])


def collapsed(docs: DataFrame) -> DataFrame:
    """``doc_id, text``: the words of every text, joined by one space, without the repeats of its runs."""
    return searched(docs, longs("doc_id") + texts_of("text"), lambda i, words, found: [(i, b" ".join(kept_words(words, found)).decode())])


def digest(doc_id: int | None, words: list[bytes], found: list[Run]) -> list[tuple]:
    start, length, period = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    listed = "".join(f"{a},{n},{q}\n" for a, n, q in found)
    return [
        (
            doc_id,
            len(found),
            start,
            length,
            period,
            1000 * length // period if found else None,
            hashlib.sha256(listed.encode()).hexdigest(),
            hashlib.sha256(b" ".join(kept_words(words, found))).hexdigest(),
        )
    ]


def digests(docs: DataFrame, arrange: Arrange | None = None) -> DataFrame:
    """Per document: how many runs, the longest of them, and hashes of all runs and of the collapsed text."""
    fields = longs("doc_id", "n_runs", "start", "length", "period", "exponent_milli") + texts_of("runs_sha256", "collapsed_sha256")
    return searched(docs, fields, digest, arrange)


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The query's input: one text in ten repeats a stretch of itself from some word on."""
    n = len(words)
    if doc_id is None or not n:
        return words
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    stretch = words[a : a + p]
    return words[:a] + (stretch * ((n - a) // p + 1))[: n - a]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``op12_periodic``: all of ``documents``, one in ten with a planted repeat."""
    return digests(common.table(spark, sf_dir, "documents"), planted)
