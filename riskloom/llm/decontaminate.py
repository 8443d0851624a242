"""Benchmark decontamination by CGK embedding, bit-sampling LSH and exact edit verification.

The CGK embedding walks over a string with random bits: at step j it emits the
current character c and moves on if bit (j, c) is set. Strings at small edit
distance get embeddings at small Hamming distance, because two walks meet
again soon after an edit. Sampling the same steps of the embedding gives one
LSH key; ``REPEATS`` independent walks and samples bring the recall to target.

A document's windows begin after white space, and inside long stretches
without it, as in scripts without spaces, after any byte that is no letter or
digit and at places that two bytes mark; an item's anchors are at all of these
everywhere. A window is as long as the item it is compared with. Its key is read along the
walk, so a window leaves as soon as its partial key matches no anchor: the
keys are those of the whole sample, at the cost of their first steps. Windows
with a full key are candidates; the item-sized window is then verified by the
exact semi-global edit distance (bit-parallel), at most ``1 - SIMILARITY`` of
the item's length. Keys are short, so that some anchor
survives edits up to the limit; a candidate's bytes near the anchor are compared
first, all candidates at once. An item of up to ``SHORT`` bytes, or with fewer
than ``LEAST_ANCHORS`` anchors, is searched exactly: one of its ``most + 1`` pieces stands unedited in every occurrence.

Both sides are compared in lower case with white space squeezed. Documents are
read once and not shuffled. Items of up to ``BLOCK`` bytes in all are
broadcast; more are written to the shared folder in blocks of that size, which
every task reads for each ``SLAB`` bytes of texts. The driver never holds more
than one block.

Contract: one row per (row of documents, item) that leaks. Null and empty
texts or items leak nothing. Repeated documents give repeated rows, repeated
items are one item each; a null ``doc_id`` or ``item_id`` stays null.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SIMILARITY = 0.8
REPEATS = 5
#: Steps of a walk, sampled steps among the first ``EARLY`` and among the rest.
STEPS, EARLY, EARLY_BITS, LATE_BITS = 22, 11, 6, 5
#: Bytes of an item that an anchor needs after it (a walk of STEPS steps reads half as many on average).
ROOM = 10
#: Items of up to this many bytes are searched exactly, by pieces.
SHORT = 44
#: Bytes around an anchor that are compared before the whole item, and the share of them that may be edited.
NEAR, NEAR_EDITS = 48, 0.33
#: Bytes that the comparison near an anchor tells apart: letters, digits and the space each for itself, the others in groups.
CLASSES = np.array([1 + b - 97 if 97 <= b <= 122 else 27 + b - 48 if 48 <= b <= 57 else 37 if b == 32 else 38 + b % 26 for b in range(256)])
#: Bytes of words: ASCII letters and digits, and all of other scripts. The walk reads any other byte as a space.
LETTER = np.array([chr(b).isalnum() if b < 128 else True for b in range(256)])
READ = np.where(LETTER, np.arange(256), 32).astype(np.uint8)
READ[0] = 0
#: One in so many pairs of bytes marks a place; stretches of more bytes than that without white space have windows at such places.
PLACE_EVERY, LONG_WORD = 5, 20
PLACE = np.random.default_rng(999).integers(0, 1 << 20, (2, 256))
#: An item with fewer anchors is searched exactly, as a short one is.
LEAST_ANCHORS = 3
#: Bytes of items in a block (one block is broadcast), and of texts that go through all blocks together where there are more.
BLOCK, SLAB = 2 << 20, 32 << 20
SCHEMA = "doc_id long, item_id long, distance int, similarity double, start int"
TABLE_BITS = 22


def squeeze(text: str | None) -> str:
    return " ".join((text or "").lower().split())


@functools.cache
def walk(repeat: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(moves by step and byte, sampled steps, multipliers) of one repeat."""
    rng = np.random.default_rng(1000 + repeat)
    moves = rng.integers(0, 2, (STEPS, 256), dtype=np.int32)
    steps = np.sort(np.concatenate([rng.choice(EARLY, EARLY_BITS, replace=False), EARLY + rng.choice(STEPS - EARLY, LATE_BITS, replace=False)]))
    return moves, steps, rng.integers(1, 1 << 62, STEPS, dtype=np.uint64) | np.uint64(1)


def keys(buffer: np.ndarray, at: np.ndarray, repeat: int, first: int, last: int, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Walk steps ``first`` to ``last`` from positions ``at``; returns (positions, keys)."""
    moves, steps, mult = walk(repeat)
    sampled = set(steps.tolist())
    for j in range(first, last):
        c = buffer.take(at)
        if j in sampled:
            key = (key ^ c) * mult[j]
            key ^= key >> np.uint64(29)
        at = at + moves[j].take(c)
    return at, key


def bit(key: np.ndarray) -> np.ndarray:
    return (key >> np.uint64(64 - TABLE_BITS)).astype(np.int64)


def placed(buffer: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The positions that begin a word of letters or digits, or are marked by the two bytes there."""
    here, before = LETTER[buffer[at]], LETTER[buffer[at - 1]]
    after = buffer[at + 1]
    marked = LETTER[after] & ((PLACE[0][buffer[at]] + PLACE[1][after]) % PLACE_EVERY == 0)
    return at[here & (~before | marked)]


def anchors(buffer: np.ndarray, everywhere: bool) -> tuple[np.ndarray, np.ndarray]:
    """Positions where windows begin: those after white space, and ``placed`` ones ``everywhere`` or in stretches of over ``LONG_WORD`` bytes without it.

    A place is told by two bytes that stand in any copy, so a text without
    spaces has windows too, and one whose spaces are gone or are other marks
    meets the anchors inside the item. The buffer begins and ends with an end mark.
    """
    gaps = np.flatnonzero(buffer <= 32)
    starts = gaps[:-1] + 1
    sizes = gaps[1:] - starts
    words = starts[sizes > 0].astype(np.int32)
    if everywhere:
        return words, placed(buffer, np.arange(1, len(buffer) - 1, dtype=np.int32))
    long = sizes > LONG_WORD
    first, n = starts[long], sizes[long]
    return words, placed(buffer, (np.arange(n.sum()) + np.repeat(first - (np.cumsum(n) - n), n)).astype(np.int32))


class Items:
    """One block of items, with their anchors."""

    def __init__(self, items: list[tuple[int | None, str]]) -> None:
        self.items = [(i, t) for i, text in items if (t := squeeze(text))]
        raw = [b"\0" + t.encode() for _, t in self.items]
        size = np.array([len(r) for r in raw], np.int64) if raw else np.zeros(0, np.int64)
        buffer = np.frombuffer(b"".join(raw) + b"\0" + b"\0" * (STEPS + 1), np.uint8)
        short = size - 1 <= SHORT
        found = Anchors(buffer, size, short, np.union1d(*anchors(buffer, everywhere=True)))
        short = short | (np.bincount(found.owner, minlength=len(raw)) < LEAST_ANCHORS)
        self.short = np.flatnonzero(short).tolist()
        #: What windows after white space meet, and what those inside long stretches meet.
        self.words = Anchors(buffer, size, short, np.union1d(*anchors(buffer, everywhere=False)))
        self.every = Anchors(buffer, size, short, np.union1d(*anchors(buffer, everywhere=True)))

    def candidates(self, buffer: np.ndarray) -> set[tuple[int, int]]:
        """(item, presumed begin of the item in the buffer, rounded) of all windows of a buffer of texts."""
        words, inner = anchors(buffer, everywhere=False)
        return self.words.candidates(buffer, words) | self.every.candidates(buffer, inner)


class Anchors:
    """Anchors of a block of items, with their keys."""

    def __init__(self, buffer: np.ndarray, size: np.ndarray, short: np.ndarray, at: np.ndarray) -> None:
        at = at.astype(np.int32)
        ends = np.cumsum(size)
        owner = np.searchsorted(ends, at, side="right")
        short = np.append(short, True)
        ok = (owner < len(size)) & ~short[owner] & (at + ROOM <= ends[np.minimum(owner, max(0, len(size) - 1))]) if len(size) else np.zeros(len(at), bool)
        at, self.owner = at[ok], owner[ok]
        self.offset = at - (ends - size)[self.owner] - 1 if len(at) else at
        # The stretch of the item that is compared near each anchor: NEAR bytes, or the whole item.
        self.near_length = np.minimum(NEAR, size[self.owner] - 1) if len(at) else at
        begin = np.minimum(self.offset, size[self.owner] - 1 - self.near_length) if len(at) else at
        self.back = self.offset - begin
        self.near = (at - self.back).astype(np.int64)
        self.bytes = buffer
        self.early, self.late, self.sorted, self.order = [], [], [], []
        read = READ[buffer]
        for r in range(REPEATS):
            pos, key = keys(read, at, r, 0, EARLY, np.zeros(len(at), np.uint64))
            table = np.zeros(1 << TABLE_BITS, bool)
            table[bit(key)] = True
            self.early.append(table)
            _, key = keys(read, pos, r, EARLY, STEPS, key)
            self.late.append(np.zeros(1 << TABLE_BITS, bool))
            self.late[-1][bit(key)] = True
            order = np.argsort(key, kind="stable")
            self.sorted.append(key[order])
            self.order.append(order)

    def candidates(self, buffer: np.ndarray, starts: np.ndarray, chunk: int = 1 << 15) -> set[tuple[int, int]]:
        """(item, presumed begin of the item in the buffer, rounded) of the windows with an anchor's key and like bytes near it."""
        found: set[tuple[int, int]] = set()
        if not len(self.owner) or not len(starts):
            return found
        classes, read = CLASSES[buffer], READ[buffer]
        for a in range(0, len(starts), chunk):
            here = starts[a : a + chunk]
            hits = []
            for r in range(REPEATS):
                pos, key = keys(read, here, r, 0, EARLY, np.zeros(len(here), np.uint64))
                live = np.flatnonzero(self.early[r].take(bit(key)))
                if not len(live):
                    continue
                _, key = keys(read, pos[live], r, EARLY, STEPS, key[live])
                whole = np.flatnonzero(self.late[r].take(bit(key)))
                live, key = live[whole], key[whole]
                low, high = np.searchsorted(self.sorted[r], key, "left"), np.searchsorted(self.sorted[r], key, "right")
                count = high - low
                ranks = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
                hits.append(np.repeat(here[live].astype(np.int64), count) << 32 | self.order[r][ranks])
            if not hits:
                continue
            both = np.unique(np.concatenate(hits))
            for k in range(0, len(both), chunk):
                at, anchor = both[k : k + chunk] >> 32, both[k : k + chunk] & 0xFFFFFFFF
                ok = self.alike(classes, at, anchor)
                at, anchor = at[ok], anchor[ok]
                found.update(zip(self.owner[anchor].tolist(), ((at - self.offset[anchor]) >> 4).tolist()))
        return found

    def alike(self, classes: np.ndarray, at: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        """Whether the bytes near each anchor stand near its window with at most NEAR_EDITS edits (bit-parallel, all at once)."""
        used, which = np.unique(anchor, return_inverse=True)
        # Per anchor and class of bytes, the places of the stretch that have it: a step of the comparison is one look-up.
        places = np.zeros((len(used), 64), np.uint64)
        every = np.arange(len(used))
        for j in range(NEAR):
            inside = self.near_length[used] > j
            places[every[inside], CLASSES[self.bytes[self.near[used[inside]] + j]]] |= np.uint64(1 << j)
        places, which = places.ravel(), which * 64
        m = self.near_length[anchor]
        full = (np.uint64(1) << m.astype(np.uint64)) - np.uint64(1)
        top, one = (m - 1).astype(np.uint64), np.uint64(1)
        slack = NEAR // 4
        begin = at - self.back[anchor] - slack
        pv, mv = full.copy(), np.zeros(len(at), np.uint64)
        score, best = m.astype(np.uint64), m.astype(np.uint64)
        for j in range(NEAR + 2 * slack):
            eq = places.take(which + classes.take(begin + j, mode="clip"))
            d0 = ((((eq & pv) + pv) ^ pv) | eq | mv) & full
            hp, hn = mv | (full & ~(d0 | pv)), pv & d0
            score += (hp >> top) & one
            score -= (hn >> top) & one
            np.minimum(best, score, out=best)
            hp, hn = hp << one & full, hn << one & full
            pv, mv = hn | (full & ~(d0 | hp)), hp & d0
        return best.astype(np.int64) <= (NEAR_EDITS * m).astype(np.int64)


def most_edits(length: int) -> int:
    """The edits that an item of this length may have (rounded against 1 - 0.8 < 0.2)."""
    return int((1 - SIMILARITY) * length + 1e-9)


def edit_distance(pattern: str, text: str, most: int | None = None) -> tuple[int, int]:
    """(least edit distance of ``pattern`` to any stretch of ``text``, end of that stretch), bit-parallel.

    Stops once the distance can't fall to ``most`` any more.
    """
    m, n = len(pattern), len(text)
    most = m if most is None else most
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, end = full, 0, m, m, 0
    for j, c in enumerate(text, 1):
        eq = masks.get(c, 0)
        d0 = (((eq & pv) + pv) ^ pv) | eq | mv
        hp, hn = mv | (full & ~(d0 | pv)), pv & d0
        if hp & top:
            score += 1
        elif hn & top:
            score -= 1
        hp, hn = hp << 1 & full, hn << 1 & full
        pv, mv = hn | (full & ~(d0 | hp)), hp & d0
        if score < best:
            best, end = score, j
        elif score - (n - j) > most and best > most:
            break
    return best, end


def leaks(items: Items, texts: list[str | None]) -> list[tuple[int, int, int, int]]:
    """(row, item, distance, start) of the best occurrence of each item that leaks into each text."""
    clean = [squeeze(t) for t in texts]
    raw = [t.encode("utf-8", "replace") for t in clean]
    size = np.array([len(r) + 1 for r in raw], np.int64)
    ends = np.cumsum(size)
    buffer = np.frombuffer(b"\0" + b"\0".join(raw) + b"\0" * (2 * NEAR), np.uint8)
    wanted: dict[tuple[int, int], list[int]] = {}
    for item, begin in items.candidates(buffer):
        row = int(np.searchsorted(ends, max(0, (begin << 4) + 8 - 1), side="right"))
        for r in {min(row, len(raw) - 1)} | ({row + 1} if row + 1 < len(raw) and (begin << 4) + 64 > ends[row] else set()):
            wanted.setdefault((r, item), []).append((begin << 4) - int(ends[r] - size[r]) - 1)
    out = []
    for (row, item), begins in sorted(wanted.items()):
        text = items.items[item][1]
        most = most_edits(len(text))
        if (exact := clean[row].find(text)) >= 0:
            out.append((row, item, 0, exact))
            continue
        best = (most + 1, 0)
        body, wide = raw[row], len(text.encode())
        for begin in sorted(set(begins)):
            a = max(0, begin - most - 32)
            stretch = body[a : max(0, begin + wide + most + 48)].decode("utf-8", "ignore")
            d, end = edit_distance(text, stretch, most)
            if d < best[0]:
                best = (d, max(0, len(body[:a].decode("utf-8", "ignore")) + end - len(text)))
        if best[0] <= most:
            out.append((row, item, *best))
    for item in items.short:
        out += [(row, item, *found) for row, t in enumerate(clean) if (found := short_leak(items.items[item][1], t))]
    return out


def short_leak(item: str, text: str) -> tuple[int, int] | None:
    """(distance, start) of the best occurrence of a short item: of its ``most + 1`` pieces one stands unedited."""
    if (exact := text.find(item)) >= 0:
        return 0, exact
    m = len(item)
    most = most_edits(m)
    if not most:
        return None
    cuts = [m * k // (most + 1) for k in range(most + 2)]
    spans = set()
    for a, b in zip(cuts, cuts[1:]):
        at = text.find(item[a:b])
        while at >= 0:
            spans.add((max(0, at - a - most), at - a + m + most))
            at = text.find(item[a:b], at + 1)
    best, begin, end = (most + 1, 0), 0, 0
    for low, high in [*sorted(spans), (len(text) + 1, 0)]:
        if low <= end:
            end = max(end, high)
            continue
        d, last = edit_distance(item, text[begin:end], most)
        best = min(best, (d, max(0, begin + last - m)))
        begin, end = low, high
    return best if best[0] <= most else None


class Source(NamedTuple):
    """The items: one broadcast block, or ``count`` blocks of them as files in a folder that all executors reach."""

    shared: object
    folder: str
    count: int

    def blocks(self) -> Iterator[Items]:
        if self.shared is not None:
            rows = self.shared.value
            yield common.held(rows, lambda: Items(rows))
            return
        fs, path = pafs.FileSystem.from_uri(self.folder)
        for k in range(self.count):
            chosen = pafs.FileSelector(f"{path}/block={k}", allow_not_found=True)
            rows = [r for f in fs.get_file_info(chosen) if f.path.endswith(".parquet") for r in zip(*(c.to_pylist() for c in pq.read_table(f.path, filesystem=fs, partitioning=None).columns))]
            yield Items(rows)


def source(benchmark: DataFrame, most: int = BLOCK) -> Source:
    """The distinct items, broadcast while they are measured to be at most ``most`` bytes, else written in blocks of about that size."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where(F.length(F.trim("text")) > 0).distinct()
    spark = benchmark.sparkSession
    size, rows = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*")).first()
    if size + 16 * rows <= most:
        found = [tuple(r) for r in items.orderBy("item_id", "text").collect()]
        return Source(spark.sparkContext.broadcast(found), "", 1)
    count = 1 + int((size + 16 * rows) // most)
    folder = common.run_folder(spark, "items") + "/blocks"
    items.withColumn("block", F.pmod(F.xxhash64("text"), F.lit(count))).repartition("block").write.partitionBy("block").parquet(folder)
    return Source(None, folder, count)


def slabs(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[list[pa.RecordBatch]]:
    """The slices of the batches, gathered to about ``size`` bytes of text."""
    held, total = [], 0
    for batch in common.pieces(batches, 128):
        held.append(batch)
        total += int(common.row_bytes(batch).sum())
        if total >= size:
            yield held
            held, total = [], 0
    if held:
        yield held


def leaks_of(items: Source, batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, list[tuple]]]:
    """Each slice of rows with its leaks: (row, item id, item's length, distance, start).

    A row is read once: blocks in files are gone through for ``SLAB`` bytes of
    texts at a time, so that reading a block costs little beside its use.
    """
    for slab in slabs(batches, 0 if items.shared is not None else SLAB):
        found: list[list[tuple]] = [[] for _ in slab]
        for block in items.blocks():
            for out, batch in zip(found, slab):
                body = batch.column(batch.schema.get_field_index(column)).to_pylist()
                out += [(row, block.items[k][0], len(block.items[k][1]), d, s) for row, k, d, s in leaks(block, body)]
        yield from zip(slab, found)


def find_leaks(docs: DataFrame, benchmark: DataFrame, most: int = BLOCK) -> DataFrame:
    """``doc_id, item_id, distance, similarity, start`` of every leak (start in the squeezed text)."""
    items = source(benchmark, most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in leaks_of(items, batches, "text"):
            rows = np.array([r for r, *_ in found], np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(rows)),
                    pa.array([i for _, i, *_ in found], pa.int64()),
                    pa.array([d for *_, d, _ in found], pa.int32()),
                    pa.array([1 - d / n for *_, n, d, _ in found], pa.float64()),
                    pa.array([s for *_, s in found], pa.int32()),
                ],
                ["doc_id", "item_id", "distance", "similarity", "start"],
            )

    return common.texts(docs).mapInArrow(run, SCHEMA)


def keep_uncontaminated(docs: DataFrame, benchmark: DataFrame, most: int = BLOCK) -> DataFrame:
    """``docs`` without the rows into which an item leaks; all columns stay."""
    items = source(benchmark, most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in leaks_of(items, batches, "text"):
            hit = {row for row, *_ in found}
            yield batch.filter(pa.array([row not in hit for row in range(batch.num_rows)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``op3_decontaminate``: all of ``documents`` against all of ``benchmark``."""
    return find_leaks(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
