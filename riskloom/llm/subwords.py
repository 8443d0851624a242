"""Vectorised character n-grams of words, shared by the linear text models."""

from __future__ import annotations

import numpy as np


def grams(words: list[str], orders: tuple[int, ...], buckets: int, whole: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of ``<word>`` for all words: (bucket of each gram, first gram of each word), with an end mark.

    ``whole`` adds one bucket for the word itself. A word with no gram of the
    smallest order still has its boundary marks, so every word has a gram.
    """
    if not words:
        return np.zeros(0, np.int64), np.zeros(1, np.int64)
    code = np.frombuffer(("<" + "><".join(words) + ">").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 2
    owner = np.repeat(np.arange(len(words)), size)
    found, owners = [], []
    h = np.zeros(len(code), np.uint64)
    mul, mix = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)
    shift, top = np.uint64(40), np.uint64(buckets)
    for n in range(1, max(orders) + 1):
        h = (h[: len(code) - n + 1] if n > 1 else h) * mul + code[n - 1 :]
        if n in orders:
            ok = owner[: len(h)] == owner[n - 1 :]
            found.append((((h[ok] + np.uint64(n)) * mix) >> shift) % top)
            owners.append(owner[: len(h)][ok])
    if whole:
        ends = np.cumsum(size)
        place = np.arange(len(code), dtype=np.uint64) - np.repeat(ends - size, size).astype(np.uint64)
        power = (place + np.uint64(1)) * mix
        each = (code * power) ^ ((code * power) >> np.uint64(31))
        total = np.add.reduceat(each * mul, ends - size)
        found.append(((total * mix) >> shift) % top)
        owners.append(np.arange(len(words)))
    bucket, who = np.concatenate(found).astype(np.int64), np.concatenate(owners)
    order = np.argsort(who, kind="stable")
    counts = np.bincount(who, minlength=len(words))
    return bucket[order], np.concatenate([[0], np.cumsum(counts)])


def sums(weights: np.ndarray, bucket: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Sum of the weight rows of each word's grams; zero for a word without any."""
    n = len(start) - 1
    if not n:
        return np.zeros((0, *weights.shape[1:]), weights.dtype)
    running = np.concatenate([np.zeros((1, *weights.shape[1:])), np.cumsum(weights[bucket], axis=0, dtype=np.float64)])
    return (running[start[1:]] - running[start[:-1]]).astype(weights.dtype)


class WordTable:
    """Rows of numbers by word, made for all new words of a batch at once, in bounded memory."""

    def __init__(self, make, width: int, words: int = 250_000, chars: int = 8_000_000) -> None:
        self.make, self.words, self.chars = make, words, chars
        self.rows = np.zeros((1024, width), np.float32)
        self.index: dict[str, int] = {}
        self.held = 0

    def numbers(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """(index of each word of all texts into ``rows``, where each text begins, with an end mark)."""
        start = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))])
        distinct = set().union(*texts)
        fresh = [w for w in distinct if w not in self.index]
        if fresh:
            more = sum(map(len, fresh))
            if len(self.index) + len(fresh) > self.words or self.held + more > self.chars:
                self.index, self.held = {}, 0
                fresh = list(distinct)
                more = sum(map(len, fresh))
            at = len(self.index)
            while at + len(fresh) > len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            self.rows[at : at + len(fresh)] = self.make(fresh)
            self.index.update(zip(fresh, range(at, at + len(fresh))))
            self.held += more
        look = self.index.__getitem__
        return np.fromiter((i for t in texts for i in map(look, t)), np.int64, int(start[-1])), start
