"""Themes of texts by their likeness to described prototypes, with an encoder of any make."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator, Mapping, Sequence
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import constants as C

#: Makes, once per worker, a function from texts to their unit vectors.
Encoder = Callable[[], Callable[[Sequence[str]], np.ndarray]]
WORD = re.compile(r"\w+")
#: The ASCII characters that stand in no word, as blanks.
GAPS = {i: " " for i in range(128) if not WORD.match(chr(i))}
DIMENSIONS = 4096
#: Texts whose vectors are held at once.
TOGETHER = 64


def _words(text: str) -> list[str]:
    """Lower-case runs of word characters; those of ASCII texts by a cheaper way."""
    low = text.lower()
    return low.translate(GAPS).split() if low.isascii() else WORD.findall(low)


def hashed_words() -> Callable[[Sequence[str]], np.ndarray]:
    """The default encoder: words dealt to signed cells by a hash, their counts damped, as unit vectors. Whole texts."""

    def encode(texts: Sequence[str]) -> np.ndarray:
        counts = [Counter(_words(text)) for text in texts]
        words = np.array([len(c) for c in counts], dtype=np.int64)
        h = np.fromiter(map(zlib.crc32, map(str.encode, chain.from_iterable(counts))), np.int64, words.sum())
        n = np.fromiter(chain.from_iterable(c.values() for c in counts), np.float64, words.sum())
        cells = np.repeat(np.arange(len(counts)) * DIMENSIONS, words) + h % DIMENSIONS
        out = np.bincount(cells, (1 + np.log(n)) * np.where(h >> 31, 1.0, -1.0), len(counts) * DIMENSIONS)
        out = out.astype(np.float64, copy=False).reshape(len(counts), DIMENSIONS)
        sizes = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, sizes, out=out, where=sizes > 0)

    return encode


def similarities(title: Column, body: Column, encoder: Encoder = hashed_words, described: Mapping[str, str] = C.DESCRIPTIONS) -> Column:
    """Cosine similarity of a text, its title counted twice, with each prototype in their order; all 0 for a blank text.

    The encoder and the prototypes are made once per worker; ``TOGETHER`` texts
    of a batch at a time meet all prototypes in one matrix product.
    """

    @F.pandas_udf("array<double>")
    def compared(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = encoder()
        prototypes = np.asarray(encode(list(described.values()))).T
        for texts in batches:
            known = texts.fillna("").tolist()
            found = np.empty((len(known), prototypes.shape[1]))
            for i in range(0, len(known), TOGETHER):
                found[i : i + TOGETHER] = np.asarray(encode(known[i : i + TOGETHER])) @ prototypes
            found[[not t.strip() for t in known]] = 0.0
            yield pd.Series(list(found))

    first = F.coalesce(title, F.lit(""))
    return compared(F.concat_ws(" ", first, first, F.coalesce(body, F.lit(""))))


def reached(similarity: Column, threshold: float | Column = C.SIMILARITY, codes: Sequence[str] = tuple(C.DESCRIPTIONS)) -> Column:
    """The codes, in their order, whose similarity reaches the threshold."""
    bound = threshold if isinstance(threshold, Column) else F.lit(threshold)
    listed = F.array(*[F.lit(c) for c in codes])
    return F.array_compact(F.transform(similarity, lambda s, i: F.when(s >= bound, F.get(listed, i))))
