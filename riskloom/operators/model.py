"""Forward-vol models by purged walk-forward folds, on boosted trees in numpy, one task a fold and feature block."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import shared

DEPTH, TREES, RATE, SHARE, FEATURES, LEAST, PENALTY, BINS = 3, 300, 0.05, 0.8, 0.8, 10.0, 2.0, 256
SCHEMA = "block string, day date, target double, naive double, predicted double, high int, probability double"


def boosted(train: np.ndarray, y: np.ndarray, test: np.ndarray, classify: bool = False, trees: int = TREES, seed: int = 0, gains: np.ndarray | None = None) -> np.ndarray:
    """Predictions (probabilities of class 1) for ``test`` by second-order boosting over histograms; ``gains`` is added up by feature."""
    rng, n, p = np.random.default_rng(seed), len(train), train.shape[1]
    both = np.concatenate([train, test])
    edges = [np.unique(np.quantile(train[:, f], np.arange(1, BINS) / BINS)) for f in range(p)]
    bins = np.stack([np.searchsorted(e, both[:, f], side="right") for f, e in enumerate(edges)], axis=1)
    mean = float(y.mean())
    if classify and mean in (0.0, 1.0):
        return np.full(len(test), mean)
    score = np.full(len(both), np.log(mean / (1 - mean)) if classify else mean)
    for _ in range(trees):
        chosen = np.sort(rng.choice(p, max(1, int(FEATURES * p)), replace=False))
        rows = np.flatnonzero(rng.random(n) < SHARE)
        guess = 1 / (1 + np.exp(-score[rows])) if classify else score[rows]
        g, h = guess - y[rows], guess * (1 - guess) if classify else np.ones(len(rows))
        k, node = len(chosen), np.zeros(len(both), np.int64)
        flat = bins[rows][:, chosen] + np.arange(k) * BINS
        for level in range(DEPTH):
            nodes = 1 << level
            at = (flat + node[rows, None] * (k * BINS)).ravel()
            left_g, left_h = (np.bincount(at, np.repeat(v, k), nodes * k * BINS).reshape(nodes, k, BINS).cumsum(2) for v in (g, h))
            all_g, all_h = left_g[:, :1, -1:], left_h[:, :1, -1:]
            right_g, right_h = all_g - left_g, all_h - left_h
            gain = left_g**2 / (left_h + PENALTY) + right_g**2 / (right_h + PENALTY) - all_g**2 / (all_h + PENALTY)
            gain = np.where((left_h >= LEAST) & (right_h >= LEAST), gain, 0.0).reshape(nodes, -1)
            best = gain.argmax(1)
            # A node without a gain sends all its rows to the left.
            won = gain[np.arange(nodes), best]
            bound = np.where(won > 1e-12, best % BINS, BINS)
            if gains is not None:
                np.add.at(gains, chosen[best // BINS], np.maximum(won, 0))
            node = 2 * node + (bins[np.arange(len(both)), chosen[best // BINS][node]] > bound[node])
        leaves = 1 << DEPTH
        sums, weights = (np.bincount(node[rows], v, leaves) for v in (g, h))
        score -= RATE * (sums / (weights + PENALTY))[node]
    return 1 / (1 + np.exp(-score[n:])) if classify else score[n:]


def kept(rows: DataFrame) -> tuple[str, int]:
    """A series (one row a day) written to the shared folder for the tasks to read; its folder and length."""
    folder = shared.run_folder(rows.sparkSession, "series") + "/rows"
    rows.write.parquet(folder)
    return folder, rows.sparkSession.read.parquet(folder).count()


def read(folder: str) -> tuple[list, np.ndarray]:
    """Days and values of a kept series in time order, nulls as NaN; read by a task."""
    fs, path = pafs.FileSystem.from_uri(folder)
    table = pq.read_table(path, filesystem=fs).sort_by("day")
    columns = [c.to_numpy(zero_copy_only=False).astype(float) for c in (table.column(i).combine_chunks() for i in range(1, table.num_columns))]
    return table.column("day").to_pylist(), np.column_stack(columns)


def experiment(
    rows: DataFrame, blocks: Mapping[str, Sequence[str]], target: str, naive: str, horizon: int = 5, min_train: int = 750, step: int = 21, q: float = 0.75, trees: int = TREES
) -> DataFrame:
    """The columns of ``SCHEMA`` for every feature block and every row after ``min_train``.

    Each fold trains on rows whose targets were known when it begins
    (``horizon`` rows are purged), and takes its own upper quantile as the
    class bound. All blocks see the same rows and folds.
    """
    features = sorted({c for columns in blocks.values() for c in columns})
    known = rows.select(F.col("day").cast("date").alias("day"), *[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate([target, naive, *features])]).na.drop().orderBy("day")
    folder, n = kept(known)
    if n <= min_train:
        raise ValueError(f"more than {min_train} complete rows are needed")
    work = [(name, start) for start in range(min_train, n, step) for name in blocks]
    columns = {name: [2 + features.index(c) for c in chosen] for name, chosen in blocks.items()}
    spark = rows.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        days, values = read(folder)
        for batch in batches:
            for k in batch.column(0).to_pylist():
                name, start = work[k]
                until, stop = start - horizon, min(start + step, len(days))
                x, y = values[:, columns[name]], values[:, 0]
                bound = np.quantile(y[:until], q)
                predicted = boosted(x[:until], y[:until], x[start:stop], trees=trees)
                probability = boosted(x[:until], (y[:until] > bound).astype(float), x[start:stop], True, trees)
                out = ([name] * (stop - start), days[start:stop], y[start:stop], values[start:stop, 1], predicted, (y[start:stop] > bound).astype(np.int32), probability)
                kinds = (pa.string(), pa.date32(), pa.float64(), pa.float64(), pa.float64(), pa.int32(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], ["block", "day", "target", "naive", "predicted", "high", "probability"])

    tasks = spark.range(0, len(work), 1, min(len(work), 4 * spark.sparkContext.defaultParallelism))
    return tasks.mapInArrow(run, SCHEMA)


def latest(rows: DataFrame, blocks: Mapping[str, Sequence[str]], target: str, trees: int = TREES, q: float = 0.75, least: int = 100) -> DataFrame:
    """``block, feature, importance, as_of, predicted, probability``: per feature block a model of all rows with a known target, applied to the last row.

    ``importance`` is a feature's share of the gains of all splits. The series is one row a day; a block is one task.
    """
    features = sorted({c for columns in blocks.values() for c in columns})
    chosen = rows.select(F.col("day").cast("date").alias("day"), F.col(target).cast("double").alias("y"), *[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(features)])
    folder, _ = kept(chosen.na.drop(subset=[f"c{i}" for i in range(len(features))]))
    spark, names = rows.sparkSession, list(blocks)
    if spark.read.parquet(folder).where("y IS NOT NULL").count() < least:
        raise ValueError(f"at least {least} rows with a target are needed")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        days, table = read(folder)
        y, values = table[:, 0], table[:, 1:]
        known = ~np.isnan(y)
        for batch in batches:
            for k in batch.column(0).to_pylist():
                own = list(blocks[names[k]])
                x = values[:, [features.index(c) for c in own]]
                gains = np.zeros(len(own))
                predicted = float(boosted(x[known], y[known], x[-1:], trees=trees, gains=gains)[0])
                high = (y[known] > np.quantile(y[known], q)).astype(float)
                probability = float(boosted(x[known], high, x[-1:], True, trees)[0])
                share = gains / (gains.sum() or 1.0)
                n = len(own)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([names[k]] * n), pa.array(own), pa.array(share), pa.array([days[-1]] * n, pa.date32()), pa.array([predicted] * n), pa.array([probability] * n)],
                    ["block", "feature", "importance", "as_of", "predicted", "probability"],
                )

    return spark.range(0, len(names), 1, len(names)).mapInArrow(run, "block string, feature string, importance double, as_of date, predicted double, probability double")
