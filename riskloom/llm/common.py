"""Shared plumbing of the text operators: tables, Arrow stages, shared storage."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes handed to a text function at once; a longer row stands alone.
ROWS, BYTES = 512, 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, read by Spark so that any file system works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fill: bool = True) -> DataFrame:
    """``doc_id`` (long) and ``text`` alone, so that extra columns can't clash; ``fill`` makes null texts empty."""
    text = F.col(text_col).cast("string")
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.coalesce(text, F.lit("")) if fill else text).alias("text"),
    )


def row_bytes(batch: pa.RecordBatch) -> np.ndarray:
    """Bytes of text and binary content of each row."""
    total = np.zeros(batch.num_rows, np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
            total += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    return total


def pieces(batches: Iterator[pa.RecordBatch], rows: int = ROWS, size: int = BYTES) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut into slices of at most ``rows`` rows and, but for single rows, ``size`` bytes."""
    for batch in batches:
        ends = np.cumsum(row_bytes(batch))
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            fit = int(np.searchsorted(ends, before + size, side="right")) - at
            n = max(1, min(rows, fit))
            yield batch.slice(at, n)
            at += n


_held: list = [None, None]


def trim() -> None:
    """Hand freed memory back to the system, where the C library can."""
    gc.collect()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass


def held(owner: object, make: Callable):
    """The one model, with its caches, that a worker keeps: made anew, and the last one dropped, when ``owner`` is another."""
    if _held[0] is not owner:
        if _held[0] is not None:
            _held[:] = None, None
            trim()
        _held[:] = owner, make()
    return _held[1]


def crc_mod(id_col: str, modulus: int) -> Column:
    """``crc32(id as text) mod modulus``: the fold of a row (null for a null id)."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(modulus))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only a session on one machine (tests) may go without: it gets a temporary
    folder. On a cluster the lack of one is an error.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = context.getCheckpointDir()
    if not named:
        if not context.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="riskloom-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(named)
    return named


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder through Spark's file systems."""
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def run_folder(spark: SparkSession, name: str) -> str:
    """A new folder of one run in the shared folder; it goes with the driver, if not removed before."""
    folder, context = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(context._jsc.hadoopConfiguration())
    files.mkdirs(path)
    files.deleteOnExit(path)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read back: its lineage is cut and survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def keep_rows(docs: DataFrame, decide: Callable[[list, list], list], id_col: str = "doc_id") -> DataFrame:
    """``docs`` with all its columns, without the rows for which ``decide(ids, texts)`` says False."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            ids = batch.column(batch.schema.get_field_index(id_col)).to_pylist()
            body = batch.column(batch.schema.get_field_index("text")).to_pylist()
            yield batch.filter(pa.array(decide(ids, body), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


class BoundedCache(dict):
    """A dict that computes missing values and keeps two generations of them.

    When the young generation is full it becomes the old one, whose entries
    return on use; frequent keys so survive. Keys of over 64 characters are
    not kept, so ``limit`` entries bound the bytes too.
    """

    def __init__(self, make: Callable, limit: int) -> None:
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
            if len(key) > 64:
                return value
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


def read_bytes(path: str) -> bytes:
    """A small vocabulary file, read on the driver (its size is fixed by the tokenizer)."""
    with open(os.fspath(path), "rb") as f:
        return f.read()
