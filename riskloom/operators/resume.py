"""Long batches in ranges of days that are committed one by one: a run that died goes on where it stopped."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import readers, writers

Range = tuple[date, date]
LOG = "start string, end string, parameters string, rows long"


def ranges(start: date, end: date, days: int = 30) -> list[Range]:
    """Ranges of ``days`` days that cover ``start`` to ``end``, both included."""
    if start > end or days < 1:
        raise ValueError("start <= end and days >= 1 are needed")
    out = []
    while start <= end:
        out.append((start, min(end, start + timedelta(days - 1))))
        start += timedelta(days)
    return out


def done(spark: SparkSession, path: str, parameters: str = "") -> set[tuple[str, str]]:
    """Ranges that a run with these parameters has committed (one short row a range)."""
    if not readers.first_existing(spark, [f"{path}/log"]):
        return set()
    log = spark.read.schema(LOG).parquet(f"{path}/log").where(F.col("parameters") == parameters)
    return {(r["start"], r["end"]) for r in log.select("start", "end").distinct().collect()}


def run(spark: SparkSession, path: str, todo: Sequence[Range], work: Callable[[date, date], DataFrame], parameters: str = "") -> DataFrame:
    """The rows of ``work(first, last)`` of all ranges, each worked out once however often the run is started.

    The rows of a range are written before it is entered in the log, in a
    folder of its own that an unfinished attempt may have left and the next
    one overwrites. Ranges of other parameters don't count as done.
    """
    finished = done(spark, path, parameters)
    folders = []
    for first, last in todo:
        a, b = first.isoformat(), last.isoformat()
        folder = f"{path}/rows/{a}_{b}"
        folders.append(folder)
        if (a, b) in finished:
            continue
        rows = work(first, last)
        rows.write.mode("overwrite").parquet(folder)
        n = spark.read.parquet(folder).count()
        writers.append(spark.createDataFrame([(a, b, parameters, n)], LOG), f"{path}/log")
    return spark.read.parquet(*folders)
