"""Readers: slot files, day tables, benchmark and price series, feeds."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import xlsx

#: Positions, in a 27-column slot file, of the columns that are kept.
SLOT_COLUMNS = {1: "stamp", 3: "source", 4: "identifier", 8: "themes", 10: "locations", 15: "tone", 17: "dims"}
SLOT_WIDTH, SLOTS_PER_DAY = 27, 96


def slots(spark: SparkSession, path: str | list[str], encoding: str = "UTF-8") -> DataFrame:
    """Tab-separated slot files without headers: the kept columns as strings, malformed rows dropped, ``slot`` from the file name."""
    schema = T.StructType([T.StructField(f"_c{i}", T.StringType()) for i in range(SLOT_WIDTH)])
    raw = spark.read.csv(path, sep="\t", schema=schema, header=False, mode="DROPMALFORMED", encoding=encoding, quote="", enforceSchema=True)
    kept = [F.col(f"_c{i}").alias(name) for i, name in SLOT_COLUMNS.items()]
    return raw.select(*kept, F.substring(F.col("_metadata.file_name"), 9, 4).alias("slot"))


def slot_times(step: int = 1, offset: int = 0) -> list[str]:
    """HHMM of every ``step``-th of the day's quarter hours."""
    if step < 1 or not 0 <= offset < step:
        raise ValueError("0 <= offset < step is needed")
    return [f"{i // 4:02d}{i % 4 * 15:02d}" for i in range(offset, SLOTS_PER_DAY, step)]


def days(spark: SparkSession, path: str, start: str | None = None, end: str | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """A day-partitioned table; bounds prune partitions, columns prune the scan."""
    rows = spark.read.parquet(path)
    if start:
        rows = rows.where(F.col("day") >= F.lit(start).cast("date"))
    if end:
        rows = rows.where(F.col("day") <= F.lit(end).cast("date"))
    return rows.select(*columns) if columns else rows


def day_files(spark: SparkSession, path: str, start: str, end: str, pattern: str = r"(\w+)_processed_(\d{8})\.parquet$") -> DataFrame:
    """Files that carry their day in their name, within the bounds."""
    rows = spark.read.parquet(path)
    day = F.to_date(F.regexp_extract(F.col("_metadata.file_path"), pattern, 2), "yyyyMMdd")
    return rows.withColumn("day", day).where(F.col("day").between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def series(spark: SparkSession, path: str | list[str], name: str = "close") -> DataFrame:
    """``day, <name>`` from a CSV whose first column is a date and second a number; bad rows go; of several values of a day the last one stays, by file, place in the file, and line."""
    raw = spark.read.csv(path, header=True, inferSchema=False)
    date, value = raw.columns[:2]
    # Within one split of a file the row numbers of a task go up with its lines.
    at = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("line"))
    rows = raw.select(F.coalesce(F.try_to_date(F.col(date)), F.try_to_date(F.col(date), "MM/dd/yyyy")).alias("day"), F.col(value).try_cast("double").alias(name), at.alias("_at"))
    return rows.where(F.col("day").isNotNull() & F.col(name).isNotNull()).groupBy("day").agg(F.max_by(name, "_at").alias(name))


def benchmark(spark: SparkSession, path: str, value: str, date_pattern: str = "date|day|month") -> DataFrame:
    """A benchmark table whose date column is found by its name: ``day, bench``."""
    if path.endswith(".xlsx"):
        rows = xlsx.sheet(spark, path)
    else:
        rows = spark.read.parquet(path) if path.endswith(".parquet") else spark.read.csv(path, header=True, inferSchema=False)
    named = [c for c in rows.columns if re.search(date_pattern, c, re.I)]
    if not named or value not in rows.columns:
        raise ValueError(f"a date column and {value} are needed, not {rows.columns}")
    return rows.select(F.to_date(named[0]).alias("day"), F.col(value).try_cast("double").alias("bench")).where("day is not null and bench is not null")


def first_existing(spark: SparkSession, paths: Sequence[str]) -> str | None:
    """The first path that the session's file systems have."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        if path.getFileSystem(conf).exists(path):
            return p
    return None


def index_frame(rows: DataFrame, day: str, value: str, **optional: str) -> DataFrame:
    """Canonical index rows: midnight days, numbers or null, the last row of a day; an error if a level is negative."""
    picked = rows.select(
        F.to_date(day).alias("day"), F.col(value).try_cast("double").alias("risk_index"), *[F.col(c).try_cast("double").alias(n) for n, c in optional.items() if c in rows.columns], F.monotonically_increasing_id().alias("_i")
    ).where("day is not null")
    last = picked.groupBy("day").agg(F.max_by(F.struct(*[c for c in picked.columns if c not in ("day", "_i")]), "_i").alias("r")).select("day", "r.*")
    return last.where(F.assert_true(F.coalesce(F.col("risk_index") >= 0, F.lit(True)), "a level is negative").isNull())


def feed_entries(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """Feed entries as JSON lines: ``link, source, title, summary, description, published, updated`` with their coalesced time and text."""
    schema = "link string, source string, tier int, title string, summary string, description string, published timestamp, updated timestamp"
    reader = spark.readStream.schema(schema) if streaming else spark.read.schema(schema)
    rows = reader.json(path)
    return rows.withColumns({"event_time": F.coalesce("published", "updated"), "body": F.coalesce("summary", "description", F.lit(""))})


def synced(spark: SparkSession, path: str, start: str, columns: dict[str, str], needed: str, day: str = "day") -> DataFrame:
    """A CSV product as typed rows: those before ``start`` or without ``needed`` go; what can't be cast is null."""
    raw = spark.read.csv(path, header=True, inferSchema=False)
    rows = raw.select(F.try_to_date(F.col(day)).alias(day), *[F.col(c).try_cast("double").try_cast(t).alias(c) for c, t in columns.items()])
    return rows.where((F.col(day) >= F.lit(start).cast("date")) & F.col(needed).isNotNull())


def freshness(spark: SparkSession, artefacts: dict[str, str]) -> DataFrame:
    """``artefact, files, as_of``: how many data files each folder or file has and when the last was written; 0 and null if it isn't there.

    Only the file system's listing is read: contents are pruned from the scan.
    """
    parts = []
    for name, path in artefacts.items():
        if first_existing(spark, [path]) is None:
            parts.append(spark.range(1).select(F.lit(name).alias("artefact"), F.lit(0).cast("long").alias("files"), F.lit(None).cast("timestamp").alias("as_of")))
            continue
        listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
        parts.append(listed.agg(F.count("*").alias("files"), F.max("modificationTime").alias("as_of")).select(F.lit(name).alias("artefact"), "files", "as_of"))
    return reduce(DataFrame.unionByName, parts)
