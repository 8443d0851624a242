"""Tables in versions: a new version is written whole, then one small file is switched to it.

Readers follow the file ``current``, so they see the old table or the new one
and never none: a run that dies leaves an unread version behind, which the
next commit removes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

POINTER = "current"


def _files(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop
    root = hadoop.fs.Path(path)
    return hadoop, root, root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def current(spark: SparkSession, path: str) -> int:
    """The number of the version that stands; -1 if there is none."""
    hadoop, root, files = _files(spark, path)
    pointer = hadoop.fs.Path(root, POINTER)
    if not files.exists(pointer):
        return -1
    stream = files.open(pointer)
    try:
        return int(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def folder(path: str, number: int) -> str:
    return f"{path}/version={number}"


def commit(spark: SparkSession, path: str, number: int, keep: int = 2) -> None:
    """Switch to a version that is written; all but the last ``keep`` go, as do those that were never switched to."""
    hadoop, root, files = _files(spark, path)
    new = hadoop.fs.Path(root, f".{POINTER}.{number}")
    out = files.create(new, True)
    out.write(bytearray(str(number), "ascii"))
    out.close()
    # One rename over the old file: there is no moment without it.
    context = hadoop.fs.FileContext.getFileContext(root.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    overwrite = spark.sparkContext._gateway.new_array(hadoop.fs.Options.Rename, 1)
    overwrite[0] = hadoop.fs.Options.Rename.OVERWRITE
    context.rename(new, hadoop.fs.Path(root, POINTER), overwrite)
    numbers = sorted(int(s.getPath().getName().split("=")[1]) for s in files.listStatus(root) if s.getPath().getName().startswith("version="))
    kept = {n for n in numbers if n <= number}
    kept = set(sorted(kept)[-keep:])
    for n in numbers:
        if n not in kept:
            files.delete(hadoop.fs.Path(root, f"version={n}"), True)


def write(rows: DataFrame, path: str, number: int | None = None) -> int:
    """Write and switch to a new version, which may have been read from the old one."""
    spark = rows.sparkSession
    number = current(spark, path) + 1 if number is None else number
    rows.write.mode("overwrite").parquet(folder(path, number))
    commit(spark, path, number)
    return number


def read(spark: SparkSession, path: str) -> DataFrame:
    """The version that stands now; later commits don't change the rows of this read until it is no longer kept."""
    number = current(spark, path)
    if number < 0:
        raise FileNotFoundError(f"{path} has no version")
    return spark.read.parquet(folder(path, number))
