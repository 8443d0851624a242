"""Run folders in the storage that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; only a session on one machine may go without and gets a temporary folder."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not named:
        if context.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="riskloom-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(named)
    return named


def run_folder(spark: SparkSession, name: str) -> str:
    """A new folder of one run; it goes with the driver."""
    folder, context = f"{root(spark)}/{name}-{uuid.uuid4().hex}", spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(context._jsc.hadoopConfiguration())
    files.mkdirs(path)
    files.deleteOnExit(path)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back, its lineage cut."""
    root(df.sparkSession)
    return df.checkpoint(eager=True)
