"""Intermediate tables in the folder that driver and executors share; they go when the application's driver ends."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_leaving: set[str] = set()


def folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a fresh one only where that is unset and the master is local."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        _own[app] = "file://" + tempfile.mkdtemp(prefix="spark-tables-")
    return _own[app]


def own_folder(spark: SparkSession) -> str:
    """This application's part of the shared folder, removed when its driver's JVM ends: results may be read until then."""
    path = f"{folder(spark)}/{spark.sparkContext.applicationId}"
    if path not in _leaving:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(at)
        fs.deleteOnExit(at)
        _leaving.add(path)
    return path


def kept(df: DataFrame, name: str) -> DataFrame:
    """df written as a table and read back: it is computed once, and its plan ends there."""
    spark = df.sparkSession
    path = f"{own_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
