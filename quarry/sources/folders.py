"""The folder that driver and executors share."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``.

    Where the session names none, a local one is set if all runs on this machine; a cluster must name one.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = os.path.join(tempfile.gettempdir(), "quarry-shared")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path as it wants it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that is not yet in use; what is written there goes when the driver ends."""
    path = f"{shared_folder(spark)}/quarry-{label}-{uuid.uuid4().hex}"
    files, where = file_system(spark, path)
    files.mkdirs(where)
    files.deleteOnExit(where)
    return path


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: computed once, of a size that the planner knows."""
    path = new_path(df.sparkSession, label)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def state_of(spark: SparkSession, path: str) -> tuple[int, int]:
    """Bytes and latest change of a file or a folder's files."""
    files, where = file_system(spark, path)
    found = files.listStatus(where)
    return sum(f.getLen() for f in found), max((f.getModificationTime() for f in found), default=0)
