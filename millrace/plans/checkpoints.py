"""Cutting the lineage of a driver loop by tables in the cluster's shared folder."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """This application's part of ``spark.checkpoint.dir``; a local folder where that is unset and the master is local."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + os.path.join(tempfile.gettempdir(), "millrace-scratch")
    return f"{root.rstrip('/')}/millrace/{spark.sparkContext.applicationId}"


def put(df: DataFrame) -> str:
    """The place in the shared folder that df was written to."""
    path = f"{folder(df.sparkSession)}/loop-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """df written to and read from the shared folder."""
    return df.sparkSession.read.schema(df.schema).parquet(put(df))


def clear(spark: SparkSession) -> None:
    """Delete all tables that this application has left in the shared folder.

    For the end of a job: results that are not written yet may still read them.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
