"""Tables written between steps, in the folder that the cluster shares.

A step that is written and read again survives lost executors and cuts the lineage. The folder is
``spark.checkpoint.dir``; only where that is unset and all tasks run in this process's machine
(a ``local`` master) a local folder is used.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of this session."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + os.path.join(tempfile.gettempdir(), "millrace-scratch")
    return root.rstrip("/")


_scopes: list[list[str]] = []


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below this application's part of the shared folder."""
    path = f"{scratch_root(spark)}/millrace/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    return path


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Delete the tables staged inside when it ends; what was computed from them must be written by then."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def without(docs: DataFrame, bad: DataFrame, id_col: str) -> DataFrame:
    """docs, all columns, but for the rows whose id is in the one column of ``bad``. Rows without id stay."""
    name = f"_{uuid.uuid4().hex}"  # no column of docs has it
    bad = staged(bad.toDF(name).where(F.col(name).isNotNull()).distinct(), "dropped")
    return docs.join(bad.hint("merge"), docs[id_col] == bad[name], "left_anti")


def staged(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back."""
    spark = df.sparkSession
    path = new_path(spark, name)
    writer = df.write.partitionBy(partition_by) if partition_by else df.write
    writer.parquet(path)
    if partition_by:
        return spark.read.parquet(path).select(*df.columns)
    return spark.read.schema(df.schema).parquet(path)
