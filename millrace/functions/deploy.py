"""Makes this package importable in Python workers, wherever the session runs."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

import millrace


def ship(spark: SparkSession) -> SparkSession:
    """Send the package's sources to the executors, once for each context."""
    context = spark.sparkContext
    if getattr(context, "_millrace_shipped", False):
        return spark
    top = os.path.dirname(os.path.abspath(millrace.__file__))
    path = os.path.join(tempfile.mkdtemp(), "millrace_sources.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.join("millrace", os.path.relpath(full, top)))
    context.addPyFile(path)
    context._millrace_shipped = True
    return spark
