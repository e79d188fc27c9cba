"""The package on every Python worker, wherever the driver was started."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

import memloom


def ship(spark: SparkSession) -> None:
    """Send the package's source files to the workers, once a context."""
    context = spark.sparkContext
    if getattr(context, "_memloom_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(memloom.__file__))
    # The driver's own copy; Spark serves it to the executors.
    path = os.path.join(tempfile.mkdtemp(prefix="memloom-"), "memloom.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, files in sorted(os.walk(root)):
            for name in sorted(files):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("memloom", os.path.relpath(full, root)))
    context.addPyFile(path)
    context._memloom_shipped = True
