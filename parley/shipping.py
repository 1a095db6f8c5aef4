"""Sending this package to the Python workers of a cluster that does not have it installed."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

import parley


def ship(spark: SparkSession) -> None:
    """Adds the package's source to the session's Python files, once for each context."""
    context = spark.sparkContext
    if getattr(context, "_parley_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(parley.__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="parley-"), "parley.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("parley", os.path.relpath(full, root)))
    context.addPyFile(path)
    context._parley_shipped = True
