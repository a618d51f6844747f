"""Sends this package to the executors, which otherwise find it only where it is installed."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_PACKAGE = os.path.dirname(os.path.abspath(__file__))
_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds the package, zipped, to the session's Python files; once per application."""
    context = spark.sparkContext
    if context.applicationId in _sent:
        return
    target = os.path.join(tempfile.mkdtemp(prefix="spark-"), "tallyframe.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, names in os.walk(_PACKAGE):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, os.path.dirname(_PACKAGE)))
    context.addPyFile(target)
    _sent.add(context.applicationId)
