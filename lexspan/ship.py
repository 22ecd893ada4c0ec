"""Sends the package to executors that cannot import it from a path of their own."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession

_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
_done: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds the package to the application's Python files, once; the session itself copies it to every executor."""
    app = spark.sparkContext.applicationId
    if app in _done:
        return
    _done.add(app)
    folder = tempfile.mkdtemp(prefix="lexspan-")
    top = os.path.join(folder, "tree")
    shutil.copytree(os.path.join(_ROOT, "lexspan"), os.path.join(top, "lexspan"), ignore=shutil.ignore_patterns("__pycache__"))
    spark.sparkContext.addPyFile(shutil.make_archive(os.path.join(folder, "lexspan_package"), "zip", top))
