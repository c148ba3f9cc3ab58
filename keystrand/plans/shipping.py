"""Sending the package to Python workers."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Add the package to the session's Python files, once, so that workers find it wherever the driver was started."""
    context = spark.sparkContext
    if getattr(context, "_keystrand_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    folder = os.path.realpath(tempfile.mkdtemp(prefix="keystrand-ship-"))
    atexit.register(shutil.rmtree, folder, ignore_errors=True)  # the driver serves the file from there
    where = os.path.join(folder, "keystrand.zip")
    with zipfile.ZipFile(where, "w") as archive:
        for p in sorted(package.rglob("*.py")):
            archive.write(p, p.relative_to(package.parent))
    context.addPyFile(where)
    context._keystrand_shipped = True
