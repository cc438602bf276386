"""Brings the package to Python workers that cannot import it."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Adds the package to the context's Python files, once; Spark's own file server hands it to executors."""
    context = spark.sparkContext
    if getattr(context, "_tidefold_shipped", False):
        return
    root = Path(__file__).resolve().parent.parent
    folder = Path(tempfile.mkdtemp(prefix="tidefold-")).resolve()
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    target = folder / "tidefold.zip"
    with zipfile.ZipFile(target, "w") as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, path.relative_to(root.parent))
    context.addPyFile(str(target))
    context._tidefold_shipped = True
