"""Makes this package importable for a session's Python workers."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Sends the package to all executors, once a SparkContext, as ``spark-submit --py-files`` does."""
    context = spark.sparkContext
    if getattr(context, "_pulselake_shipped", False):
        return
    home = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="pulselake-")) / "pulselake.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(home.rglob("*.py")):
            z.write(p, str(p.relative_to(home.parent)))
    context.addPyFile(str(target))
    context._pulselake_shipped = True
