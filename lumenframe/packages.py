"""The library on executors that don't have it: a zip of its modules, sent with the session."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> str:
    """Sends this package to the session's executors, for tasks that run its Python; returns the zip's path on the driver. Not needed where it is installed everywhere."""
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="lumenframe-")) / "lumenframe.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(target))
    return str(target)
