"""The library for executors that don't have it installed."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> str:
    """Send this package's modules to all executors of the session, present and later ones; the archive's path.

    Spark copies the archive from the driver. Where the package is installed on every machine, this isn't needed.
    """
    root = Path(__file__).parent
    path = os.path.join(tempfile.mkdtemp(prefix="fieldmark-ship-"), "fieldmark.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for module in sorted(root.rglob("*.py")):
            out.write(module, module.relative_to(root.parent))
    spark.sparkContext.addPyFile(path)
    return path
