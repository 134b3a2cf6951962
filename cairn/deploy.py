"""Getting the package to the executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once a context, so that their Python workers can import it wherever they were started."""
    sc = spark.sparkContext
    if getattr(sc, "_cairn_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    path = os.path.join(tempfile.mkdtemp(), "cairn.zip")
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted((root / "cairn").rglob("*.py")):
            z.write(f, f.relative_to(root))
    sc.addPyFile(path)
    sc._cairn_shipped = True
