"""Gives executors this package where they don't have it installed."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path
from threading import Lock

from pyspark.sql import SparkSession

_shipped: set[str] = set()
_shipping = Lock()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once for each application, whichever of its threads comes first."""
    with _shipping:
        if (app := spark.sparkContext.applicationId) in _shipped:
            return
        root = Path(__file__).resolve().parents[1]
        path = os.path.join(tempfile.mkdtemp(prefix="spark-barloom-"), f"{root.name}.zip")
        with zipfile.ZipFile(path, "w") as z:
            for file in sorted(root.rglob("*.py")):
                z.write(file, file.relative_to(root.parent))
        spark.sparkContext.addPyFile(path)
        _shipped.add(app)
