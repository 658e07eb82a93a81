"""Make this package importable in the Python workers of a session."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[2]
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors once for each application, unless PYTHONPATH already names its folder."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    _shipped.add(context.applicationId)
    if str(ROOT) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    path = Path(tempfile.mkdtemp(prefix="frameloom-ship-")) / "frameloom.zip"
    with zipfile.ZipFile(path, "w") as archive:
        for file in sorted((ROOT / "frameloom").rglob("*.py")):
            archive.write(file, file.relative_to(ROOT))
    context.addPyFile(str(path))
