"""Make the package importable in Python workers where it is not installed."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_ROOT = Path(__file__).resolve().parent
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors once per application, unless their path has it already."""
    on_path = {os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p}
    app = spark.sparkContext.applicationId
    if app in _shipped or str(_ROOT.parent) in on_path or "site-packages" in _ROOT.parts:
        return
    archive = Path(tempfile.mkdtemp(prefix="spark-ship-")) / f"{_ROOT.name}.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for source in sorted(_ROOT.rglob("*.py")):
            z.write(source, source.relative_to(_ROOT.parent))
    spark.sparkContext.addPyFile(str(archive))
    _shipped.add(app)
