"""Makes this package importable where tasks run."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_ROOT = Path(__file__).resolve().parent
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once for each application, unless PYTHONPATH has it already."""
    app = spark.sparkContext.applicationId
    paths = [os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if app in _shipped or str(_ROOT.parent) in paths:
        return
    _shipped.add(app)
    at = Path(os.path.realpath(tempfile.mkdtemp(prefix="certloom-"))) / "certloom.zip"
    with zipfile.ZipFile(at, "w") as z:
        for f in sorted(_ROOT.rglob("*.py")):
            z.write(f, f.relative_to(_ROOT.parent))
    spark.sparkContext.addPyFile(str(at))
