"""Make this package importable in the Python workers of a session."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[1]
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add the package as a zip to the session unless the workers' path has it already (once per context)."""
    sc = spark.sparkContext
    listed = [Path(p or ".").resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT in listed or sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    at = Path(tempfile.mkdtemp(prefix="lodestone-zip-"), "lodestone.zip")
    with zipfile.ZipFile(at, "w") as z:
        for p in sorted((ROOT / "lodestone").rglob("*.py")):
            z.write(p, p.relative_to(ROOT))
    sc.addPyFile(str(at))
