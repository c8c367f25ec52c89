"""Makes this package importable where Python workers run."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent


def ship(spark: SparkSession) -> None:
    """Once for each Spark context: workers on this machine get the package's folder on their path, and
    those of a cluster a zip of its sources through Spark's own file server."""
    sc = spark.sparkContext
    if sc.environment.get("TONELAKE_SHIPPED"):
        return
    sc.environment["TONELAKE_SHIPPED"] = "1"
    path = [p for p in sc.environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    sc.environment["PYTHONPATH"] = os.pathsep.join([*path, str(ROOT.parent)])
    if not sc.master.startswith("local["):
        target = Path(tempfile.mkdtemp(prefix="tonelake-")) / "tonelake_sources.zip"
        with zipfile.ZipFile(target, "w") as z:
            for f in sorted(ROOT.rglob("*.py")):
                z.write(f, f.relative_to(ROOT.parent))
        sc.addPyFile(str(target))
