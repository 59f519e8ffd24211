"""Make the package importable in Python tasks."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors, once per Spark application."""
    context = spark.sparkContext
    if getattr(context, "_claimsieve_shipped", False):
        return spark
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="claimsieve-")) / "claimsieve.zip"
    with zipfile.ZipFile(archive, "w") as bundle:
        for path in sorted(package.rglob("*.py")):
            bundle.write(path, path.relative_to(package.parent))
    context.addPyFile(str(archive))
    context._claimsieve_shipped = True
    return spark
