"""Brings this package to the executors, which may share no folder with the driver."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add the package's source to the application once; Spark's own file server carries it.

    A package that came as an archive already has been shipped by whoever passed it.
    """
    sc = spark.sparkContext
    root = Path(__file__).resolve().parent
    if sc.applicationId in _shipped or not root.is_dir():
        return
    path = Path(tempfile.mkdtemp(prefix="nearfield-")) / "nearfield_package.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for file in sorted(root.rglob("*.py")):
            z.write(file, Path("nearfield") / file.relative_to(root))
    sc.addPyFile(str(path))
    _shipped.add(sc.applicationId)
