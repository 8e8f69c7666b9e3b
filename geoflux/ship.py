"""Makes this package importable in Python workers that do not share the driver's folders."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Sends the package's source to the executors, once for each application."""
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        top = Path(__file__).resolve().parent
        path = Path(tempfile.mkdtemp(prefix="ship-")) / "geoflux.zip"
        with zipfile.ZipFile(path, "w") as z:
            for p in sorted(top.rglob("*.py")):
                z.write(p, f"geoflux/{p.relative_to(top)}")
        sc.addPyFile(str(path))
        _shipped.add(sc.applicationId)
    return spark
