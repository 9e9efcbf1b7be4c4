"""The package's code for Python workers, wherever they run."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package to the session's executors, once a Spark application, as spark-submit --py-files would."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        package = Path(__file__).resolve().parents[1]
        place = os.path.join(tempfile.mkdtemp(prefix="spark-code-"), f"{package.name}.zip")
        with zipfile.ZipFile(place, "w") as z:
            for f in sorted(package.rglob("*.py")):
                z.write(f, f.relative_to(package.parent))
        spark.sparkContext.addPyFile(place)
        _shipped.add(app)
    return spark
