"""Sessions: the settings the library is run with, and its code on the executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def session(cores: str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and benchmarks."""
    settings = {
        "spark.sql.shuffle.partitions": str(partitions), "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false",
        "spark.driver.memory": "12g", "spark.sql.adaptive.enabled": "true", "spark.ui.showConsoleProgress": "false",
    }
    return SparkSession.builder.master(f"local[{cores}]").config(map=settings | conf).getOrCreate()


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors, once for each Spark application."""
    app = spark.sparkContext.applicationId
    if getattr(ship, "app", None) != app:
        root = Path(__file__).resolve().parent
        path = Path(tempfile.mkdtemp(prefix="spark-code-")) / "quotemill.zip"
        with zipfile.ZipFile(path, "w") as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f.relative_to(root.parent).as_posix())
        spark.sparkContext.addPyFile(str(path))
        ship.app = app
    return spark
