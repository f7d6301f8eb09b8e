"""A session with the settings that the engine's results rely on."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def session(cores: str | int = "*", shuffle_partitions: int | None = None, **settings: str) -> SparkSession:
    """A local session; on a cluster the submitter's settings win."""
    builder = SparkSession.builder.appName("causeway")
    if "SPARK_MASTER" not in os.environ:
        builder = builder.master(f"local[{cores}]")
    for key, value in (SETTINGS | settings).items():
        builder = builder.config(key, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package where neither their folder nor PYTHONPATH has it."""
    root = Path(__file__).resolve().parent.parent
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    _SHIPPED.add(context.applicationId)
    known = {Path.cwd(), *(Path(p).resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p)}
    if root not in known:
        folder = Path(tempfile.mkdtemp(prefix="causeway-ship-"))
        with zipfile.ZipFile(folder / "causeway.zip", "w") as out:
            for path in sorted((root / "causeway").rglob("*.py")):
                out.write(path, path.relative_to(root))
        context.addPyFile(str(folder / "causeway.zip"))  # Spark hands it to the executors
