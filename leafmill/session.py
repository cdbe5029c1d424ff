"""The session used by tests and the bench; a cluster brings its own."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession


def local_session(cpus: int | str = 8, memory: str = "4g") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("leafmill")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # Local runs only: small shuffles with Python steps still use every core.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "32k")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.codegen.cache.maxEntries", "1000")
        # One small file would leave all cores but one idle.
        .config("spark.leafmill.spread", str(cpus))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once per application: Python steps import it there."""
    context = spark.sparkContext
    if getattr(context, "_leafmill_shipped", False):
        return
    package = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="leafmill-")
    archive = shutil.make_archive(f"{folder}/leafmill", "zip", root_dir=package.parent, base_dir=package.name)
    context.addPyFile(archive)
    context._leafmill_shipped = True
