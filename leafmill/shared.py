"""Intermediate tables on the folder that driver and executors share.

The folder is the one the cluster names in ``spark.checkpoint.dir``. Only a ``local`` master, whose
driver and executors are one process, may go without: its tables then lie in a folder of this process.
"""

from __future__ import annotations

import atexit
import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []
#: The folder of a local application for which none is set.
_own: dict[str, str] = {}


def shared_base(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir is not set: name a folder that driver and executors share")
    application = spark.sparkContext.applicationId
    if application not in _own:
        _own[application] = f"file://{tempfile.mkdtemp(prefix='leafmill-shared-')}"
    return _own[application]


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path of its own under the shared folder, removed when the application ends."""
    path = f"{shared_base(spark)}/leafmill-{name}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(remove_folders)
    _made.append((spark, path))
    return path


def remove_folders() -> None:
    """Delete what ``shared_folder`` handed out, through Spark's own file systems."""
    while _made:
        spark, path = _made.pop()
        try:
            context = spark.sparkContext
            target = context._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # noqa: BLE001 - the session has gone; the cluster clears its own folder
            continue


def settle(df: DataFrame, name: str = "table", free: bool = False) -> DataFrame:
    """``df`` written once to the shared folder and read back.

    For a result that several passes read: each pass then scans only the columns it needs, and a lost
    executor costs a re-read instead of the whole lineage. ``free``: the shuffles behind it are large, release them.
    """
    path = shared_folder(df.sparkSession, name)
    schema = df.schema
    df.write.parquet(path)
    if free:
        release(df.sparkSession)
    return df.sparkSession.read.schema(schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner remove the shuffle files of finished work now.

    Once a table is written, the shuffles behind it are of no more use; without this they stay until the
    driver happens to collect its garbage. The first collection frees the plans, the second their shuffles.
    """
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)
