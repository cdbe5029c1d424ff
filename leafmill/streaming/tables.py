"""Streams into tables on the cluster's shared folder.

Every sink is idempotent: a micro-batch that runs again overwrites its own folder, so a lost
executor or a restarted query neither loses nor doubles rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from leafmill.shared import shared_folder  # noqa: F401 - part of this module's interface
from leafmill.sources.buckets import BucketTable

#: So many micro-batches of changes are put into the table at once.
COMPACT_EVERY = 20


def batch_tables(stream: DataFrame, path: str, build: Callable[[DataFrame], DataFrame], *, format: str = "parquet"):
    """Write ``build(micro-batch)`` under ``path/batch=N`` for everything available now; returns the finished query."""
    def write(batch: DataFrame, number: int) -> None:
        build(batch).write.mode("overwrite").format(format).save(f"{path}/rows/batch={number}")

    query = (
        stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return query


def append_table(stream: DataFrame, path: str, *, format: str = "parquet"):
    """Append the rows a stream finalises."""
    query = (
        stream.writeStream.format(format).outputMode("append").option("path", f"{path}/rows")
        .option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return query


def latest(rows: DataFrame, keys: Sequence[str], version: Sequence[str]) -> DataFrame:
    """The current row of each key from an append-only change table."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*version)).alias("_row"))
    return best.select(*keys, "_row.*")


def upsert_stream(stream: DataFrame, path: str, keys: Sequence[str], version: Sequence[str], every: int = COMPACT_EVERY, buckets: int = 64,
                  accept: Callable[[DataFrame, int], DataFrame] | None = None) -> DataFrame:
    """The current row of each key of a stream of changes.

    A micro-batch writes its changes, folded, to a folder of its own. After every ``every`` of them they are put into a table in buckets
    (``sources.buckets``) in one change and their folders go, so a read meets that table and fewer than ``every`` folders however long
    the stream has run. The table's manifest names the last batch in it: a batch that runs again, before or after, counts once.
    ``accept`` gives the rows of a batch that count.
    """
    spark = stream.sparkSession
    table = BucketTable(spark, f"{path}/table", stream.schema, keys, version, buckets)

    def fold(batch: DataFrame, number: int) -> None:
        _, done, _ = table.manifest()
        if number <= done:
            return
        if accept is not None:
            batch = accept(batch, number)
        latest(batch, keys, version).select(*stream.columns).write.mode("overwrite").parquet(f"{path}/rows/batch={number}")
        if number - done >= every:
            table.upsert(changes_after(spark, path, stream.schema, done), number)
            for old in folders(spark, path):
                if old <= number:
                    _delete(spark, f"{path}/rows/batch={old}")

    query = (
        stream.writeStream.foreachBatch(fold).option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    _, done, _ = table.manifest()
    return latest(table.read().select(*stream.columns).unionByName(changes_after(spark, path, stream.schema, done)), keys, version)


def _files(spark: SparkSession, path: str):
    context = spark.sparkContext
    target = context._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(context._jsc.hadoopConfiguration()), target


def _delete(spark: SparkSession, path: str) -> None:
    files, target = _files(spark, path)
    files.delete(target, True)


def folders(spark: SparkSession, path: str) -> list[int]:
    """The numbers of the batches whose changes lie in folders of their own."""
    files, target = _files(spark, f"{path}/rows")
    if not files.exists(target):
        return []
    return sorted(int(s.getPath().getName().partition("=")[2]) for s in files.listStatus(target) if s.getPath().getName().startswith("batch="))


def changes_after(spark: SparkSession, path: str, schema: StructType, batch: int) -> DataFrame:
    paths = [f"{path}/rows/batch={n}" for n in folders(spark, path) if n > batch]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)
