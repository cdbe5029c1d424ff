"""Keyed tables in buckets of a key hash, of which a change rewrites only those it touches.

``data/version=N/bucket=B`` holds bucket B as change N left it; ``manifest/number=N`` lists the version that is live for
each bucket. A change writes its buckets beside the old ones and then its manifest; the manifest with the highest number
that is complete is the table. So a reader sees a change whole or not at all, and a change that was cut off is simply made again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKETS = 256


class BucketTable:
    """``path`` must be a folder of its own on storage that all executors share. One writer at a time."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, keys: Sequence[str], version: Sequence[str], buckets: int = BUCKETS):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self.keys, self.version, self.buckets = list(keys), list(version), buckets

    def _folder(self, path: str):
        context = self.spark.sparkContext
        target = context._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(context._jsc.hadoopConfiguration()), target

    def number(self) -> int:
        """The highest complete manifest; -1 without any."""
        files, folder = self._folder(f"{self.path}/manifest")
        if not files.exists(folder):
            return -1
        found = [int(s.getPath().getName().partition("=")[2]) for s in files.listStatus(folder) if s.getPath().getName().startswith("number=")]
        whole = [n for n in found if files.exists(self._folder(f"{self.path}/manifest/number={n}/_SUCCESS")[1])]
        return max(whole, default=-1)

    def manifest(self) -> tuple[int, int, dict[int, int]]:
        """Its number, the last batch that is in the table, and the live version of each bucket."""
        number = self.number()
        if number < 0:
            return -1, -1, {}
        rows = self.spark.read.schema("bucket INT, version BIGINT, batch BIGINT").parquet(f"{self.path}/manifest/number={number}").collect()
        return number, max(r["batch"] for r in rows), {r["bucket"]: r["version"] for r in rows if r["bucket"] >= 0}

    def read(self, only: Sequence[int] | None = None) -> DataFrame:
        """The table, or some of its buckets. However many changes there were, one folder is read for each bucket."""
        _, _, live = self.manifest()
        paths = [f"{self.path}/data/version={v}/bucket={b}" for b, v in sorted(live.items()) if only is None or b in set(only)]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def bucketed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("bucket", F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int"))

    def upsert(self, changes: DataFrame, batch: int | None = None) -> list[int]:
        """Put changes in, for each key the row with the highest version staying; gives the buckets that were rewritten.

        ``batch``: the number of a batch of changes; one that is in the table already is left out. ``changes`` are read
        twice, so they are best a written table.
        """
        number, done, live = self.manifest()
        if batch is not None and batch <= done:
            return []
        columns = self.schema.fieldNames()
        touched = [r["bucket"] for r in self.bucketed(changes).select("bucket").distinct().collect()]
        rows = self.bucketed(self.read(touched).select(*columns).unionByName(changes.select(*columns)))
        rest = [c for c in columns if c not in self.keys]
        newest = rows.groupBy("bucket", *self.keys).agg(F.max_by(F.struct(*rest), F.struct(*self.version)).alias("_row"))
        merged = newest.select("bucket", *self.keys, "_row.*").select("bucket", *columns)
        # Adaptive execution packs small buckets into a task and cuts large ones.
        merged.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/version={number + 1}")
        live |= dict.fromkeys(touched, number + 1)
        # The row of bucket -1 keeps the batch of a table without buckets.
        rows_ = [(-1, -1, done if batch is None else batch), *[(b, v, -1) for b, v in sorted(live.items())]]
        self.spark.createDataFrame(rows_, "bucket INT, version BIGINT, batch BIGINT").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/number={number + 1}")
        return sorted(touched)

    def remove_old(self) -> None:
        """Delete manifests and buckets that are no longer live; not while someone still reads an older state."""
        number, _, live = self.manifest()
        kept = set(live.items())
        files, folder = self._folder(f"{self.path}/data")
        if number < 0 or not files.exists(folder):
            return
        for version in files.listStatus(folder):
            v = int(version.getPath().getName().partition("=")[2])
            for bucket in files.listStatus(version.getPath()):
                name = bucket.getPath().getName()
                if v <= number and name.startswith("bucket=") and (int(name.partition("=")[2]), v) not in kept:
                    files.delete(bucket.getPath(), True)
        for old in files.listStatus(self._folder(f"{self.path}/manifest")[1]):
            if int(old.getPath().getName().partition("=")[2]) < number:
                files.delete(old.getPath(), True)
