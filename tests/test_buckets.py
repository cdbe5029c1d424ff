"""Tables in buckets: only touched buckets are rewritten, changes are whole, reads do not grow with the changes."""

import random
from pathlib import Path

from leafmill.shared import shared_folder
from leafmill.sources.buckets import BucketTable
from leafmill.streaming import tables

SCHEMA = "k string, v string, at bigint"


def files_of(path):
    return {p for p in Path(path.removeprefix("file://")).rglob("*.parquet")}


def bucket_table(spark, buckets=8):
    path = shared_folder(spark, "test-buckets")
    return BucketTable(spark, path, spark.createDataFrame([], SCHEMA).schema, ["k"], ["at"], buckets), path


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_untouched_buckets_keep_their_files(spark):
    table, path = bucket_table(spark)
    first = [(f"key{i}", "old", 1) for i in range(100)]
    assert len(table.upsert(spark.createDataFrame(first, SCHEMA))) == 8
    live = {p for p in files_of(f"{path}/data")}
    touched = table.upsert(spark.createDataFrame([("key7", "new", 2), ("key7", "older", 0), ("fresh", None, 2)], SCHEMA))
    assert 1 <= len(touched) <= 2 and live <= files_of(f"{path}/data")
    want = sorted([r for r in first if r[0] != "key7"] + [("key7", "new", 2), ("fresh", None, 2)])
    assert rows_of(table.read()) == want
    table.remove_old()
    kept = {p for p in live if f"bucket={touched[0]}/" not in str(p) and f"bucket={touched[-1]}/" not in str(p)}
    assert live & files_of(f"{path}/data") == kept and rows_of(table.read()) == want


def test_a_change_is_whole_or_not_there(spark):
    table, path = bucket_table(spark)
    table.upsert(spark.createDataFrame([("a", "1", 1), ("b", "1", 1)], SCHEMA), batch=0)
    # A writer that was lost after its data and before its manifest.
    spark.createDataFrame([("a", "lost", 9)], SCHEMA).selectExpr("*", "0 AS bucket").write.partitionBy("bucket").parquet(f"{path}/data/version=1")
    Path(f"{path.removeprefix('file://')}/manifest/number=1").mkdir()
    assert rows_of(table.read()) == [("a", "1", 1), ("b", "1", 1)]
    assert table.upsert(spark.createDataFrame([("a", "2", 2)], SCHEMA), batch=1) and not table.upsert(spark.createDataFrame([("a", "3", 3)], SCHEMA), batch=1)
    assert rows_of(table.read()) == [("a", "2", 2), ("b", "1", 1)]


def test_empty_changes(spark):
    table, _ = bucket_table(spark)
    assert rows_of(table.read()) == [] and table.upsert(spark.createDataFrame([], SCHEMA), batch=3) == []
    assert rows_of(table.read()) == [] and table.manifest()[1] == 3


def test_a_long_stream_is_read_from_few_folders(spark):
    chance = random.Random(3)
    rows = [(f"key{chance.randrange(30)}", str(i), i) for i in range(300)]
    source, path = shared_folder(spark, "test-changes"), shared_folder(spark, "test-upserts")
    schema = spark.createDataFrame([], SCHEMA).schema
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    want = {}
    for part in range(2):
        for i in range(5):
            spark.createDataFrame(rows[(5 * part + i) * 30 : (5 * part + i + 1) * 30], SCHEMA).coalesce(1).write.mode("append").parquet(source)
        for k, v, at in rows[150 * part : 150 * (part + 1)]:
            want[k] = (k, v, at)
        found = tables.upsert_stream(stream(), path, ["k"], ["at"], every=4, buckets=4)
        assert rows_of(found) == sorted(want.values())
        assert len(tables.folders(spark, path)) < 4
