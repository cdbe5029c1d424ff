"""The given Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Set by a local session: deal the rows of a table out over so many partitions.
SPREAD = "spark.leafmill.spread"


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table as its files give it. Only where a local session asks for it, small files are dealt out over its cores."""
    table = spark.read.parquet(f"{folder}/{name}.parquet")
    spread = spark.conf.get(SPREAD, None)
    return table.repartition(int(spread)) if spread else table
