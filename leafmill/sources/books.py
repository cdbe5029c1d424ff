"""Compiled book files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scan_books(spark: SparkSession, path: str) -> DataFrame:
    """One row per Markdown file (file_name, md)."""
    files = spark.read.option("pathGlobFilter", "*.md").option("recursiveFileLookup", "true").text(path, wholetext=True)
    return files.select(F.col("_metadata.file_name").alias("file_name"), F.col("value").alias("md"))


def scan_book_lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of written books with their place (book_id, section, number, line_no, line); a book is never one value."""
    parts = spark.read.schema("book_id STRING, section INT, number BIGINT, text STRING").json(path)
    return parts.select("book_id", "section", "number", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
