"""Row keys that hold for null and repeated document ids, and clean column lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Stands for a null id inside a job.
NO_ID = -(2**63)


def id_or_none(column: Column | str) -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(NO_ID))


def real_id(column: Column | str) -> Column:
    column = F.col(column) if isinstance(column, str) else column
    return F.when(column != NO_ID, column)


def texts(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", *more: str) -> DataFrame:
    """``_id``, ``_text`` (null: empty) and the named columns alone, so that other columns cannot clash."""
    return docs.select(
        id_or_none(F.col(id_column).cast("bigint")).alias("_id"),
        F.coalesce(F.col(text_column), F.lit("")).alias("_text"), *more,
    )


def text_key(text_column: str = "text") -> Column:
    """With the id the key of a row: rows that share both are the same document."""
    return F.xxhash64(F.coalesce(F.col(text_column), F.lit("")))


def with_keys(docs: DataFrame, keys: DataFrame, how: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id (null is an id like any other) and text are in (``left_semi``) or not in (``left_anti``) the ``_id, _copy`` of ``keys``."""
    keys = keys.select(F.col("_id").alias("_gone"), F.col("_copy").alias("_gone_copy"))
    return docs.join(keys, id_or_none(F.col(id_column).cast("bigint")).eqNullSafe(id_or_none("_gone")) & (text_key(text_column) == F.col("_gone_copy")), how)
