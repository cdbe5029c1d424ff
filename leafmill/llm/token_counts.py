"""Token counts through a digest cache.

The cache is a table of (content digest, tokenizer digest, count). Texts are joined to it by both digests;
of the texts it does not know, each distinct one is encoded once and appended. The content digest is that of
the normalised text, and normalisation is the tokenizer's own: the models here take text as it is.

The tokenizer digest covers the vocabulary file and the library's version, so a cache can serve several
tokenizers and is never wrong after an update. Appends are Parquet files of one job; a job that fails leaves
none, and the same count written twice by two jobs is read once.

A text copied to a third of all rows is one row after the map-side combined aggregate. A task encodes a few
megabytes of text, or one document, at a time; texts are never cut.

Defined results: null text counts as empty, 0 tokens and 0 bytes; null ids come back as they are; repeated rows
get one row each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from pathlib import Path

import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.words import slices
from leafmill.shared import release

MODEL = "piece_bpe_32k.model"
LIMIT = 4096
CACHE = "content string, tokenizer string, n_tokens bigint"

Counter = Callable[[list[str]], list[int]]


@lru_cache(maxsize=2)
def _pieces(path: str) -> sentencepiece.SentencePieceProcessor:
    return sentencepiece.SentencePieceProcessor(model_file=path)


def piece_counter(path: str) -> Counter:
    return lambda texts: [len(ids) for ids in _pieces(path).encode(texts, num_threads=1)]


def tokenizer_digest(path: str) -> str:
    return hashlib.sha256(Path(path).read_bytes() + sentencepiece.__version__.encode()).hexdigest()


def encoded(missing: DataFrame, path: str) -> DataFrame:
    """``content, n_tokens`` of each row of ``content, text``."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = piece_counter(path)
        for batch in batches:
            for at, to in slices(batch["text"], 1 << 18):
                part = batch.slice(at, to - at)
                yield pa.record_batch([part["content"], pa.array(count(part["text"].to_pylist()), pa.int64())], ["content", "n_tokens"])

    return missing.mapInArrow(scan, "content string, n_tokens bigint")


def add_missing(docs: DataFrame, cache: str, path: str | None = None, text_column: str = "text") -> None:
    """Encode the distinct texts of ``docs`` that the cache at ``cache`` lacks, and append their counts to it."""
    spark = docs.sparkSession
    path = path or public_tokenizers.path(MODEL)
    version = tokenizer_digest(path)
    text = F.coalesce(F.col(text_column), F.lit(""))
    texts = docs.select(F.sha2(text, 256).alias("content"), text.alias("text"))
    known = cached(spark, cache).filter(F.col("tokenizer") == version).select("content")
    distinct = texts.join(known, "content", "left_anti").groupBy("content").agg(F.any_value("text").alias("text"))
    counts = encoded(distinct, path).select("content", F.lit(version).alias("tokenizer"), "n_tokens")
    counts.write.mode("append").parquet(cache)
    release(spark)


def cached(spark, cache: str) -> DataFrame:
    """The cache's rows; none where nothing has been written yet."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(cache)
    there = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)
    return spark.read.schema(CACHE).parquet(cache) if there else spark.createDataFrame([], CACHE)


def token_counts(
    docs: DataFrame, cache: str, path: str | None = None, limit: int = LIMIT, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Per row of ``docs``: its bytes, its tokens, whether they are more than ``limit``. Adds what the cache lacks."""
    path = path or public_tokenizers.path(MODEL)
    add_missing(docs, cache, path, text_column)
    known = cached(docs.sparkSession, cache).filter(F.col("tokenizer") == tokenizer_digest(path))
    counts = known.groupBy("content").agg(F.any_value("n_tokens").alias("n_tokens"))
    text = F.coalesce(F.col(text_column), F.lit(""))
    rows = docs.select(F.col(id_column), F.sha2(text, 256).alias("content"), F.octet_length(text).cast("bigint").alias("n_bytes"))
    return rows.join(counts, "content").select(id_column, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
