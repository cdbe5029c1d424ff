"""The registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from leafmill.llm import bloom_lm, collocations, decontaminate, html_text, minhash, mixing, oracles, packing, spelling, substrings, token_counts, topk, toxicity, warc
from leafmill.llm.prepare import prepared
from leafmill.shared import shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

def query(name: str, sql: str | None = None):
    def register(build: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            prepared(spark)
            return build(spark, folder)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


@query("op6_substring_dedup", oracles.REMOVALS_SQL)
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return substrings.removals(read(spark, folder, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


@query("op5_minhash_near_dedup", oracles.GROUPS_SQL)
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.groups(read(spark, folder, "documents"), size=3, share=(85, 100))


@query("op8_toxicity")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.scores(read(spark, folder, "documents"), read(spark, folder, "labels"))


@query("op9_benchmark_decontamination")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.passages(read(spark, folder, "documents"), read(spark, folder, "benchmark"))


@query("op1_source_mixing", oracles.MIXING_SQL)
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mixed(read(spark, folder, "documents"))


@query("op2_token_counts")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.token_counts(read(spark, folder, "documents"), shared_folder(spark, "token-cache"))


@query("op3_warc", oracles.WARC_SQL)
def op3(spark: SparkSession, folder: str) -> DataFrame:
    path = shared_folder(spark, "warc")
    warc.write(read(spark, folder, "pages"), path)
    records = warc.read(spark, path, payloads=False)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "error")


@query("op4_token_packing")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return packing.packed(read(spark, folder, "documents"))


@query("op7_exact_top_k", oracles.TOP_SQL)
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return topk.top_k(read(spark, folder, "embeddings"), 5, F.col("vec_id") % 50 == 0)


@query("op10_html_extraction", oracles.MAIN_TEXT_SQL)
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return html_text.main_texts(read(spark, folder, "pages"))


@query("op11_lm_scoring")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    held_out = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(7)) == 2
    found = bloom_lm.scores(read(spark, folder, "documents"), ~held_out)
    return found.select("doc_id", (~F.col("_train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query("op12_phrase_collocations", oracles.COLLOCATIONS_SQL)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(read(spark, folder, "documents"))


@query("op13_spelling_variants")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.variants(read(spark, folder, "documents"))


@query("pipeline")
def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    return corpus_pipeline.run(spark, folder)
