"""The named queries and, where SQL can say it, the same query for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from leafmill.plans.fixtures import Inputs, oracle
from leafmill.session import ship

# Counts that DuckDB widens beyond 64 bits, cast back so that both sides have the same type.
WIDE_COUNTS = {
    "title_rule_hits": "suffixes markers shouts", "book_headers": "chapters", "chapter_split_reader": "section",
    "book_corpus_scan": "headings", "chunked_transform_guarded": "rewritten", "job_progress": "finished",
    "compile_outcomes": "chapters skipped failed rate_limited", "discovery_by_job": "items",
    "review_counts": "picked included raw polishable finished", "selection_stats": "youtube podcast blog",
    "paid_call_spend": "cost", "headline_link_count": "headlines", "search_summary": "shown_video shown_web shown_episode",
    "feed_teaser_flag": "teasers", "job_progress_stream": "finished", "spend_per_day_stream": "cost",
    "speaker_turn_page_parse": "turn", "transcript_shape_flags": "words", "transcript_stats": "words",
}


def _narrow(name: str, sql: str) -> str:
    casts = ", ".join(f"cast({c} AS BIGINT) AS {c}" for c in WIDE_COUNTS.get(name, "").split())
    return f"SELECT * REPLACE ({casts}) FROM ({sql}) AS wide" if casts else sql


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, fixtures: str = "", sql: str | None = None):
    def register(build: Callable[[Inputs], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            ship(spark)
            # Stored times are UTC; days and offsets are read in that zone.
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return build(Inputs(spark, folder))

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = _narrow(name, oracle(fixtures, sql))
        return build

    return register
