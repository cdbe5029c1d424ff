"""Keyed stores: latest value wins, time-limited answers, one-off migrations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEARCH_TTL_S = 6 * 3600
DETAIL_TTL_S = 7 * 86400
TRANSCRIPT_TTL_S = 30 * 86400
# Vendor answers worth keeping.
CACHEABLE = (200, 404)


def request_key(*fields: str) -> Column:
    return F.sha2(F.to_json(F.struct(*fields)), 256)


def upsert(store: DataFrame, changes: DataFrame, keys: Sequence[str], version: Sequence[str]) -> DataFrame:
    """The store after the changes: for each key the row with the highest version."""
    rows = store.unionByName(changes, allowMissingColumns=True)
    rest = [c for c in rows.columns if c not in keys]
    latest = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*version)).alias("_row"))
    return latest.select(*keys, "_row.*").select(*rows.columns)


def guarded_update(items: DataFrame, changes: DataFrame, jobs: DataFrame, column: str) -> DataFrame:
    """Rewrite ``column`` of the changed items, only while their job is still in review."""
    allowed = changes.join(jobs.filter("status = 'reviewing'").select("job_id"), "job_id", "left_semi")
    new = allowed.select("job_id", "id", F.col(column).alias("_new"))
    joined = items.join(new, ["job_id", "id"], "left")
    return joined.withColumn(column, F.coalesce("_new", column)).drop("_new")


def cache_store(calls: DataFrame) -> DataFrame:
    """The latest cacheable answer per key with its time."""
    kept = calls.filter(F.col("status").isin(*CACHEABLE))
    return kept.groupBy("key").agg(F.max("ts_us").alias("stored_us"))


def split_by_cache(requests: DataFrame, cache: DataFrame, ttl_s: int) -> DataFrame:
    """Requests with ``hit``: an answer younger than ``ttl_s`` is in the cache."""
    joined = requests.join(cache, "key", "left")
    fresh = (F.col("ts_us") - F.col("stored_us") < ttl_s * 1_000_000) & (F.col("stored_us") <= F.col("ts_us"))
    return joined.withColumn("hit", F.coalesce(fresh, F.lit(False))).drop("stored_us")


def billable(requests: DataFrame) -> DataFrame:
    """Each missed key is billed once: by its first request."""
    missed = requests.filter(~F.col("hit"))
    rest = [c for c in missed.columns if c != "key"]
    first = missed.groupBy("key").agg(F.min_by(F.struct(*rest), F.struct("ts_us", "event_id")).alias("_r"))
    return first.select("key", "_r.*")


# The stored fields of an item, in order.
ITEM_FIELDS = (
    "title", "url", "item_type", "source_index", "item_index", "duration_s", "size_chars", "has_transcript",
    "is_punctuated", "word_count", "uncertain", "set_aside",
)


def item_json() -> Column:
    return F.to_json(F.struct(*ITEM_FIELDS), {"ignoreNullFields": "false"})


def merge_legacy_items(store: DataFrame, legacy: DataFrame) -> DataFrame:
    """One-column-per-field items folded into JSON rows; an item the store has already is left alone."""
    moved = legacy.select("job_id", "id", item_json().alias("item"), "source_index", "item_index", "selected")
    return store.unionByName(moved.join(store.select("id"), "id", "left_anti"))


def merge_transcript_caches(store: DataFrame, videos: DataFrame, episodes: DataFrame) -> DataFrame:
    """Two older caches folded into one store: the store wins, then videos, then episodes of the current format."""
    current = episodes.filter("format_version = 2").drop("format_version")
    ranked = (
        store.withColumn("_rank", F.lit(0)).unionByName(videos.withColumn("_rank", F.lit(1)))
        .unionByName(current.withColumn("_rank", F.lit(2)))
    )
    rest = [c for c in store.columns if c != "key"]
    kept = ranked.groupBy("key").agg(F.min_by(F.struct(*rest), F.struct("_rank", *rest)).alias("_r"))
    return kept.select("key", "_r.*").select(*store.columns)


def stale_keys(transcripts: DataFrame, preferred: Sequence[str]) -> DataFrame:
    """Keys of video transcripts cached in a preferred language (``en`` or ``en-…``)."""
    bases = "|".join(sorted({code.split("-")[0].lower() for code in preferred}))
    stale = ~F.col("key").startswith("http") & F.col("language").rlike(f"^({bases})(-.*)?$")
    return transcripts.filter(stale).select("key").distinct()


def purge_stale(
    transcripts: DataFrame, polished: DataFrame, preferred: Sequence[str], done_version: int, rule_version: int = 2
) -> tuple[DataFrame, DataFrame]:
    """Both tables without the stale transcripts and what was polished from them; once per rule version."""
    if done_version >= rule_version:
        return transcripts, polished
    stale = stale_keys(transcripts, preferred)
    return (
        transcripts.join(stale, "key", "left_anti"),
        polished.join(stale.withColumnRenamed("key", "content_key"), "content_key", "left_anti"),
    )
