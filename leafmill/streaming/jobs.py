"""Streams of job progress, answers and spend."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions.text import word_count
from leafmill.operators import hits as H
from leafmill.operators.segments import marks_of, punctuated
from leafmill.sources.payloads import normalise
from leafmill.streaming.tables import batch_tables, latest, shared_folder, upsert_stream


def search_batches(payloads: DataFrame, queries: DataFrame, providers: dict[str, str]) -> DataFrame:
    """Each answer of a provider ranked alone and written as JSON lines as soon as it lands.

    ``payloads`` streams (query_id, payload_id, vendor, body, error); a failed provider gives one
    error line and leaves the others alone. Ranks are those of the answer, however the stream is cut.
    """
    spark = payloads.sparkSession
    path = shared_folder(spark, "batches")
    name = F.create_map(*[F.lit(x) for pair in providers.items() for x in pair])

    def build(batch: DataFrame) -> DataFrame:
        hits = normalise(batch.filter("error IS NULL")).withColumns({
            "provider": name[F.col("vendor")], "relevance": F.lit(None).cast("double"),
        })
        ranked = H.keyword_rank(hits, queries, ["query_id", "payload_id"]).select("query_id", "payload_id", "provider", "rank", "id", "url", "score")
        failed = batch.filter("error IS NOT NULL").select(
            "query_id", "payload_id", name[F.col("vendor")].alias("provider"), F.lit(0).cast("bigint").alias("rank"), "error"
        )
        rows = ranked.unionByName(failed, allowMissingColumns=True)
        return rows.select(F.to_json(F.struct(*rows.columns)).alias("value"))

    batch_tables(payloads, path, build, format="text")
    line = "query_id BIGINT, payload_id BIGINT, provider STRING, rank BIGINT, id STRING, url STRING, score BIGINT, error STRING"
    return spark.read.schema("value STRING").text(f"{path}/rows").select(F.from_json("value", line).alias("j")).select("j.*")


def item_states(events: DataFrame) -> DataFrame:
    """The latest state of each item from its event stream; a later state without a note clears it."""
    return upsert_stream(events, shared_folder(events.sparkSession, "states"), ["job_id", "item_id"], ["ts_us", "event_id"])


def source_progress(events: DataFrame) -> DataFrame:
    """Sources as they end: ``events(job_id, source_index, item_count, error, at)``."""
    return upsert_stream(events, shared_folder(events.sparkSession, "sources"), ["job_id", "source_index"], ["at"])


def transcript_key(video: Column | str, choice: Column | str) -> Column:
    """A video's default transcript has its id as key, one in a chosen language ``id#language``."""
    video, choice = (F.col(c) if isinstance(c, str) else c for c in (video, choice))
    return F.concat(video, F.when(F.coalesce(choice, F.lit("")) != "", F.concat(F.lit("#"), choice)).otherwise(""))


def transcript_arrivals(arrivals: DataFrame) -> DataFrame:
    """Found transcripts by key, the latest arrival of each."""
    found = arrivals.filter("text IS NOT NULL AND text <> ''")
    return upsert_stream(found, shared_folder(arrivals.sparkSession, "transcripts"), ["key"], ["stored_at"])


def fetched_transcripts(fetches: DataFrame) -> DataFrame:
    """Transcripts by key from a stream of fetches (fetch_id, video_id, choice, language, text, fetched_at), in any order of files.

    A fetch that is reported again counts once, as first made, however late either report comes; a fetch that found nothing is not stored,
    so the next one asks again. The stream is kept as a table of fetches: a later file may hold a fetch's first report.
    """
    found = fetches.filter("text IS NOT NULL AND text <> ''").withColumns({"key": transcript_key("video_id", "choice"), "_early": -F.unix_micros("fetched_at")})
    once = upsert_stream(found, shared_folder(fetches.sparkSession, "fetched"), ["key", "fetch_id"], ["_early"])
    return latest(once.drop("_early"), ["key"], ["fetched_at", "fetch_id"])


def with_chosen_language(items: DataFrame, transcripts: DataFrame) -> DataFrame:
    """``items(video_id, tracks, choice)`` with the transcript of the chosen language and its statistics read again.

    The first track is the default: choosing it, or nothing, goes back to the plain key. ``problem`` says why a choice
    cannot be read: the language is not offered, or there is no transcript in it; such an item keeps no statistics.
    """
    chosen = F.when(F.col("choice") == F.get("tracks", F.lit(0)), F.lit(None).cast("string")).otherwise(F.col("choice"))
    keyed = items.withColumn("_offered", F.col("choice").isNull() | F.array_contains("tracks", F.col("choice"))).withColumn("key", transcript_key("video_id", chosen))
    known = transcripts.select("key", "language", "text")
    joined = keyed.join(known, "key", "left")
    read = F.col("_offered") & F.col("text").isNotNull()
    words = word_count("text")
    return joined.select(
        *items.columns, F.when(read, F.col("key")).alias("key"), F.when(read, F.col("language")).alias("language"),
        F.when(read, words.cast("bigint")).alias("words"), F.when(read, punctuated(words, marks_of("text"))).alias("punctuated"),
        F.when(~F.col("_offered"), "language not offered").when(F.col("text").isNull(), "no transcript").alias("problem"),
    )


def daily_spend(calls: DataFrame) -> DataFrame:
    """Paid calls summed per provider and day.

    Each micro-batch leaves its partial sums, which are added up on reading: open days are there, and a call
    that comes late counts in its day.
    """
    path = shared_folder(calls.sparkSession, "spend")

    def sums(batch: DataFrame) -> DataFrame:
        return batch.groupBy(F.date_trunc("day", "ts").alias("day"), "provider").agg(F.sum("cost").alias("cost"), F.count("*").alias("calls"))

    batch_tables(calls, path, sums)
    parts = calls.sparkSession.read.schema("day TIMESTAMP, provider STRING, cost BIGINT, calls BIGINT").parquet(f"{path}/rows")
    return parts.groupBy("day", "provider").agg(F.sum("cost").alias("cost"), F.sum("calls").alias("calls"))


def stream_of(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """One of the given tables, a file or a folder of files, also one cut by columns into folders of its own, as a file stream."""
    schema = spark.read.parquet(f"{folder}/{table}.parquet").schema
    # A pattern, since a stream takes a plain path for a folder. Columns that only folders name are looked for below the base path.
    return spark.readStream.schema(schema).option("basePath", folder).parquet(f"{folder}/{{{table}}}.parquet")
