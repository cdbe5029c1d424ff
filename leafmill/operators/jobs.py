"""Jobs: what discovery found, in which order items compile, how a compile ended."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.operators.links import source_name
from leafmill.operators.ordered import block_of, number_rows

# Why an item gives no chapter.
NO_SUBTITLES = "No transcript available."
NO_TRANSCRIPTION = "Transcription unavailable."
NO_CONTENT = "No readable content."
PAYWALLED = "Behind a paywall, only a teaser is public."
# What a reader is told about a source or a job.
BUSY = "YouTube didn't respond. It rate-limits requests from some networks, so try again in a little while."
UNREADABLE = "Couldn't be read."
NOTHING_FOUND = "Those sources had no content to compile."
NOT_READ = "Those sources couldn't be read. Try again."
ORPHAN_NOTE = "The server restarted before this item was built."
# How item types are listed.
KIND_LABELS = {"youtube": "video", "podcast": "episode", "blog": "article"}


def skip_reason(item_type: Column, has_text: Column, empty: Column, paywalled: Column) -> Column:
    """Why an item yields no chapter, null when it does."""
    page = item_type == "blog"
    return (
        F.when(page & paywalled, PAYWALLED).when((item_type == "youtube") & ~has_text, NO_SUBTITLES)
        .when((item_type == "podcast") & ~has_text, NO_TRANSCRIPTION).when(empty | ~has_text, NO_CONTENT)
    )


def latest_states(events: DataFrame) -> DataFrame:
    """The last state and note of each item of each job; a later state without a note clears it."""
    last = events.groupBy("job_id", "item_id").agg(
        F.max_by(F.struct("state", "note"), F.struct("ts_us", "event_id")).alias("_s")
    )
    return last.select("job_id", "item_id", "_s.state", "_s.note")


def progress(states: DataFrame) -> DataFrame:
    done = F.count_if(F.col("state").isin("done", "skipped", "failed"))
    return states.groupBy("job_id").agg(done.alias("finished"), F.count("*").alias("total"))


def compile_outcomes(states: DataFrame, stopped: DataFrame) -> DataFrame:
    """Per job the outcome counts and, when nothing was built, the most specific cause."""
    counts = states.groupBy("job_id").agg(
        F.count_if(F.col("state") == "done").alias("chapters"), F.count_if(F.col("state") == "skipped").alias("skipped"),
        F.count_if(F.col("state") == "failed").alias("failed"),
        F.count_if((F.col("state") == "failed") & (F.col("note") == "rate limited")).alias("rate_limited"),
    )
    joined = counts.join(stopped.select("job_id", F.lit(True).alias("_stopped")), "job_id", "left")
    cause = F.when(F.col("chapters") == 0, F.when(F.col("_stopped"), "stopped").when(F.col("rate_limited") > 0, "rate_limited")
                   .when(F.col("failed") > 0, "nothing_built").otherwise("no_content"))
    return joined.withColumn("failure", cause).drop("_stopped")


def discovery_summary(sources: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per source its items and error; per job its status and error when nothing was found.

    ``sources.problem`` is ``refused``, ``unreadable`` or null.
    """
    keys = ["job_id", "source_index"]
    read = sources.filter("problem IS NULL").select(*keys)
    counts = items.join(read, keys, "left_semi").groupBy(*keys).agg(F.count("*").alias("item_count"))
    error = F.when(F.col("problem") == "refused", BUSY).when(F.col("problem").isNotNull(), UNREADABLE)
    by_source = sources.join(counts, keys, "left").select(
        *keys, F.coalesce("item_count", F.lit(0)).alias("item_count"), error.alias("error"), "problem"
    )
    jobs = by_source.groupBy("job_id").agg(
        F.sum("item_count").alias("items"), F.bool_and(F.coalesce(F.col("problem") == "refused", F.lit(False))).alias("_refused"),
        F.bool_or(F.col("problem").isNull()).alias("_clean"),
    )
    cause = F.when(F.col("items") == 0, F.when(F.col("_refused"), BUSY).when(F.col("_clean"), NOTHING_FOUND).otherwise(NOT_READ))
    by_job = jobs.select(
        "job_id", "items", F.when(F.col("items") == 0, "failed").otherwise("reviewing").alias("status"), cause.alias("error")
    )
    return by_source.drop("problem"), by_job


def compile_order(items: DataFrame, picks: DataFrame) -> DataFrame:
    """Confirmed items in the order they compile: as picked, then by source and item."""
    chosen = items.join(picks.select("job_id", "id", "position"), ["job_id", "id"])
    return number_rows(
        chosen, ["job_id"], [block_of("position")], [F.col("position"), F.col("source_index"), F.col("item_index")], "place"
    ).select("job_id", "id", "place", F.lit("pending").alias("compile_state"))


def selection_stats(items: DataFrame, roles: DataFrame, models: DataFrame) -> DataFrame:
    """Per job: selected items by type, number of roles, and the model that writes it when a role needs one."""
    picked = items.filter("selected").groupBy("job_id").agg(
        F.count("*").alias("picked"), *[F.count_if(F.col("item_type") == k).alias(k) for k in KIND_LABELS]
    )
    counts = roles.groupBy("job_id").agg(F.count_distinct("role").alias("roles"))
    joined = picked.join(counts, "job_id", "left").join(models, "job_id", "left").fillna(0, ["roles"])
    return joined.withColumn("model", F.when(F.col("roles") > 0, F.col("model")))


def item_list(items: DataFrame, sources: DataFrame) -> DataFrame:
    """Numbered item rows as they are listed or written as JSON."""
    keys = ["job_id", "source_index"]
    named = sources.select(*keys, source_name("name", F.lit(None).cast("string"), "url").alias("_site"), "name", F.col("url").alias("_url"))
    numbered = number_rows(
        items, ["job_id"], [F.col("source_index"), block_of("item_index")], [F.col("item_index")], "number"
    )
    label = F.create_map(*[F.lit(x) for pair in KIND_LABELS.items() for x in pair])[F.col("item_type")]
    rows = numbered.join(named, keys, "left")
    return rows.select(
        "job_id", "number", label.alias("type"), "title", "url",
        F.coalesce(F.nullif("name", F.lit("")), "_url").alias("source"), "duration_s",
        F.when(
            F.col("word_count").isNotNull(), F.greatest(F.lit(1), F.bround(F.col("word_count") / 200).cast("bigint"))
        ).alias("reading_time_min"), "has_transcript",
    )


def write_item_list(rows: DataFrame, path: str) -> None:
    """Item lists as JSON lines in order, in a bounded number of folders by a hash of the job."""
    order = ["bucket", "job_id", "number"]
    bucketed = rows.withColumn("bucket", F.pmod(F.xxhash64("job_id"), F.lit(256)))
    bucketed.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").partitionBy("bucket").json(path)


def reap_orphans(states: DataFrame, jobs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """At a restart, running jobs fail and so do their items that were not built, with the reason."""
    running = F.col("status").isin("discovering", "processing")
    orphaned = jobs.filter(running).select("job_id", F.lit(True).alias("_orphan"))
    items = states.join(orphaned, "job_id", "left")
    hit = F.coalesce(F.col("_orphan") & F.col("state").isin("compiling", "pending"), F.lit(False))
    settled = items.select(
        "job_id", "item_id", F.when(hit, "failed").otherwise(F.col("state")).alias("state"),
        F.when(hit, ORPHAN_NOTE).otherwise(F.col("note")).alias("note"),
    )
    return settled, jobs.withColumn("status", F.when(running, "failed").otherwise(F.col("status")))
