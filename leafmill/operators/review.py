"""What the review of a job shows: what is left out, what starts selected, what it will cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.operators.ordered import block_of, number_rows, top_per_key

PODCAST_PRESELECT = 10
MAX_ITEMS_PER_SOURCE = 250
PROBED_ITEMS = 50
JUDGED_ITEMS = 50
TOKENS_PER_WORD = 1.33
CHARS_PER_WORD = 6
# Whether a role makes a paid pass over an item.
PAID_ROLES = ("punctuate", "copyedit", "sections")


def raw_captions() -> Column:
    return (F.col("item_type") == "youtube") & F.col("has_transcript").eqNullSafe(True) & F.col("is_punctuated").eqNullSafe(False)


def needs_transcription() -> Column:
    return (F.col("item_type") == "podcast") & ~F.col("has_transcript").eqNullSafe(True)


def left_out(stt_missing: Column | bool) -> Column:
    stt_missing = stt_missing if isinstance(stt_missing, Column) else F.lit(stt_missing)
    unreadable = F.coalesce("paywalled", F.lit(False)) | F.coalesce("unreadable", F.lit(False))
    silent = (F.col("item_type") == "youtube") & F.col("has_transcript").eqNullSafe(False)
    return F.when(needs_transcription(), stt_missing).otherwise(unreadable | silent)


def polishable() -> Column:
    return F.col("item_type").isin("youtube", "blog")


def finished(state: Column) -> Column:
    return F.coalesce(state.isin("done", "skipped", "failed"), F.lit(False))


def left_out_state(state: Column) -> Column:
    return F.coalesce(state.isin("skipped", "failed"), F.lit(False))


def with_review_flags(items: DataFrame, stt_missing: Column | bool) -> DataFrame:
    return items.withColumns({
        "raw_captions": raw_captions(), "needs_transcription": needs_transcription(),
        "left_out": left_out(stt_missing), "polishable": polishable(),
    })


def review_counts(items: DataFrame, states: DataFrame, stt_missing: bool) -> DataFrame:
    """Per job and source: what is selected, included, raw, polishable and finished."""
    flagged = with_review_flags(items, stt_missing).join(states, "id", "left")
    chosen = F.col("selected")
    return flagged.groupBy("job_id", "source_index").agg(
        F.count_if(chosen).alias("picked"), F.count_if(chosen & ~F.col("left_out")).alias("included"),
        F.count_if(chosen & F.col("raw_captions")).alias("raw"), F.count_if(chosen & F.col("polishable")).alias("polishable"),
        F.count_if(finished(F.col("state"))).alias("finished"),
    )


def capped_per_source(items: DataFrame, cap: int = MAX_ITEMS_PER_SOURCE) -> DataFrame:
    return top_per_key(items, ["job_id", "source_index"], [F.col("item_index")], cap, "place")


def preselected(items: DataFrame) -> DataFrame:
    """Which items start selected, are sure, are probed and are judged; a source's list is capped first."""
    keys = ["job_id", "source_index"]
    capped = capped_per_source(items)
    lists = capped.groupBy(*keys).agg(F.bool_or(~F.col("uncertain")).alias("_any_sure"), (F.count("*") >= 2).alias("_several"))
    start = ~F.col("uncertain") & F.col("set_aside").isNull() & (
        (F.col("item_type") != "podcast") | (F.col("item_index") < PODCAST_PRESELECT)
    )
    return capped.join(lists, keys).select(
        "id", start.alias("preselected"), (~F.col("uncertain") | ~F.col("_any_sure")).alias("sure"),
        ((F.col("item_type") == "youtube") & (F.col("place") <= PROBED_ITEMS)).alias("probed"),
        (F.col("_several") & (F.col("place") <= JUDGED_ITEMS)).alias("judged"),
    )


def ordered_selection(items: DataFrame, source_order: DataFrame) -> DataFrame:
    """Selected items in the visitor's source order, then item order: the order of the chapters."""
    picked = items.filter("selected").join(source_order, ["job_id", "source_index"])
    return number_rows(
        picked, ["job_id"], [F.col("source_rank"), block_of("item_index")], [F.col("item_index")], "chapter_no"
    ).select("job_id", "id", "chapter_no")


def item_costs(items: DataFrame, job_rates: DataFrame, job_roles: DataFrame) -> DataFrame:
    """Expected cost of each selected item: transcription by the minute, each paid role by words in and out.

    ``job_rates`` holds one row per job; ``job_roles`` (job_id, role) is folded to one row per job.
    """
    roles = job_roles.groupBy("job_id").agg(
        F.max((F.col("role") == "punctuate").cast("int")).alias("_punctuate"),
        F.count_if(F.col("role").isin(*PAID_ROLES) & (F.col("role") != "punctuate")).alias("_always"),
    )
    rows = items.filter("selected").join(job_rates, "job_id").join(roles, "job_id", "left")
    minutes = F.coalesce("duration_s", F.lit(0)) / 60
    stt = F.when(needs_transcription() & F.col("stt_available"), minutes * F.col("stt_per_minute")).otherwise(0.0)
    words = F.when(F.col("item_type") == "youtube", F.coalesce("word_count", F.lit(0))).otherwise(
        F.coalesce("size_chars", F.lit(0)) / CHARS_PER_WORD
    )
    passes = F.coalesce("_always", F.lit(0)) + F.when(raw_captions(), F.coalesce("_punctuate", F.lit(0))).otherwise(0)
    rate = (F.col("llm_in") + F.col("llm_out")) / 1e6
    readable = F.col("llm_available") & ~F.col("has_transcript").eqNullSafe(False) & (F.col("item_type") != "podcast")
    llm = F.when(readable, passes * words * TOKENS_PER_WORD * rate).otherwise(0.0)
    return rows.select("job_id", "id", stt.alias("stt"), F.coalesce(llm, F.lit(0.0)).alias("llm"))


def usd(value: Column, approx: bool = False) -> Column:
    amount = F.format_string("%.2f", value)
    return F.when(value <= 0, "$0.00").when(value < 0.01, "< $0.01").otherwise(F.concat(F.lit("~$" if approx else "$"), amount))


def job_costs(costs: DataFrame) -> DataFrame:
    """A job's expected cost and its label, null when nothing is metered."""
    total = F.round(F.sum(F.col("stt") + F.col("llm")), 6)
    jobs = costs.groupBy("job_id").agg(F.round(F.sum("stt"), 6).alias("stt"), F.round(F.sum("llm"), 6).alias("llm"), total.alias("total"))
    return jobs.withColumn("label", F.when(F.col("total") > 0, usd(F.col("total"), approx=True)))
