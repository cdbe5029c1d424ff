"""Judgements about candidates, joined back to them. The judge itself is outside: its answers are a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.operators.ordered import first_per_key, number_ranged

MIN_RELEVANCE = 1.0
# Reading levels from easy to hard.
LEVELS = ["intro", "intermediate", "expert"]
# Why an item starts unchecked.
NOT_COMPILABLE = "Likely nothing to read"
OFF_TOPIC = "Likely off-topic"


def published_at(raw: Column) -> Column:
    """An ISO date or time; without an offset it is UTC. Null when unreadable."""
    text = F.regexp_replace(raw, "Z$", "+00:00")
    zoned = F.when(text.rlike(r"T?\d{2}:\d{2}.*[+-]\d{2}(:?\d{2})?$"), text).when(
        text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.concat(text, F.lit("T00:00:00+00:00"))
    ).otherwise(F.concat(text, F.lit("+00:00")))
    iso = text.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}(:\d{2}(:\d{2}([.,]\d+)?)?)?([+-]\d{2}(:?\d{2})?)?)?$")
    return F.when(iso, F.try_to_timestamp(zoned))


def _level(name: Column) -> Column:
    return F.when(name.isin(*LEVELS), F.array_position(F.array(*[F.lit(x) for x in LEVELS]), name))


def rank_by_verdict(hits: DataFrame, verdicts: DataFrame, wishes: DataFrame) -> DataFrame:
    """Judged hits worth reading first, best first; hits without a verdict keep their order after them."""
    first = first_per_key(verdicts, ["query_id", "pos"], [F.col("verdict_no")]).select(
        "query_id", "pos", "compilable", F.col("relevance").alias("_relevance"), F.col("level").alias("_level")
    )
    wanted = wishes.select("query_id", F.col("level").alias("_wanted"), F.col("freshness").alias("_freshness"))
    judged = hits.join(first, ["query_id", "pos"], "left").join(wanted, "query_id", "left")
    unjudged = F.col("compilable").isNull()
    kept = judged.filter(unjudged | (F.col("compilable") & (F.col("_relevance") >= MIN_RELEVANCE)))
    gap = F.coalesce(F.abs(_level(F.col("_level")) - _level(F.col("_wanted"))), F.lit(0))
    newest = F.when(F.col("_freshness") == "recent", -F.unix_seconds(published_at(F.col("published_at"))))
    dated = kept.withColumns({
        "_late": unjudged.cast("int"),
        "_minus": F.when(unjudged, 0.0).otherwise(-F.col("_relevance")),
        "_gap": F.when(unjudged, 0).otherwise(gap),
        "_newest": F.when(unjudged, 0).otherwise(F.coalesce(newest, F.lit(0))),
        "relevance": F.coalesce("_relevance", "relevance"),
    })
    placed = number_ranged(dated, ["query_id"], [F.col(c) for c in ("_late", "_minus", "_gap", "_newest", "pos")], "place")
    return placed.select(*hits.columns, "place")


def set_aside_reasons(items: DataFrame, verdicts: DataFrame, sources: DataFrame) -> DataFrame:
    """Items the first verdict doubts, with the reason. Off-topic needs a request to be off from."""
    keys = ["job_id", "source_index", "item_index"]
    first = first_per_key(verdicts, keys, [F.col("verdict_no")])
    asked = sources.select("job_id", "source_index", F.col("query").isNotNull().alias("_asked"))
    reason = F.when(~F.col("compilable"), NOT_COMPILABLE).when(
        F.col("_asked") & (F.col("relevance") < MIN_RELEVANCE), OFF_TOPIC
    )
    joined = items.select(*keys, "id").join(first, keys).join(asked, ["job_id", "source_index"], "left")
    return joined.select("id", reason.alias("reason")).filter("reason IS NOT NULL")
