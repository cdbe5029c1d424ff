"""Search hits: filter, fold copies of one source, rank, merge provider batches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions import urls
from leafmill.functions.text import NOT_WORD, collapse, null_if_empty
from leafmill.operators import links
from leafmill.operators.ordered import (
    Running, block_of, first_per_key, number_ranged, number_rows, running, settle, top_per_key, with_group_flag,
)

MAX_PER_HOST = 3
PROVIDER_LIMIT = 12


def first_of_each_source(hits: DataFrame) -> DataFrame:
    """The best-ranked article-like hit of each canonical source. A rejected hit never claims its key."""
    kept = hits.filter(links.is_article_like("url")).withColumn("source_key", urls.canonical_key("url"))
    return first_per_key(kept, ["query_id", "source_key"], [F.col("pos")])


def without_redundant_homes(hits: DataFrame) -> DataFrame:
    """Drop a site's home when a deeper page of the site is in the same result."""
    marked = hits.withColumns({"host": urls.host("url"), "home": urls.is_home("url")})
    flagged = with_group_flag(marked, ["query_id", "host"], ~F.col("home"), "has_deep")
    return flagged.filter(~(F.col("home") & F.col("has_deep"))).drop("has_deep", "home")


def capped_per_host(hits: DataFrame, cap: int = MAX_PER_HOST) -> DataFrame:
    return top_per_key(hits, ["query_id", "host"], [F.col("pos")], cap, "host_rank")


def tidy(hits: DataFrame) -> DataFrame:
    return capped_per_host(without_redundant_homes(first_of_each_source(hits)))


def keyword_score(title: Column, url: Column, author: Column, tokens: Column, compact: Column) -> Column:
    labels = F.split(urls.host(url), r"\.")
    label = F.when(F.size(labels) >= 2, F.get(labels, F.size(labels) - 2)).otherwise(F.get(labels, F.lit(0)))
    found = F.size(F.filter(tokens, lambda t: F.lower(title).contains(t)))
    writer = F.regexp_replace(F.lower(F.coalesce(author, F.lit(""))), NOT_WORD, "")
    score = (
        F.when((compact != "") & (compact == label), 100).otherwise(0)
        + found * 5
        + F.when(found == F.size(tokens), 20).otherwise(0)
        + F.when((compact != "") & writer.contains(compact), 10).otherwise(0)
    )
    return F.when(F.size(tokens) == 0, 0).otherwise(score)


def with_keyword_relevance(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """``score`` and the 0-3 ``relevance`` of each hit for its query's words."""
    norm = F.lower(F.trim("query"))
    tokens = F.filter(F.split(F.regexp_replace(norm, NOT_WORD, " "), " "), lambda t: t != "")
    asked = queries.select("query_id", tokens.alias("_tokens"), F.regexp_replace(norm, NOT_WORD, "").alias("_compact"))
    score = keyword_score(F.col("title"), F.col("url"), F.col("author"), F.col("_tokens"), F.col("_compact"))
    scored = hits.drop("relevance").join(asked, "query_id").withColumn("score", score.cast("bigint"))
    relevance = F.least(F.lit(3.0), F.lit(3.0) * F.col("score") / (F.size("_tokens") * 5 + 20))
    return scored.withColumn("relevance", F.bround(relevance, 2)).drop("_tokens", "_compact")


def keyword_rank(hits: DataFrame, queries: DataFrame, batch: Sequence[str] = ("query_id", "provider")) -> DataFrame:
    """The hits of each batch by score, the provider's own order between equals."""
    scored = with_keyword_relevance(hits, queries)
    return number_rows(scored, list(batch), [-F.col("score"), block_of("pos")], [F.col("pos")], "rank")


def first_of_each_url(hits: DataFrame) -> DataFrame:
    """A URL shown once per query: the earliest batch, then the best place in it."""
    return first_per_key(hits, ["query_id", "url"], [F.col("arrival"), F.col("pos")])


def merge_batches(hits: DataFrame, frozen: bool = False) -> DataFrame:
    """One list per query from ranked batches; each batch keeps its own order.

    Merging head to head by relevance equals sorting by the lowest relevance seen so far in the
    batch, earlier batches first on ties. A frozen list only appends.
    """
    shown = first_of_each_url(hits)
    if frozen:
        return number_rows(shown, ["query_id"], [F.col("arrival"), block_of("pos")], [F.col("pos")], "place")
    relevance = F.coalesce("relevance", F.lit(-1.0))
    floor = running(
        shown, ["query_id", "arrival"], [block_of("pos")], [F.col("pos")], {"_floor": Running("min", relevance)}
    )
    placed = number_rows(
        settle(floor), ["query_id"], [-F.col("_floor"), F.col("arrival"), block_of("pos")], [F.col("pos")], "place"
    )
    return placed.drop("_floor")


def with_original_titles(hits: DataFrame, originals: DataFrame) -> DataFrame:
    known = originals.select("id", F.col("title").alias("_original"))
    joined = hits.join(known, "id", "left")
    return joined.withColumn("title", F.coalesce(null_if_empty("_original"), F.col("title"))).drop("_original")


def search_summary(found: DataFrame, shown: DataFrame, batches: DataFrame, providers: int) -> DataFrame:
    """Per query: hits found and shown, shown by type, failed providers, whether it was cut short."""
    counts = found.groupBy("query_id").agg(F.count("*").alias("found"))
    kinds = shown.groupBy("query_id").agg(
        F.count("*").alias("shown"), *[F.count_if(F.col("type") == t).alias(f"shown_{t}") for t in ("video", "web", "episode")]
    )
    # At most one row per registered provider is collected per query.
    answers = batches.groupBy("query_id", "provider").agg(F.max("error").alias("error"))
    failures = answers.groupBy("query_id").agg(
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("error").isNotNull(), F.col("provider")))), ",").alias("failed"),
        (F.count("*") < providers).alias("aborted"),
    )
    zero = ["found", "shown", "shown_video", "shown_web", "shown_episode"]
    return failures.join(counts, "query_id", "left").join(kinds, "query_id", "left").fillna(0, subset=zero)


def sort_order(hits: DataFrame, by: str) -> DataFrame:
    """``place`` of each hit per query when sorted by title or duration (unknown lengths last). Titles sort as people read them: letters before their accents and case."""
    if by == "title":
        return number_ranged(hits, ["query_id"], [F.collate("title", "UNICODE"), F.col("pos")], "place")
    sign = -1 if by == "duration-desc" else 1
    unknown = F.col("duration_s").isNull().cast("int")
    key = F.coalesce(F.col("duration_s") * sign, F.lit(0))
    return number_rows(hits, ["query_id"], [unknown, key, block_of("pos")], [F.col("pos")], "place")


def filter_medium(hits: DataFrame, medium: str) -> DataFrame:
    kind = F.when(F.col("type") == "episode", "audio").when(F.col("type") == "web", "text").otherwise("video")
    return hits.filter(kind == medium)


def top_per_provider(hits: DataFrame, limit: int = PROVIDER_LIMIT) -> DataFrame:
    return top_per_key(hits, ["query_id", "provider"], [F.col("pos")], limit)


def describe(kind: Column, title: Column, author: Column, duration_s: Column, genre=None, published=None, snippet=None) -> Column:
    """What a judge reads about one candidate: named fields as JSON, absent ones left out."""
    from leafmill.operators.verdicts import published_at

    fields = [
        kind.alias("kind"), title.alias("title"), null_if_empty(author).alias("channel_or_show"),
        F.when(duration_s != 0, F.bround(duration_s / 60).cast("bigint")).alias("minutes"),
    ]
    if genre is not None:
        fields.append(null_if_empty(genre).alias("genre"))
    if published is not None:
        # The date as it was written, in its own zone.
        fields.append(F.when(published_at(published).isNotNull(), F.left(published, F.lit(10))).alias("date"))
    if snippet is not None:
        text = F.trim(F.replace(F.coalesce(snippet, F.lit("")), F.lit("\n"), F.lit(" ")))
        fields.append(null_if_empty(F.left(text, F.lit(240))).alias("description"))
    return F.to_json(F.struct(*fields))
