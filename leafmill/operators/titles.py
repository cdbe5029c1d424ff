"""Titles: an even form, and where an item comes from when two read alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions import urls
from leafmill.functions.text import col, collapse, fold_title, let, null_if_empty, strip

# Words that stay small inside a title.
SMALL_WORDS = (
    "a an and as at but by for from in into nor of on or over per the to up via vs with off out than"
).split()
# A leading episode marker needs a digit and a separator.
EPISODE_MARKER = r"(?i)^\s*(?:#\s*\d+|(?:episode|ep|chapter|ch|part|pt|vol|e)\.?\s*\d+)\s*[-–—:|.]\s+"
CHANNEL_SUFFIX = r"\s*\|\s*[^|]+$"
PLATFORM_SUFFIX = r"(?i)\s*[-–—]\s*YouTube(?:\s+Music)?$"
NOT_UPPER = r"[\p{Ll}\p{Lt}\p{Lm}\p{Lo}]"
SHOUT_WORD = r"([A-Za-z][A-Za-z'’*]*)"


def is_shout(segment: Column) -> Column:
    """All capitals, and two words or one of five letters: louder than an acronym."""
    found = F.regexp_extract_all(segment, F.lit(SHOUT_WORD), 1)
    long_enough = (F.size(found) >= 2) | ((F.size(found) == 1) & (F.length(F.get(found, F.lit(0))) >= 5))
    return segment.rlike(r"\p{L}") & ~segment.rlike(NOT_UPPER) & long_enough


def capitalised(segment: Column) -> Column:
    """Small words stay low unless first or last; every other word starts with a capital."""
    def words(ws: Column) -> Column:
        def one(word: Column, i: Column) -> Column:
            low = F.lower(word)
            lead = F.regexp_extract(low, r"^(\P{L}*)", 1)
            rest = F.substr(low, F.length(lead) + 1)
            big = F.concat(lead, F.upper(F.left(rest, F.lit(1))), F.substr(rest, F.lit(2)))
            return F.when((i > 0) & (i < F.size(ws) - 1) & low.isin(*SMALL_WORDS), low).otherwise(big)

        return F.array_join(F.transform(ws, one), " ")

    return let(F.filter(F.split(segment, r"\s+"), lambda w: w != ""), words)


def without_channel(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, CHANNEL_SUFFIX, ""), PLATFORM_SUFFIX, "")


def deshout(text: Column) -> Column:
    # White space is single by now, so the separators have a fixed width.
    parts = F.split(text, r"(?= [-–—|] )|(?<= [-–—|] )|(?=: )|(?<=: )")
    return F.array_join(F.transform(parts, lambda p: F.when(is_shout(p), capitalised(p)).otherwise(p)), "")


def tidy_title(raw: Column | str) -> Column:
    raw = col(raw)
    bare = let(without_channel(collapse(raw)), lambda t: F.regexp_replace(t, EPISODE_MARKER, ""))
    return F.coalesce(null_if_empty(collapse(let(bare, deshout))), strip(raw))


def rule_hits(titles: DataFrame, title: str = "title") -> DataFrame:
    """How many titles each rule changes."""
    one = titles.select(collapse(title).alias("t0")).withColumn("t1", without_channel(F.col("t0")))
    two = one.withColumn("t2", F.regexp_replace("t1", EPISODE_MARKER, "")).withColumn("t3", deshout(F.col("t2")))
    return two.agg(
        F.count("*").alias("titles"), F.count_if(F.col("t0") != F.col("t1")).alias("suffixes"),
        F.count_if(F.col("t1") != F.col("t2")).alias("markers"), F.count_if(F.col("t2") != F.col("t3")).alias("shouts"),
    )


def with_origins(items: DataFrame, sources: DataFrame) -> DataFrame:
    """``origin`` decides whether two items come from different places, ``origin_label`` is shown."""
    keys = ["job_id", "source_index"]
    counts = items.groupBy(*keys).agg((F.count("*") > 1).alias("_several"))
    named = sources.select(*keys, F.col("name").alias("_name"))
    site = F.regexp_replace(urls.host("url"), r"^www\.", "")
    wiki = (site == "wikipedia.org") | site.endswith(".wikipedia.org")
    listed = F.when(F.col("_several"), null_if_empty("_name"))
    page = F.col("item_type") == "blog"
    label = F.when(page & wiki, "Wikipedia").when(page, F.coalesce(null_if_empty("site_name"), site)).otherwise(
        F.coalesce(listed, site)
    )
    origin = F.when(page & wiki, "wikipedia.org").when(page, site).otherwise(F.lower(F.coalesce(listed, site)))
    joined = items.join(counts, keys).join(named, keys, "left")
    return joined.withColumns({"origin": origin, "origin_label": label}).drop("_several", "_name")


def disambiguate(items: DataFrame) -> DataFrame:
    """``title_suffix`` for items of one job that read alike but come from different origins."""
    keyed = items.withColumn("_key", fold_title("title"))
    groups = keyed.groupBy("job_id", "_key").agg((F.min("origin") != F.max("origin")).alias("_clash"))
    joined = keyed.join(groups, ["job_id", "_key"])
    return joined.withColumn("title_suffix", F.when(F.col("_clash"), F.col("origin_label"))).drop("_key", "_clash")


def chapter_title(title: Column | str, suffix: Column | str) -> Column:
    tidy = tidy_title(title)
    return F.when(col(suffix).isNotNull(), F.concat(tidy, F.lit(" ("), col(suffix), F.lit(")"))).otherwise(tidy)
