"""The same episode under two names: titles that nearly match, files behind tracking redirects."""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.functions import urls
from leafmill.functions.blockmatch import ratio
from leafmill.functions.text import col, collapse, word_count
from leafmill.shared import settle

MIN_TITLE_RATIO = 0.85
MIN_TITLE_WORDS = 4
DURATION_SLACK_S = 180
DURATION_SLACK_RATIO = 0.15
EPISODE_PREFIX = r"(?i)^\s*(?:(?:ep(?:isode)?\.?\s*)?#?\d+\s*[.:\-–—|]\s*|ep(?:isode)?\.?\s*#?\d+\s+)"


@F.pandas_udf(T.StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    import unicodedata

    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def compatible(text: Column | str) -> Column:
    """NFKC form; text of plain letters never leaves the JVM."""
    text = col(text)
    exotic = text.rlike(r"[^\x00-\x7fÀ-ž]")
    return F.coalesce(_nfkc(F.when(exotic, text)), text)


def link_title(text: Column) -> Column:
    return collapse(F.regexp_replace(F.lower(F.regexp_replace(text, EPISODE_PREFIX, "")), r"[^\p{L}\p{N}_\s\p{Z}]", " "))


def close_durations(a: Column, b: Column) -> Column:
    return F.abs(a - b) <= F.greatest(F.lit(DURATION_SLACK_S), F.greatest(a, b) * DURATION_SLACK_RATIO)


def linked_titles(wanted: DataFrame, candidates: DataFrame) -> DataFrame:
    """The first candidate per wanted title that is the same episode.

    ``wanted(item_id, title, duration_s)``, ``candidates(item_id, rank, title, duration_s)``: the
    answers of a look-up, so the join is by item and never compares all with all. Numbers, lengths and
    durations decide first; the exact ratio is taken on what is left. Both sides are settled with their titles
    folded, else each condition of the join would fold them again, from the tables they come from.
    """
    a = settle(wanted.select("item_id", link_title(compatible("title")).alias("_a"), F.col("duration_s").alias("_d1")), "wanted")
    b = settle(candidates.select("item_id", "rank", F.col("title").alias("found"), link_title(compatible("title")).alias("_b"), F.col("duration_s").alias("_d2")), "candidates")
    pairs = a.join(b, "item_id")
    numbers = lambda c: F.regexp_extract_all(c, F.lit(r"(\d+)"), 1)
    known = F.col("_d1").isNotNull() & F.col("_d2").isNotNull() & (F.col("_d1") != 0) & (F.col("_d2") != 0)
    lengths = F.struct(F.length("_a").alias("a"), F.length("_b").alias("b"))
    bound = F.try_divide(2 * F.least(lengths["a"], lengths["b"]), lengths["a"] + lengths["b"])
    able = pairs.filter(
        (word_count("_a") >= MIN_TITLE_WORDS) & (word_count("_b") >= MIN_TITLE_WORDS)
        & (numbers(F.col("_a")) == numbers(F.col("_b"))) & (bound >= MIN_TITLE_RATIO)
        & F.when(known, close_durations(F.col("_d1"), F.col("_d2"))).otherwise(F.col("_a") == F.col("_b"))
    )
    differs = F.col("_a") != F.col("_b")
    near = F.when(differs, _near_ratio(F.when(differs, F.col("_a")), F.when(differs, F.col("_b")))).otherwise(1.0)
    matched = able.withColumn("ratio", near).filter(F.col("ratio") >= MIN_TITLE_RATIO)
    best = matched.groupBy("item_id").agg(F.min_by(F.struct("rank", "found", "ratio"), "rank").alias("_m"))
    return best.select("item_id", "_m.rank", "_m.found", "_m.ratio")


@F.pandas_udf(T.DoubleType())
def _near_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """The exact ratio of two titles; null where the characters they share, in any order, are too few for a match."""
    def near(x: str, y: str) -> float | None:
        shared = sum((Counter(x) & Counter(y)).values())
        return ratio(x, y) if 2.0 * shared / (len(x) + len(y)) >= MIN_TITLE_RATIO else None

    return pd.Series([None if x is None or y is None else near(x, y) for x, y in zip(a, b)], dtype="float64")


def file_key(url: Column | str) -> Column:
    """``/host/path`` of a file URL, lower case, query dropped; null without a host or a file name."""
    site = F.regexp_replace(urls.netloc(url), r"^[^@]*@|:\d*$", "")
    path = urls.path(url)
    named = path.rlike(r"\.[^/]*$")
    return F.when((site != "") & named, F.lower(F.concat(F.lit("/"), site, path)))


def _suffixes(key: Column) -> Column:
    """Every tail of the key that starts at a slash."""
    parts = F.split(key, "/")
    return F.transform(
        F.sequence(F.lit(2), F.size(parts)), lambda k: F.concat(F.lit("/"), F.array_join(F.slice(parts, k, F.size(parts)), "/"))
    )


def match_entries(wanted: DataFrame, entries: DataFrame) -> DataFrame:
    """Wanted episodes (feed_id, wanted_id, audio_url, title) with their entry (feed_id, pos, enclosure_url, title).

    Same file when one key ends with the other: an equi-join on slash tails instead of a suffix
    comparison of all pairs. The first entry wins; otherwise the first with the same folded title.
    """
    # Whole keys, their tails and titles are probes of one join. Of entries with one probe only the first can win, so a probe shared by many joins once.
    probe = F.col("p.probe")
    w = wanted.select("feed_id", "wanted_id", F.explode(_probes("audio_url", "title")).alias("p"))
    e = entries.select("feed_id", "pos", F.explode(_probes("enclosure_url", "title")).alias("p"))
    first_e = e.groupBy("feed_id", probe.alias("probe")).agg(F.min("pos").alias("_any"), F.min(F.when(F.col("p.whole"), F.col("pos"))).alias("_whole"))
    met = w.select("feed_id", "wanted_id", probe.alias("probe"), "p.whole").join(first_e, ["feed_id", "probe"])
    titled = ~F.col("probe").startswith("/")
    file = F.when(F.col("whole"), F.col("_any")).otherwise(F.col("_whole"))
    best = met.groupBy("feed_id", "wanted_id").agg(F.min(F.when(~titled, file)).alias("_file"), F.min(F.when(titled, F.col("_any"))).alias("_title"))
    return best.select("feed_id", "wanted_id", F.coalesce("_file", "_title").alias("pos")).filter("pos IS NOT NULL")


def _probes(url: str, title: str) -> Column:
    """What a row is met by: its file key with the key's tails, and its folded title, which never starts with a slash."""
    tails = F.transform(_suffixes(file_key(url)), lambda k, i: F.struct(k.alias("probe"), (i == 0).alias("whole")))
    fold = folded(F.col(title))
    named = F.when(fold != "", F.array(F.struct(fold.alias("probe"), F.lit(True).alias("whole"))))
    none = F.array().cast("array<struct<probe:string,whole:boolean>>")
    return F.concat(F.coalesce(tails, none), F.coalesce(named, none))


def folded(title: Column) -> Column:
    low = F.replace(F.lower(compatible(title)), F.lit("ß"), F.lit("ss"))
    return F.trim(F.regexp_replace(low, r"[^\p{L}\p{N}_]+", " "))
