"""Search payloads of several vendors, one per row, to one hit schema.

A vendor is one adapter in ``ADAPTERS``; adding one touches nothing else.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions.text import null_if_empty, strip
from leafmill.operators.links import watch_url

WEB_SNIPPET, LONG_SNIPPET = 300, 500
KEEP = ("query_id", "payload_id")
HIT = (
    "id", "type", "title", "url", "thumbnail", "author", "duration_s", "source", "snippet", "published_at", "genre", "feed_url"
)
ADAPTERS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def adapter(vendor: str):
    def register(build):
        ADAPTERS[vendor] = build
        return build

    return register


def _rows(payloads: DataFrame, array: str, fields: str) -> DataFrame:
    parsed = payloads.select(*KEEP, F.from_json("body", f"{array} ARRAY<STRUCT<{fields}>>").alias("p"))
    return parsed.select(*KEEP, F.posexplode(f"p.{array}").alias("pos", "r"))


def _hits(rows: DataFrame, **columns: Column) -> DataFrame:
    filled = {name: columns.get(name, F.lit(None)) for name in HIT}
    return rows.select(*KEEP, "pos", *[c.cast("int" if n == "duration_s" else "string").alias(n) for n, c in filled.items()])


def _web(rows: DataFrame, snippet: Column, published: Column) -> DataFrame:
    usable = rows.filter("r.url <> ''")
    return _hits(
        usable, id=F.concat(F.lit("web:"), "r.url"), type=F.lit("web"), url=F.col("r.url"), source=F.lit("web"),
        title=F.coalesce(null_if_empty(strip(F.coalesce("r.title", F.lit("")))), "r.url"),
        snippet=null_if_empty(snippet), published_at=null_if_empty(published),
    )


@adapter("exa")
def exa(payloads: DataFrame) -> DataFrame:
    rows = _rows(payloads, "results", "url STRING, title STRING, highlights ARRAY<STRING>, publishedDate STRING")
    kept = F.filter(F.transform("r.highlights", lambda h: strip(h)), lambda h: h.isNotNull() & (h != ""))
    return _web(rows, F.left(F.array_join(kept, " … "), F.lit(WEB_SNIPPET)), F.col("r.publishedDate"))


@adapter("tinyfish")
def tinyfish(payloads: DataFrame) -> DataFrame:
    rows = _rows(payloads, "results", "url STRING, title STRING, snippet STRING, date STRING")
    return _web(rows, strip("r.snippet"), F.col("r.date"))


@adapter("marginalia")
def marginalia(payloads: DataFrame) -> DataFrame:
    rows = _rows(payloads, "results", "url STRING, title STRING, description STRING")
    return _web(rows, F.col("r.description"), F.lit(None).cast("string"))


@adapter("podcast")
def podcast(payloads: DataFrame) -> DataFrame:
    sizes = ("artworkUrl600", "artworkUrl160", "artworkUrl100", "artworkUrl60")
    rows = _rows(
        payloads, "results",
        "episodeUrl STRING, trackId BIGINT, trackName STRING, trackTimeMillis BIGINT, collectionName STRING, feedUrl STRING, "
        "releaseDate STRING, description STRING, genres ARRAY<STRUCT<name: STRING>>, " + ", ".join(f"{s} STRING" for s in sizes),
    ).filter("r.episodeUrl <> '' AND r.trackId IS NOT NULL")
    return _hits(
        rows, id=F.concat(F.lit("podcast:"), "r.trackId"), type=F.lit("episode"), url=F.col("r.episodeUrl"), source=F.lit("podcast"),
        title=F.coalesce(null_if_empty("r.trackName"), F.lit("Untitled episode")),
        thumbnail=F.coalesce(*[null_if_empty(f"r.{s}") for s in sizes]), author=F.col("r.collectionName"),
        duration_s=F.when(F.col("r.trackTimeMillis") != 0, F.floor(F.col("r.trackTimeMillis") / 1000)),
        snippet=null_if_empty(F.left("r.description", F.lit(LONG_SNIPPET))), published_at=F.col("r.releaseDate"),
        genre=F.get("r.genres", F.lit(0))["name"], feed_url=F.col("r.feedUrl"),
    )


@adapter("youtube_flat")
def youtube_flat(payloads: DataFrame) -> DataFrame:
    rows = _rows(
        payloads, "entries", "id STRING, title STRING, duration DOUBLE, channel STRING, uploader STRING, thumbnails ARRAY<STRUCT<url: STRING>>"
    ).filter("r.id <> ''")
    last = F.element_at("r.thumbnails", F.when(F.size("r.thumbnails") > 0, -1))["url"]
    still = F.concat(F.lit("https://i.ytimg.com/vi/"), "r.id", F.lit("/hqdefault.jpg"))
    return _hits(
        rows, id=F.concat(F.lit("youtube:"), "r.id"), type=F.lit("video"), url=watch_url(F.col("r.id")), source=F.lit("youtube"),
        title=F.coalesce(null_if_empty("r.title"), F.lit("Untitled")), thumbnail=F.coalesce(null_if_empty(last), still),
        author=F.coalesce(null_if_empty("r.channel"), "r.uploader"), duration_s=F.when(F.col("r.duration") != 0, F.floor("r.duration")),
    )


@adapter("youtube_paid")
def youtube_paid(payloads: DataFrame) -> DataFrame:
    rows = _rows(
        payloads, "videos",
        "id STRING, title STRING, lengthSeconds BIGINT, channel STRUCT<title: STRING>, description STRING, publishDate STRING, publishedTime STRING",
    ).filter("r.id <> ''")
    return _hits(
        rows, id=F.concat(F.lit("youtube:"), "r.id"), type=F.lit("video"), url=watch_url(F.col("r.id")), source=F.lit("youtube"),
        title=F.coalesce(null_if_empty("r.title"), F.lit("Untitled")), author=F.col("r.channel.title"),
        thumbnail=F.concat(F.lit("https://i.ytimg.com/vi/"), "r.id", F.lit("/hqdefault.jpg")), duration_s=F.col("r.lengthSeconds"),
        snippet=null_if_empty(F.left("r.description", F.lit(LONG_SNIPPET))), published_at=F.coalesce(null_if_empty("r.publishDate"), "r.publishedTime"),
    )


def normalise(payloads: DataFrame) -> DataFrame:
    """``payloads(query_id, payload_id, vendor, body)`` to hits, each vendor by its adapter."""
    parts = [build(payloads.filter(F.col("vendor") == vendor)).withColumn("vendor", F.lit(vendor)) for vendor, build in ADAPTERS.items()]
    return reduce(DataFrame.unionByName, parts)
