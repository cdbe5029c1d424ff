"""RSS and Atom feeds, one document per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions.media import clock_to_seconds
from leafmill.functions.text import null_if_empty, strip
from leafmill.operators.language import normalize_language
from leafmill.operators.linkage import match_entries

MAX_ENTRIES = 250
RSS_ITEM = (
    "STRUCT<title: STRING, link: STRING, author: STRING, creator: STRING, pubDate: STRING, description: STRING, encoded: STRING, "
    "duration: STRING, enclosure: ARRAY<STRUCT<_url: STRING, _type: STRING>>, "
    "transcript: ARRAY<STRUCT<_url: STRING, _type: STRING, _language: STRING>>>"
)
ATOM_ENTRY = (
    "STRUCT<title: STRING, link: ARRAY<STRUCT<_href: STRING, _rel: STRING, _type: STRING>>, author: STRUCT<name: STRING>, "
    "published: STRING, updated: STRING, summary: STRING, content: STRING>"
)
FEED = (
    f"channel STRUCT<title: STRING, generator: STRING, language: STRING, item: ARRAY<{RSS_ITEM}>>, "
    f"title STRING, generator STRING, entry ARRAY<{ATOM_ENTRY}>"
)
# Transcript formats, most structured first.
TRANSCRIPT_FORMATS = (
    "application/json", "text/vtt", "application/srt", "application/x-subrip", "text/plain", "text/html"
)
READ_MORE = r'(?i)<a\s[^>]*href="([^"]+)"[^>]*>\s*Read more\s*</a>\s*</p>\s*$'
NEWSLETTER_PLATFORM = "substack"


def parsed_feeds(feeds: DataFrame) -> DataFrame:
    """``feeds(feed_id, xml)`` with the parsed document; one that does not parse has no entries."""
    options = {"ignoreNamespace": "true", "mode": "PERMISSIVE"}
    return feeds.select("feed_id", F.from_xml("xml", F.lit(FEED), options).alias("f"))


def _date(text: Column) -> Column:
    rfc = F.regexp_replace(F.regexp_replace(text, r"^\s*[A-Za-z]{3},\s*", ""), r"\s(GMT|UTC|UT|Z)\s*$", " +0000")
    shaped = rfc.rlike(r"^\d{1,2} [A-Z][a-z]{2} \d{4} \d{2}:\d{2}:\d{2} [+-]\d{4}$")
    iso = text.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$")
    return F.coalesce(
        F.when(shaped, F.try_to_timestamp(rfc, F.lit("d MMM yyyy HH:mm:ss xx"))), F.when(iso, F.try_to_timestamp(text))
    )


def ends_on_read_more(content: Column, url: Column) -> Column:
    target = F.regexp_extract(content, READ_MORE, 1)
    return (target != "") & (F.regexp_replace(target, "/+$", "") == F.regexp_replace(url, "/+$", ""))


def feed_entries(feeds: DataFrame, limit: int = MAX_ENTRIES) -> DataFrame:
    """One row per entry, at most ``limit`` per feed in feed order."""
    parsed = parsed_feeds(feeds)
    rss = parsed.select("feed_id", "f.channel.title", "f.channel.generator", F.posexplode("f.channel.item").alias("pos", "e"))
    audio = F.get(F.filter("e.enclosure", lambda x: x["_type"].startswith("audio/") & (x["_url"] != "")), F.lit(0))["_url"]
    rss_rows = rss.select(
        "feed_id", "pos", F.col("title").alias("feed_title"), "generator", F.coalesce("e.title", F.lit("")).alias("title"),
        F.coalesce(strip("e.link"), F.lit("")).alias("url"), null_if_empty(F.coalesce("e.author", "e.creator")).alias("author"),
        _date(F.col("e.pubDate")).alias("published_at"), F.coalesce("e.encoded", "e.description", F.lit("")).alias("content_html"),
        audio.alias("audio_url"), clock_to_seconds("e.duration").alias("duration_s"),
    )
    atom = parsed.select("feed_id", "f.title", "f.generator", F.posexplode("f.entry").alias("pos", "e"))
    page = F.get(F.filter("e.link", lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate"), F.lit(0))["_href"]
    sound = F.get(F.filter("e.link", lambda x: (x["_rel"] == "enclosure") & x["_type"].startswith("audio/")), F.lit(0))["_href"]
    atom_rows = atom.select(
        "feed_id", "pos", F.col("title").alias("feed_title"), "generator", F.coalesce("e.title", F.lit("")).alias("title"),
        F.coalesce(page, F.lit("")).alias("url"), null_if_empty("e.author.name").alias("author"),
        _date(F.coalesce("e.published", "e.updated")).alias("published_at"), F.coalesce("e.content", "e.summary", F.lit("")).alias("content_html"),
        sound.alias("audio_url"), F.lit(None).cast("bigint").alias("duration_s"),
    )
    rows = rss_rows.unionByName(atom_rows).filter(F.col("pos") < limit)
    teaser = F.lower(F.coalesce("generator", F.lit(""))).contains(NEWSLETTER_PLATFORM) & ends_on_read_more(F.col("content_html"), F.col("url"))
    return rows.withColumn("paywalled", teaser).drop("generator")


def transcript_links(feeds: DataFrame, wanted: DataFrame) -> DataFrame:
    """Transcript links of the wanted episodes (feed_id, wanted_id, audio_url, title), best format first."""
    items = parsed_feeds(feeds).select(
        "feed_id", normalize_language("f.channel.language").alias("_channel"), F.posexplode("f.channel.item").alias("pos", "e")
    )
    entries = items.select(
        "feed_id", "pos", F.get("e.enclosure", F.lit(0))["_url"].alias("enclosure_url"), F.coalesce("e.title", F.lit("")).alias("title")
    )
    matched = match_entries(wanted, entries)
    known = F.array(*[F.lit(x) for x in TRANSCRIPT_FORMATS])

    def link(t: Column, at: Column) -> Column:
        kind = F.lower(F.coalesce(t["_type"], F.lit("")))
        place = F.when(F.array_position(known, kind) > 0, F.array_position(known, kind)).otherwise(len(TRANSCRIPT_FORMATS) + 1)
        return F.struct(
            place.alias("p"), at.alias("a"), t["_url"].alias("url"), kind.alias("type"),
            F.coalesce(normalize_language(t["_language"]), F.col("_channel")).alias("language"),
        )

    # An episode lists a handful of links: they are put in order on its row.
    links = F.array_sort(F.filter(F.transform("e.transcript", link), lambda x: x["url"] != ""))
    tagged = items.select("feed_id", "pos", links.alias("_links")).filter(F.size("_links") > 0)
    ranked = matched.join(tagged, ["feed_id", "pos"]).select("feed_id", "wanted_id", F.posexplode("_links").alias("rank", "l"))
    return ranked.select("feed_id", "wanted_id", "rank", "l.url", "l.type", "l.language")
