"""Sources to items, and items to chapter drafts, over pages, feeds and transcripts already fetched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions import urls
from leafmill.functions.text import blank, null_if_empty
from leafmill.operators import jobs as J
from leafmill.operators.language import detect_language, normalize_language
from leafmill.operators.links import looks_like_article, url_kind, wiki_title
from leafmill.operators.markdown import demote_headings, strip_leading_title
from leafmill.operators.ordered import settle
from leafmill.operators.titles import chapter_title

MAX_ITEMS = 250
FEED_PATHS = ("/feed", "/rss", "/feed.xml", "/index.xml", "/rss.xml")
SUMMARY_ONLY = "The full article didn't load, so this is the RSS summary only."


def _choice(strategy: int, rank: Column | None = None) -> Column:
    """The strategy, and within it the rank of the feed."""
    rank = F.lit(0) if rank is None else rank
    return F.struct(F.lit(strategy).alias("strategy"), rank.cast("bigint").alias("rank")).alias("choice")


def expand_sources(
    sources: DataFrame, pages: DataFrame, declared: DataFrame, entries: DataFrame, links: DataFrame
) -> DataFrame:
    """Items per source by the first strategy that finds any.

    ``sources(job_id, source_index, url, query)``; ``pages(url, title, reads_as_article)``;
    ``declared(url, rank, feed_url)``; ``entries(feed_url, pos, title, item_url, audio_url)``;
    ``links(url, place, href, title, uncertain)``. Strategies, best first: the page itself (an
    encyclopedia or article URL, or a deep page found by search), the source as a feed, a page that
    reads as one article, declared feeds in page order, the usual feed paths, the page's links.
    """
    keys = ["job_id", "source_index"]
    base = sources.select(*keys, "url", F.col("query").isNotNull().alias("_asked"))
    itself = base.filter(
        wiki_title("url").isNotNull() | looks_like_article("url", "url") | (F.col("_asked") & urls.is_deep("url"))
    ).join(pages.select("url", F.col("title").alias("_page")), "url", "left").select(
        *keys, _choice(0), F.lit(0).cast("bigint").alias("at"),
        F.coalesce(wiki_title("url"), null_if_empty("_page"), urls.slug_title("url")).alias("title"), F.col("url").alias("item_url"),
        F.lit(False).alias("uncertain"),
    )

    def from_feeds(found: DataFrame, strategy: int) -> DataFrame:
        # ``found(keys, rank, feed_url)``: within a strategy the first feed with entries wins.
        rows = found.join(entries, "feed_url").filter(F.col("pos") < MAX_ITEMS)
        return rows.select(
            *keys, _choice(strategy, F.col("rank")), F.col("pos").cast("bigint").alias("at"),
            F.coalesce(null_if_empty("title"), F.when(F.col("audio_url").isNotNull(), urls.stem_title("audio_url")), F.lit("Untitled")).alias("title"),
            F.coalesce("audio_url", "item_url").alias("item_url"), F.lit(False).alias("uncertain"),
        )

    as_feed = base.select(*keys, F.lit(0).alias("rank"), F.col("url").alias("feed_url"))
    article = base.filter(~urls.is_home("url")).join(pages.filter("reads_as_article"), "url").select(
        *keys, _choice(2), F.lit(0).cast("bigint").alias("at"), "title", F.col("url").alias("item_url"), F.lit(False).alias("uncertain")
    )
    named = base.join(declared, "url").select(*keys, "rank", "feed_url")
    root = F.concat(F.regexp_extract("url", "^([A-Za-z][A-Za-z0-9+.-]*:)", 1), F.lit("//"), urls.netloc("url"))
    guessed = base.select(*keys, root.alias("_root"), F.posexplode(F.array(*[F.lit(p) for p in FEED_PATHS])).alias("rank", "_path")).select(
        *keys, "rank", F.concat("_root", "_path").alias("feed_url")
    )
    linked = base.join(links, "url").select(
        *keys, _choice(5), F.col("place").cast("bigint").alias("at"), "title", F.col("href").alias("item_url"), "uncertain"
    )
    candidates = itself
    for part in (from_feeds(as_feed, 1), article, from_feeds(named, 3), from_feeds(guessed, 4), linked):
        candidates = candidates.unionByName(part)
    candidates = settle(candidates)
    best = candidates.groupBy(*keys).agg(F.min("choice").alias("choice"))
    chosen = candidates.join(best, [*keys, "choice"])
    # A source lists at most 250 items, so this window is bounded.
    order = Window.partitionBy(*keys).orderBy("at")
    return chosen.select(
        *keys, F.col("choice.strategy").alias("strategy"), (F.row_number().over(order) - 1).alias("item_index"), "title",
        F.col("item_url").alias("url"), "uncertain", url_kind("item_url").alias("kind"),
    )


def draft_chapters(items: DataFrame, transcripts: DataFrame, pages: DataFrame) -> DataFrame:
    """Each item's chapter with no AI: its text by type, its language, or why there is none.

    ``items(id, title, title_suffix, url, item_type, preview_md)``;
    ``transcripts(url, md, language, uploader, channel_url)``;
    ``pages(url, md, language, author, paywalled)``. A page that did not load falls back to the feed's summary.
    """
    spoken = items.filter(F.col("item_type").isin("youtube", "podcast")).join(transcripts, "url", "left").select(
        "id", "title", "title_suffix", "url", "item_type", F.col("md").alias("content_md"), F.col("language").alias("_declared"),
        F.when(F.col("item_type") == "youtube", F.col("uploader")).alias("author"),
        F.when(F.col("item_type") == "youtube", F.col("channel_url")).alias("channel_url"),
        F.lit(None).cast("string").alias("note"), F.col("md").isNotNull().alias("_has"), F.lit(False).alias("_paid"),
    )
    loaded = F.col("md").isNotNull()
    body = demote_headings(strip_leading_title(F.coalesce("md", "preview_md", F.lit("")), "title"))
    read = items.filter(F.col("item_type") == "blog").join(pages, "url", "left").select(
        "id", "title", "title_suffix", "url", "item_type", body.alias("content_md"), F.col("language").alias("_declared"), "author",
        F.lit(None).cast("string").alias("channel_url"), F.when(~loaded, SUMMARY_ONLY).alias("note"), F.lit(True).alias("_has"),
        F.coalesce("paywalled", F.lit(False)).alias("_paid"),
    )
    rows = spoken.unionByName(read)
    reason = J.skip_reason(F.col("item_type"), F.col("_has"), F.coalesce(blank("content_md"), F.lit(True)), F.col("_paid"))
    judged = rows.withColumn("skip_reason", reason)
    kept = F.col("skip_reason").isNull()
    return judged.select(
        "id", "item_type", chapter_title("title", "title_suffix").alias("title"), F.col("url").alias("source_url"), "author", "channel_url",
        F.when(kept, F.col("content_md")).alias("content_md"),
        F.when(kept, F.coalesce(normalize_language("_declared"), detect_language("content_md"))).alias("language"),
        F.when(kept, F.col("note")).alias("note"), "skip_reason",
    )
