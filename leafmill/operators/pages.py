"""Article pages: what is furniture, what is content, what it links to. Columns over ``nodes`` of one page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions import urls
from leafmill.functions.media import parse_date
from leafmill.functions.text import collapse, let, null_if_empty, strip, words
from leafmill.operators.language import html_language
from leafmill.sources.pages import below, first, tagged, text_of, texts, within

MAX_LINKS = 250
ARTICLE_MIN_WORDS = 300
MAX_POST_LINKS = 3
MAX_LINK_SHARE = 0.25
TITLE_SEPARATOR = r"\s+[-–—|·•]\s+"
# Marks of a page whose text is for subscribers.
PAYWALL_BOX = r'class="paywall["\s]'
NOT_FREE = r'(?i)"isAccessibleForFree"\s*:\s*(false|"false")'
#: The elements that a page's title and record are read from.
RECORD_TAGS = ("title", "h1", "h2", "meta")
IN_ARTICLE = "/(article|main)/"
IN_CHROME = "/(header|nav|footer|aside)/"
FURNITURE_CLASSES = ("navbox", "reflist", "references", "mw-references-wrap")
# Section titles that end an encyclopedia article.
BACK_MATTER = (
    "see also", "notes", "references", "citations", "bibliography", "further reading", "external links", "footnotes",
    "works cited", "voir aussi", "notes et références", "références", "bibliographie", "liens externes",
    "articles connexes", "annexes", "véase también", "referencias", "notas", "bibliografía", "enlaces externos",
    "siehe auch", "literatur", "weblinks", "einzelnachweise", "anmerkungen", "voci correlate", "note", "bibliografia",
    "collegamenti esterni", "altri progetti",
)
# Classes of an encyclopedia page's furniture.
WIKI_FURNITURE = (
    "need_ref_tag", "mw-references-wrap", "reflist", "navbox", "navbox-styles", "infobox", "sidebar", "vertical-navbox",
    "hatnote", "ambox", "metadata", "noprint", "shortdescription", "mw-empty-elt",
)


def is_paywalled(html: Column | str) -> Column:
    html = F.col(html) if isinstance(html, str) else html
    return html.rlike(PAYWALL_BOX) | html.rlike(NOT_FREE)


def chrome_spans() -> Column:
    """A site's own header, menus and footer: not inside an article and not around one."""
    return F.filter(
        "nodes",
        lambda n: n["tag"].isin("header", "nav", "footer") & ~n["path"].rlike(IN_ARTICLE)
        & ~F.exists(below(n), lambda d: d["tag"].isin("article", "main")),
    )


def kept_text(spans: Column) -> Column:
    """The page's text runs outside some spans."""
    return let(spans, lambda s: F.array_join(texts(F.filter("nodes", lambda n: ~within(n, s))), " "))


def collapse_repeats(text: Column) -> Column:
    """A text that is a shorter one two to four times over reads once."""
    def folded(ws: Column) -> Column:
        out = F.lit(None).cast("string")
        for k in (2, 3, 4):
            one = F.slice(ws, F.lit(1), F.floor(F.size(ws) / k).cast("int"))
            again = F.flatten(F.array_repeat(one, k)) == ws
            out = F.when((F.size(ws) % k == 0) & (F.size(ws) > 0) & again, F.array_join(one, " ")).otherwise(out)
        return out

    return F.coalesce(let(words(text), folded), text)


def fold(text: Column) -> Column:
    return collapse(F.lower(text))


def meta(name: str, attribute: str = "property") -> Column:
    found = first(F.filter("nodes", lambda n: (n["tag"] == "meta") & (n["attrs"][attribute] == name)))
    return null_if_empty(strip(found["attrs"]["content"]))


def html_title() -> Column:
    return null_if_empty(text_of(first(tagged("title"))))


def checked_title(extracted: Column) -> Column:
    """The extracted title, unless the page's own title and headings agree on another."""
    page_title = F.coalesce(html_title(), F.lit(""))
    parens = r"^(.*\S)\s*\(([^()]+)\)$"
    split = rf"^(.*){TITLE_SEPARATOR}(.*)$"
    headings = F.transform(tagged("h1", "h2"), lambda h: F.struct(fold(text_of(h)).alias("t"), h["path"].alias("path"), h["tag"].alias("tag")))

    def decide(x: Column) -> Column:
        title, mine, heads, declared = x["title"], x["extracted"], x["heads"], x["declared"]
        bracketed = title.rlike(parens)
        head = F.when(bracketed, F.regexp_extract(title, parens, 1)).otherwise(F.regexp_extract(title, split, 1))
        site = F.when(bracketed, F.regexp_extract(title, parens, 2)).otherwise(F.regexp_extract(title, split, 2))
        usable = bracketed | title.rlike(split)
        has = F.coalesce(mine != "", F.lit(False))
        named = has & fold(title).contains(fold(mine)) & (fold(mine) != fold(site))
        own = F.exists(heads, lambda h: (h["t"] == fold(head)) & (h["path"].rlike(IN_ARTICLE) | ~h["path"].rlike(IN_CHROME)))
        in_body = has & F.exists(heads, lambda h: (h["tag"] == "h1") & (h["t"] == fold(mine)) & h["path"].rlike(IN_ARTICLE))
        is_site = F.coalesce(fold(declared) == fold(head), F.lit(False))
        return F.when(usable & ~named & ~in_body & ~is_site & own, strip(head)).otherwise(mine)

    packed = F.struct(
        page_title.alias("title"), extracted.alias("extracted"), headings.alias("heads"), meta("og:site_name").alias("declared")
    )
    return let(packed, decide)


def site_from_title(page_title: Column, title: Column) -> Column:
    """The site's name when the page's title appends it to the article's."""
    rest = strip(F.substr(page_title, F.length(title) + 1))
    bracketed = rest.rlike(r"^\(.*\)$")
    inner = null_if_empty(strip(F.regexp_replace(rest, r"^\(|\)$", "")))
    parts = F.split(F.concat(F.lit(" "), rest), TITLE_SEPARATOR)
    last = null_if_empty(strip(F.element_at(parts, -1)))
    named = F.when(bracketed, inner).when(F.size(parts) >= 2, last)
    return F.when(F.lower(page_title).startswith(F.lower(title)), named)


def declared_feeds(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """Feeds a page declares, in page order; feeds of comments are of the wrong thing."""
    links = F.filter("nodes", lambda n: (n["tag"] == "link") & n["attrs"]["href"].isNotNull() & F.coalesce(n["attrs"]["rel"], F.lit("")).rlike(r"(^|\s)alternate(\s|$)")
                     & F.coalesce(n["attrs"]["type"], F.lit("")).rlike("rss|atom") & ~F.lower(n["attrs"]["href"]).contains("comment"))
    rows = pages.select(key, "url", F.posexplode(links).alias("rank", "n"))
    return rows.select(key, "rank", urls.absolute("url", F.col("n.attrs.href")).alias("feed_url"))


def site_icons(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """Icons a page declares, largest first, then the usual one at the root."""
    root = F.concat(F.regexp_extract("url", r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1), F.lit("//"), urls.netloc("url"))

    def size(n: Column) -> Column:
        numbers = F.transform(F.regexp_extract_all(F.coalesce(n["attrs"]["sizes"], F.lit("")), F.lit(r"(\d+)"), 1), lambda x: x.cast("int"))
        return F.coalesce(F.array_max(numbers), F.lit(0))

    icons = F.filter("nodes", lambda n: (n["tag"] == "link") & F.lower(F.coalesce(n["attrs"]["rel"], F.lit(""))).contains("icon") & (F.coalesce(n["attrs"]["href"], F.lit("")) != ""))
    sized = F.array_sort(F.transform(icons, lambda n: F.struct((-size(n)).alias("s"), n["no"].alias("no"), n["attrs"]["href"].alias("href"))))
    hrefs = F.concat(F.transform(sized, lambda x: x["href"]), F.array(F.lit("/favicon.ico")))
    rows = pages.select(key, root.alias("_root"), F.posexplode(hrefs).alias("rank", "href"))
    return rows.select(key, "rank", urls.absolute(F.concat("_root", F.lit("/")), "href").alias("icon_url"))


def article_records(pages: DataFrame, texts_md: DataFrame, key: str = "page_id") -> DataFrame:
    """Title, author, date, language, site and state of each page. ``pages`` with ``html`` and ``nodes`` (of ``RECORD_TAGS`` at least); ``texts_md(key, md)``.

    Only a page's facts and the measures of its text meet: neither markup nor nodes nor text is shuffled.
    """
    extracted = F.coalesce(text_of(first(F.filter(tagged("h1"), lambda h: h["path"].rlike(IN_ARTICLE)))), text_of(first(tagged("h1"))))
    rows = pages.select(
        key, "url", checked_title(extracted).alias("title"), meta("author", "name").alias("author"),
        parse_date(F.coalesce(meta("article:published_time"), meta("date", "name"))).alias("published_at"),
        html_language("html").alias("language"), is_paywalled("html").alias("paywalled"),
        html_title().alias("_page_title"), meta("og:site_name").alias("_declared"),
    )
    measured = texts_md.select(key, (F.trim("md") != "").alias("_said"), F.length("md").alias("size_chars"))
    joined = rows.join(measured, key, "left")
    unreadable = ~F.coalesce("_said", F.lit(False))
    return joined.select(
        key, "url", F.coalesce(null_if_empty("title"), "_page_title", urls.slug_title("url")).alias("title"), "author",
        "published_at", "language", F.coalesce("_declared", site_from_title(F.col("_page_title"), F.col("title"))).alias("site_name"),
        "paywalled", (unreadable & ~F.col("paywalled")).alias("unreadable"), "size_chars",
    )
