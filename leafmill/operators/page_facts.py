"""What a page is made of, measured in the one pass that reads it: its text, how much of it is links, what it heads, where it links to.

The measures of a batch of pages come from sweeps over their nodes (``sources.sweep``), linear in the nodes. All that is
judged from them (addresses, shapes of links, limits) is column work on the page's own row: no shuffle, no second reading.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions import urls
from leafmill.functions.text import collapse, let, words
from leafmill.operators.links import looks_like_article
from leafmill.operators.page_cleanup import main_content
from leafmill.operators.pages import ARTICLE_MIN_WORDS, FURNITURE_CLASSES, MAX_LINK_SHARE, MAX_LINKS, MAX_POST_LINKS, collapse_repeats
from leafmill.sources.pages import parsed
from leafmill.sources.sweep import Flat

FACTS = (
    "text STRING, main STRING, linked STRING, heads ARRAY<STRING>, articles INT, "
    "links ARRAY<STRUCT<no: INT, href: STRING, text: STRING, in_prose: BOOLEAN>>"
)
_LINK = pa.struct([("no", pa.int32()), ("href", pa.string()), ("text", pa.string()), ("in_prose", pa.bool_())])


def with_role(flat: Flat, *names: str) -> np.ndarray:
    out = np.zeros(flat.n, bool)
    out[[node for node, role in flat.attr("role").items() if role in names]] = True
    return out


def measured(flat: Flat) -> list[pa.Array]:
    """The columns of ``FACTS``: text without the site's chrome, text of the content and of the links in it, targets of headline links, article elements, links outside furniture."""
    articles = flat.tags("article", "main")
    chrome = flat.inside(flat.tags("header", "nav", "footer") & ~flat.inside(articles, itself=False) & (flat.below(articles) == 0))
    content, linked = main_content(flat, False) & ~chrome, flat.inside(flat.tags("a"), itself=False)
    href = flat.attr("href")
    anchors = np.zeros(flat.n, bool)
    anchors[list(href)] = True
    anchors &= flat.tags("a")

    def texts(kept: np.ndarray) -> pa.Array:
        runs = flat.runs[kept[flat.runs]]
        bounds = np.searchsorted(runs, flat.ends)
        return pa.array([" ".join(flat.stripped[i] for i in runs[a:b]) for a, b in zip(bounds[:-1], bounds[1:])], pa.string())

    outside = ~flat.inside(flat.tags("nav", "footer") | with_role(flat, "navigation", "contentinfo"))
    heads = np.flatnonzero(flat.tags("h1", "h2", "h3", "h4") & outside)
    at, around = np.flatnonzero(anchors), flat.nearest(anchors)
    following = np.append(at, flat.n)[np.searchsorted(at, heads, "right")]
    target = np.where(following <= flat.last[heads], following, around[heads])
    heads, target = heads[target < flat.n], target[target < flat.n]
    own = np.searchsorted(heads, flat.ends)
    count = np.cumsum(np.append(0, flat.tags("article") & outside))
    furniture = flat.inside(
        flat.tags("nav", "header", "footer", "aside") | flat.with_class(*FURNITURE_CLASSES) | with_role(flat, "navigation", "banner", "contentinfo", "complementary")
    )
    prose = flat.inside(flat.tags("p", "blockquote", "dd", "figcaption"), itself=False)
    links = np.flatnonzero(anchors & ~furniture)
    base = flat.ends[:-1][flat.page[links]]
    rows = pa.StructArray.from_arrays([
        pa.array(links - base, pa.int32()), pa.array([href[i] for i in links.tolist()], pa.string()),
        pa.array([flat.text_of(i) for i in links.tolist()], pa.string()), pa.array(prose[links]),
    ], fields=list(_LINK))
    return [
        texts(~chrome), texts(content), texts(content & linked),
        pa.ListArray.from_arrays(pa.array(own, pa.int32()), pa.array([href[i] for i in target.tolist()], pa.string())),
        pa.array(np.diff(count[flat.ends]), pa.int32()),
        pa.ListArray.from_arrays(pa.array(np.searchsorted(links, flat.ends), pa.int32()), rows),
    ]


def page_facts(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """``pages(key, url, html)`` to (key, url) and ``FACTS``."""
    kind = dict(pages.dtypes)[key]
    names = [key, "url", "text", "main", "linked", "heads", "articles", "links"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, read in parsed(batches):
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *measured(Flat.of(read))], names)

    return pages.select(key, "url", "html").mapInArrow(run, f"{key} {kind}, url STRING, {FACTS}")


def headline_links() -> Column:
    """How many other pages of the site a page heads with a link, or how many articles it holds."""
    netloc, page = urls.netloc("url"), F.regexp_replace(urls.without_fragment("url"), "/+$", "")
    targets = F.transform("heads", lambda h: urls.without_fragment(urls.absolute(F.col("url"), h)))
    others = F.filter(targets, lambda u: (urls.netloc(u) == netloc) & (F.regexp_replace(u, "/+$", "") != page))
    return F.greatest(F.size(F.array_distinct(others)), F.when(F.col("articles") >= 2, F.col("articles")).otherwise(0))


def article_link_array(limit: int) -> Column:
    """Likely article links of a page, each address once, confident ones first: (uncertain, no, href, text)."""
    page = F.regexp_replace(urls.without_fragment("url"), "/+$", "")
    found = F.transform("links", lambda n: F.struct(
        urls.without_fragment(urls.absolute(F.col("url"), n["href"])).alias("href"), n["no"].alias("no"), n["in_prose"].alias("uncertain"),
        collapse_repeats(collapse(n["text"])).alias("text"),
    ))
    wanted = F.filter(found, lambda n: (
        (F.regexp_replace(n["href"], "/+$", "") != page) & looks_like_article(n["href"], F.col("url")) & ((n["text"] == "") | n["text"].rlike(r"\p{L}"))
    ))
    # Sorted by address and place, the first of each address is the one whose address differs from the one before.
    once = let(F.array_sort(wanted), lambda rows: F.filter(rows, lambda n, i: (i == 0) | (F.get(rows, i - 1)["href"] != n["href"])))
    order = F.transform(once, lambda n: F.struct(n["uncertain"].alias("uncertain"), n["no"].alias("no"), n["href"].alias("href"), n["text"].alias("text")))
    return F.slice(F.array_sort(order), 1, limit)


def article_links(facts: DataFrame, key: str = "page_id", limit: int = MAX_LINKS) -> DataFrame:
    """Likely article links of each page, confident ones first; a link inside prose is uncertain."""
    rows = facts.select(key, F.posexplode(article_link_array(limit)).alias("place", "l"))
    title = F.when(F.length("l.text") >= 4, F.col("l.text")).otherwise(urls.slug_title("l.href"))
    return rows.select(key, "l.href", title.alias("title"), "l.uncertain", (F.col("place") + 1).alias("place"))


def content_measures(facts: DataFrame, key: str = "page_id") -> DataFrame:
    """The content's text and words, and how many of its words are link text."""
    return facts.select(key, "url", F.col("main").alias("text"), F.size(words("main")).alias("words"), F.size(words("linked")).alias("link_words"))


def reads_as_article(facts: DataFrame, key: str = "page_id") -> DataFrame:
    """Whether each page is one piece of prose rather than a door to others."""
    sure = F.size(F.filter(article_link_array(2**31 - 1), lambda n: ~n["uncertain"]))
    rows = facts.select(
        key, F.size(words("main")).alias("words"), F.size(words("linked")).alias("link_words"), headline_links().alias("headlines"), sure.alias("sure_links"),
    )
    prose = (F.greatest("sure_links", "headlines") <= MAX_POST_LINKS) & (F.col("words") >= ARTICLE_MIN_WORDS) & (
        F.col("link_words") <= MAX_LINK_SHARE * F.col("words")
    )
    return rows.withColumn("reads_as_article", prose)
