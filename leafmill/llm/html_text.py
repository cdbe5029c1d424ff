"""The main text of pages by tag-path ratios.

1. A page is read into elements and blocks. A block is the text between two block-level tags; its path is the chain
   of tags (with their classes) from the root to it.
2. For each path, text length and punctuation marks are summed up and divided by the number of its blocks.
   Both ratios are smoothed over neighbouring blocks in page order, fused by their product, and blocks from a
   threshold (a share of the deviation, at most half the peak) up are content.
3. Elements that are not article text by tag, role or name (menus, forms, page headers and footers, sidebars, adverts, notices,
   comments) are set aside with what the ratios found in them, but not one around an article or, on a page without article
   elements, around half of all content: that is the page's frame, whatever its name. A name that also has an innocent meaning (``LOOSE_ASIDE``)
   sets aside only what the ratios did not select.
4. Of the rest, the article is the innermost article element that holds half of the content; without one, the smallest container
   that holds all of the content, and its own container while that adds a little more (``WIDEN`` of its text at most), such as a
   heading and a lead. Its blocks are the result, so that headings and short paragraphs stay with the paths that were found.

A page is one row: nothing is shuffled, and a task holds a few pages at a time.

Defined results: null and empty pages, and pages without text, give an empty text and 0; null ids and addresses
come back as they are; repeated rows get equal results; ties go to the inner element; an empty table gives no rows;
other columns are ignored. Unclosed tags are closed as browsers do for paragraphs, list items and table cells;
``br`` is white space.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HALF = 0.5
WIDEN = 0.25
DEVIATIONS = 0.8
SMOOTH = (0.25, 0.5, 0.25)

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>",
    re.S,
)
_NAMED = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_MARKS = re.compile(r"[.,;:!?…。，、！？；：]")

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not page text.
RAW = set("script style noscript template textarea title iframe noembed noframes xmp svg math object canvas audio video select".split())
BLOCK = set(
    "address article aside blockquote body center caption dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html legend li main menu nav ol option optgroup p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: What a start tag closes if it is open: the tags closed, and the element that shields them.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}), "tfoot": ({"thead", "tbody", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select"}), "body": ({"head"}, set()),
}
ASIDE_TAGS = set("nav footer aside form button dialog menu head fieldset".split())
ASIDE_ROLES = set("navigation contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
ASIDE_WORDS = set(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion nav navbar navigation menu menus footer sidebar sidebars "
    "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social "
    "related recommended recommendations breadcrumb breadcrumbs pagination pager comment comments respond replies disqus widget widgets toolbar "
    "copyright disclaimer outbrain taboola searchbox skip".split()
)
#: Those of them that also name parts of articles.
LOOSE_ASIDE = set("promo promotion menu menus alert notice notices share sharing social related widget widgets skip overlay signup login subscribe subscription copyright respond".split())
#: Aside only outside an article, where they belong to the page.
PAGE_WORDS = set("header masthead banner topbar".split())
#: A class with one of these tells of something else on the page.
LOOSE_WORDS = {"has", "with", "no", "without", "is", "page", "layout"}
KEPT_TAGS = {"html", "body", "article", "main"}


#: Elements that can be an article.
HOLDERS = {"", "html", "body", "div", "section", "td", "center", "article", "main", "span"}


@dataclass
class Element:
    tag: str
    parent: int
    path: str
    aside: bool
    page_head: bool
    article: bool
    #: Aside by a name that also has an innocent meaning.
    loose: bool


@dataclass
class Page:
    elements: list[Element] = field(default_factory=lambda: [Element("", -1, "", False, False, False, False)])
    #: Element and text of each block, in page order.
    blocks: list[tuple[int, str]] = field(default_factory=list)


def _element(tag: str, attributes: str, parent: int, path: str) -> Element:
    found = {m[1].lower(): entities.unescape(m[2] or m[3] or m[4] or "") for m in _NAMED.finditer(attributes)} if attributes else {}
    role = found.get("role", "").strip().lower()
    aside, head, loose = tag in ASIDE_TAGS or role in ASIDE_ROLES, tag == "header" or role == "banner", False
    for name in f"{found.get('class', '')} {found.get('id', '')}".split():
        words = {w.lower() for w in _PARTS.findall(name)}
        if not words & LOOSE_WORDS:
            aside |= bool(words & (ASIDE_WORDS - LOOSE_ASIDE))
            loose |= bool(words & LOOSE_ASIDE)
            head |= bool(words & PAGE_WORDS)
    if tag in KEPT_TAGS:
        aside = head = loose = False
    label = ".".join([tag, *found.get("class", "").split()])
    return Element(tag, parent, f"{path}/{label}", aside, head, tag in ("article", "main") or role in ("main", "article"), loose)


def page_of(text: str) -> Page:
    page = Page()
    stack = [0]
    words: list[str] = []

    def close_block() -> None:
        joined = " ".join(entities.unescape("".join(words)).split())
        words.clear()
        if joined:
            page.blocks.append((stack[-1], joined))

    def pop_to(depth: int) -> None:
        if any(page.elements[e].tag in BLOCK for e in stack[depth:]):
            close_block()
        del stack[depth:]

    at = 0
    lowered = ""
    while True:
        token = _TOKEN.search(text, at)
        if token is None:
            words.append(text[at:])
            break
        words.append(text[at : token.start()])
        at = token.end()
        slash, tag, attributes = (token[1], token[2], token[3]) if token[2] else (token[4], token[5], token[6])
        if tag is None:
            if token[0].startswith("<![CDATA["):
                words.append(entities.escape(token[0][9:].removesuffix("]]>")))
            continue
        tag = tag.lower()
        if slash:
            for depth in range(len(stack) - 1, 0, -1):
                open_tag = page.elements[stack[depth]].tag
                if open_tag == tag:
                    pop_to(depth)
                    break
                # An inline end tag does not reach out of its block.
                if tag not in BLOCK and open_tag in BLOCK:
                    break
            continue
        if tag in RAW:
            lowered = lowered or text.lower()
            if len(lowered) != len(text):
                lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text)
            end = -1 if attributes.endswith("/") and tag in ("svg", "math", "canvas") else lowered.find(f"</{tag}", at)
            if end >= 0:
                close = text.find(">", end)
                at = close + 1 if close >= 0 else len(text)
            elif tag in ("script", "style", "textarea", "title"):
                break
            words.append(" ")
            continue
        if tag in VOID:
            if tag == "hr":
                close_block()
            elif tag == "br":
                words.append(" ")
            continue
        if tag in BLOCK:
            close_block()
            # A paragraph ends where a block begins, with what is still open in it.
            for depth in range(len(stack) - 1, 0, -1):
                open_tag = page.elements[stack[depth]].tag
                if open_tag == "p":
                    pop_to(depth)
                    break
                if open_tag in BLOCK:
                    break
        if tag in CLOSES:
            closed, shield = CLOSES[tag]
            for depth in range(len(stack) - 1, 0, -1):
                open_tag = page.elements[stack[depth]].tag
                if open_tag in shield:
                    break
                if open_tag in closed:
                    pop_to(depth)
        parent = stack[-1]
        page.elements.append(_element(tag, attributes, parent, page.elements[parent].path))
        stack.append(len(page.elements) - 1)
    close_block()
    return page


def _sums(page: Page, values: list[tuple[int, int]]) -> list[int]:
    """For each element the sum of the values of the blocks in it."""
    out = [0] * len(page.elements)
    for e, value in values:
        out[e] += value
    for i in range(len(out) - 1, 0, -1):
        out[page.elements[i].parent] += out[i]
    return out


def _kept(page: Page, chosen: list[bool]) -> list[bool]:
    """Which blocks are outside the elements that are set aside."""
    elements = page.elements
    found = _sums(page, [(e, len(text) * good) for (e, text), good in zip(page.blocks, chosen)])
    holds = [False] * len(elements)
    for i in range(len(elements) - 1, 0, -1):
        holds[elements[i].parent] |= holds[i] or elements[i].article
    inside, out, loose = ([False] * len(elements) for _ in range(3))
    for i in range(1, len(elements)):
        e = elements[i]
        inside[i] = inside[e.parent] or e.article
        frame = holds[i] or not holds[0] and found[0] and found[i] >= HALF * found[0]
        out[i] = out[e.parent] or not frame and (e.aside or e.page_head and not inside[e.parent])
        loose[i] = loose[e.parent] or not frame and e.loose
    return [not out[e] and (good or not loose[e]) for (e, _), good in zip(page.blocks, chosen)]


def _smoothed(values: list[float]) -> list[float]:
    padded = [values[0], *values, values[-1]]
    return [sum(w * v for w, v in zip(SMOOTH, padded[i : i + 3])) for i in range(len(values))]


def content(blocks: list[tuple[int, str]], page: Page) -> list[bool]:
    """Which blocks the fused path ratios select."""
    length: dict[str, int] = defaultdict(int)
    marks: dict[str, int] = defaultdict(int)
    count: dict[str, int] = defaultdict(int)
    paths = [page.elements[e].path for e, _ in blocks]
    for path, (_, text) in zip(paths, blocks):
        length[path] += len(text)
        marks[path] += len(_MARKS.findall(text))
        count[path] += 1
    long = _smoothed([length[p] / count[p] for p in paths])
    marked = _smoothed([1 + marks[p] / count[p] for p in paths])
    fused = [a * b for a, b in zip(long, marked)]
    mean = sum(fused) / len(fused)
    deviation = math.sqrt(sum((f - mean) ** 2 for f in fused) / len(fused))
    threshold = min(DEVIATIONS * deviation, max(fused) / 2)
    return [f >= threshold for f in fused]


def _root(page: Page, kept: list[tuple[int, str]], chosen: list[bool]) -> int:
    """The element whose kept blocks are the article."""
    elements = page.elements
    held = _sums(page, [(e, len(text) * good) for (e, text), good in zip(kept, chosen)])
    articles = [i for i, e in enumerate(elements) if e.article and held[i] >= HALF * held[0]]
    if articles and held[0]:
        return articles[-1]
    # The last element in page order that holds all lies in all others that do.
    root = max(i for i in range(len(held)) if held[i] == held[0])
    while elements[root].tag not in HOLDERS:
        root = elements[root].parent
    size = _sums(page, [(e, len(text)) for e, text in kept])
    while root > 0:
        outer = elements[root].parent
        while outer > 0 and elements[outer].tag not in HOLDERS:
            outer = elements[outer].parent
        if outer <= 0 or elements[outer].tag in ("html", "body") or size[outer] > (1 + WIDEN) * size[root]:
            break
        root = outer
    return root


def main_text(text: str) -> str:
    page = page_of(text)
    if not page.blocks:
        return ""
    chosen = content(page.blocks, page)
    kept = _kept(page, chosen)
    chosen = [good for good, own in zip(chosen, kept) if own]
    blocks = [block for block, own in zip(page.blocks, kept) if own]
    if not blocks:
        return ""
    root = _root(page, blocks, chosen)
    within = [False] * len(page.elements)
    for i in range(len(within)):
        within[i] = i == root or i > 0 and within[page.elements[i].parent]
    return "\n".join(block for e, block in blocks if within[e])


def main_texts(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """Per row of ``pages``: id, address, main ``text`` and its ``n_chars``."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 64):
                part = batch.slice(at, 64)
                texts = [main_text(t.as_py()) for t in part["_html"]]
                yield pa.record_batch([part["_id"], part["_url"], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["_id", "_url", "text", "n_chars"])

    rows = pages.select(F.col(id_column).cast("bigint").alias("_id"), F.col(url_column).cast("string").alias("_url"), F.coalesce(F.col(html_column), F.lit("")).alias("_html"))
    found = rows.mapInArrow(scan, "_id bigint, _url string, text string, n_chars bigint")
    return found.select(F.col("_id").alias(id_column), F.col("_url").alias(url_column), "text", "n_chars")
