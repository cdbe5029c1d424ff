"""Pages rewritten before they become text: one pass per page, from its HTML to drafts of its content and of its notes.

Rules mark nodes on the flat arrays of a batch of pages (``sources.sweep``): a subtree goes, a node gives way to what it
holds, a subtree becomes one ready piece of Markdown (``#unit`` stands alone, ``#inline`` stays in its line), a
subtree moves out as a note. Then the content and each note are written as drafts of Markdown (``page_writing``). Every rule asks for
counts and ancestors by prefix sums and running maxima, so the work is linear in the nodes.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from urllib.parse import unquote, urljoin

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from leafmill.operators.page_tables import MAX_SPAN, pipe_table
from leafmill.operators.pages import BACK_MATTER, WIKI_FURNITURE
from leafmill.operators.page_writing import marks
from leafmill.sources.pages import parsed
from leafmill.sources.sweep import Flat

LAYOUT_CELL_CHARS = 1000
MAX_NOTE_CHARS = 4000
# What a call to a note reads as, what a link back reads as, and what marks a link as a call.
NOTE_MARK = re.compile(r"^\[?\s*(?:note\s*)?(?:\d+|[a-z]{1,2}|[ivx]{1,5}|[*†‡§¶]{1,3})\s*\]?$", re.I)
BACKREF = re.compile(r"^[\s↩↑^⤴︎️]*$")
NOTE_NAMES = ("footnote", "noteref", "fnref", "note-ref")
NOTE_CONTAINERS = ("li", "aside", "p", "div", "dd", "section")
CELL_MARK = re.compile(r"^\[[\w\s]{1,10}\]$")
# White space and separators, as column expressions strip them.
BLANKS = " \t\n\x0b\f\r\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
INLINE_HOMES = ("p", "li", "td", "th", "h1", "h2", "h3", "h4", "h5", "h6", "a", "strong", "b", "em", "i", "u", "del", "sup", "sub")
TABLE_PARTS = ("table", "thead", "tbody", "tfoot", "tr")
DEAD = ("head", "script", "style", "template", "noscript")
CALLS = pa.list_(pa.struct([("no", pa.int32()), ("mark", pa.string()), ("n", pa.int32())]))
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")


class Rewrite:
    """Marks on the nodes of a batch of pages."""

    def __init__(self, flat: Flat, urls: list[str]):
        self.flat = flat
        self.urls = urls
        none = lambda: np.zeros(flat.n, bool)
        #: Subtrees that go; that go from the content but not from the notes in them; nodes that give way to what they hold.
        self.gone, self.out, self.open = none(), none(), none()
        #: Nodes that are one piece of text now, other tags and texts, and links made absolute.
        self.whole = none()
        #: The nodes whose marks are asked for: all, or those in notes and around them.
        self.asked = ~none()
        self.name: dict[int, str] = {}
        self.value: dict[int, str] = {}
        #: The notes: the node that holds each, by page in the order of their first calls.
        self.notes: dict[int, list[int]] = {}
        #: By page the calls of notes: node, mark and number of the note.
        self.calls: dict[int, list[tuple[int, str, int]]] = {}
        self.href = flat.attr("href")
        self.images = flat.tags("img", "graphic")

    def piece(self, node: int, md: str, inline: bool = False) -> None:
        self.whole[node] = True
        self.name[node], self.value[node] = "#inline" if inline else "#unit", md

    def left(self) -> np.ndarray:
        """The nodes that are in no subtree that goes."""
        return ~self.flat.inside(self.gone | self.out)


def lift_notes(work: Rewrite) -> None:
    """Note calls become ``[^fnN]``; the notes they call leave the content.

    A call is a short mark that links to an element of its page, raised or named as a note; its note is the
    nearest box around that element. A link back goes with its mark, and a list or box left with nothing but a heading goes too.
    """
    flat = work.flat
    if not any("#" in v for v in work.href.values()):
        return
    ids: dict[tuple[int, str], int] = {}
    own_id = flat.attr("id")
    for node, value in own_id.items():
        ids.setdefault((int(flat.page[node]), value), node)
    sup, box = flat.nearest(flat.tags("sup")), flat.nearest(flat.tags(*NOTE_CONTAINERS))
    classes, roles = flat.attr("class"), flat.attr("role")
    size = flat.below(flat.raw_size)
    calls, call_ids, written = [], set(), set()
    for a, href in work.href.items():
        page = int(flat.page[a])
        target = ids.get((page, unquote(href.partition("#")[2])))
        if target is None or target == a or flat.tag(a) != "a":
            continue
        text = flat.text_of(a)
        named = " ".join((classes.get(a, ""), roles.get(a, ""), own_id.get(a, ""))).lower()
        if not NOTE_MARK.match(text) or sup[a] == flat.n and not any(x in named for x in NOTE_NAMES):
            continue
        whole = int(sup[a]) if sup[a] < flat.n and flat.text_of(int(sup[a])) == text else a
        call_ids.update((page, own_id[x]) for x in (a, whole) if x in own_id)
        held = int(box[target])
        # A mark that leads to a call is the way back from its note.
        if held < flat.n and target not in written and not held <= a <= flat.last[held] and size[held] <= MAX_NOTE_CHARS:
            calls.append((page, whole, held, a, text))
            written.update(range(whole, int(flat.last[whole]) + 1))
    holders = np.zeros(flat.n, bool)
    holders[[held for _, _, held, _, _ in calls]] = True
    noted = flat.inside(holders)
    mark = flat.with_class("mw-cite-backlink", "footnote-number") & noted
    for a, href in work.href.items():
        if noted[a] and flat.tag(a) == "a":
            back = (int(flat.page[a]), unquote(href.partition("#")[2])) in call_ids
            named = classes.get(a, "").lower()
            mark[a] |= back or "backref" in named or "backlink" in named or bool(BACKREF.match(flat.text_of(a)))
    for i in flat.runs[noted[flat.runs]]:
        mark[i] |= ("↩" in flat.stripped[i] or "↑" in flat.stripped[i]) and bool(BACKREF.match(flat.text[i]))
    work.gone |= mark
    rest = ~flat.inside(mark)
    filled = flat.below((flat.size > 0) & rest) + flat.below(work.images & rest) > 0
    number: dict[int, int] = {}
    for page, whole, held, a, text in calls:
        if filled[held] and held not in number:
            work.notes.setdefault(page, []).append(held)
            number[held] = len(work.notes[page])
        separator = _before(flat, whole)
        if separator < flat.n and flat.tag(separator) == "sup" and re.match(r"^[\s,;.]+$", flat.text_of(separator)):
            work.gone[separator] = True
        if held in number:
            work.calls.setdefault(page, []).append((a - int(flat.ends[page]), text, number[held]))
            work.piece(whole, f"[^fn{number[held]}]", inline=True)
        else:
            work.gone[whole] = True
        work.out[held] = True
    _drop_emptied(work, [int(flat.parent[held]) for held in {c[2] for c in calls}])


def _before(flat: Flat, node: int) -> int:
    """The sibling element or text before a node, white space apart; ``n`` without one."""
    at = node - 1
    while at > flat.parent[node] or flat.parent[node] == flat.n and at >= 0 and flat.page[at] == flat.page[node]:
        while flat.parent[at] != flat.parent[node]:
            at = int(flat.parent[at])
        if flat.tag(at) != "#text" or flat.size[at]:
            return at
        at -= 1
    return flat.n


def _drop_emptied(work: Rewrite, parents: list[int]) -> None:
    """What held the notes and holds nothing but headings and rules now; the deepest first, each looked at once."""
    flat, heap = work.flat, [-p for p in set(parents) if p < work.flat.n]
    heapq.heapify(heap)
    seen = set()
    while heap:
        node = -heapq.heappop(heap)
        if node in seen or flat.tag(node) in ("body", "html", "article", "main"):
            continue
        seen.add(node)
        child = node + 1
        while child <= flat.last[node]:
            if not work.out[child] and not work.gone[child]:
                if flat.size[child] if flat.tag(child).startswith("#") else flat.tag(child) not in ("hr", *HEADINGS):
                    break
            child = int(flat.last[child]) + 1
        else:
            work.out[node] = True
            if flat.parent[node] < flat.n:
                heapq.heappush(heap, -int(flat.parent[node]))


def write_formulas(work: Rewrite) -> None:
    """A formula becomes its TeX source between dollars; one that stands beside a rendered image of it goes."""
    flat = work.flat
    if not flat.tags("math").any():
        return
    beside = np.append(flat.below(work.images), 0)[flat.parent] > 0
    notes, kinds = flat.tags("annotation"), flat.attr("encoding")
    source, alt, display = flat.attr("data-mw"), flat.attr("alttext"), flat.attr("display")
    block = flat.with_class("mwe-math-element-block")
    for node in np.flatnonzero(flat.tags("math") & work.asked).tolist():
        if beside[node]:
            work.gone[node] = True
            continue
        tex = ""
        try:
            tex = json.loads(source.get(node) or "{}")["body"]["extsrc"]
        except (ValueError, KeyError, TypeError):
            pass
        if not tex:
            note = flat.first_below(notes, node)
            tex = flat.raw_text(note) if note < flat.n and kinds.get(note) == "application/x-tex" else alt.get(node, "")
        tex = re.sub(r"\n\s*\n", "\n", str(tex).strip())
        dollars = "$$" if display.get(node) == "block" or block[node] else "$"
        if tex:
            work.piece(node, f"{dollars}{tex}{dollars}", inline=True)
        else:
            work.gone[node] = True


def drop_encyclopedia_furniture(work: Rewrite) -> None:
    """Marks, boxes and navigation of an encyclopedia page, and its appendix: the first top-level section with such a title and all beside it from there."""
    flat = work.flat
    work.gone |= flat.tags("style", "link", "script", "head")
    if not (flat.tags("table") & work.asked).any() and not work.asked.all():
        # Of notes alone: what leaves the content reaches them only through a table around them.
        return
    # Notes that were lifted out of a box of references stay.
    work.out |= flat.with_class(*WIKI_FURNITURE)
    work.out |= flat.tags("sup") & flat.with_class("mw-ref", "citation") & ~work.whole
    work.out |= flat.tags("table") & flat.with_class("collapsed", "mw-collapsed")
    section, heading = flat.tags("section"), flat.tags("div") & flat.with_class("mw-heading")
    left, ended = work.left(), set()
    for h in np.flatnonzero(flat.tags("h2") & left).tolist():
        holder = int(flat.parent[h])
        if holder < flat.n and heading[holder]:
            holder = int(flat.parent[holder])
        page = int(flat.page[h])
        if page in ended or holder == flat.n or not section[holder] or flat.text_of(h).lower() not in BACK_MATTER:
            continue
        ended.add(page)
        beside = (flat.page == page) & section & (flat.parent == flat.parent[holder]) & (flat.no >= holder)
        work.out |= beside


def drop_furniture(work: Rewrite) -> None:
    """Scripts and the like, and a site's own header, menus and footer: not in an article and not around one."""
    flat = work.flat
    articles = flat.tags("article", "main")
    work.gone |= flat.tags(*DEAD)
    work.out |= flat.tags("header", "nav", "footer") & ~flat.inside(articles) & (flat.below(articles) == 0)


def write_code(work: Rewrite) -> None:
    """Empty code goes; blocks inside a block are one; a block of one line inside a line is code in that line."""
    flat = work.flat
    pre, code = flat.tags("pre"), flat.tags("pre", "code")
    work.gone |= code & (flat.below(flat.size > 0) == 0)
    inner, outer = flat.below(pre), ~flat.inside(pre, itself=False)
    homes = flat.inside(flat.tags(*INLINE_HOMES), itself=False)
    for node in np.flatnonzero(pre & outer & work.asked & ~flat.inside(work.gone)).tolist():
        if inner[node]:
            blocks = node + 1 + np.flatnonzero(pre[node + 1 : flat.last[node] + 1])
            work.piece(node, "```\n" + "\n".join(flat.raw_text(int(i)) for i in blocks) + "\n```")
        elif homes[node] and "\n" not in flat.raw_text(node):
            work.piece(node, f"`{flat.raw_text(node)}`", inline=True)


def place_images(work: Rewrite) -> None:
    """A link around an image alone gives way to it; the caption of a figure with one image goes to that image."""
    flat = work.flat
    pictures = work.images | flat.tags("picture")
    work.open |= flat.tags("a") & (flat.below(pictures) > 0) & (flat.below(flat.size > 0) == 0) & ~work.whole
    figures = flat.tags("figure") | flat.with_class("wp-caption")
    captions = flat.tags("figcaption") | flat.with_class("wp-caption-text")
    count, used = flat.below(work.images), np.zeros(flat.n, bool)
    for figure in np.flatnonzero(figures & work.asked & (count == 1) & (flat.below(captions) > 0)).tolist():
        caption, image = flat.first_below(captions, figure), flat.first_below(work.images, figure)
        text = " ".join(flat.raw_text(caption).split())
        if text and not used[image] and not caption <= image <= flat.last[caption]:
            used[image] = True
            work.value[image] = text
            work.gone[caption] = True


def write_images(work: Rewrite, content: np.ndarray) -> None:
    """Images once each (whatever the scheme), without spacers, with absolute addresses."""
    flat = work.flat
    src, alt, width, height = (flat.attr(x) for x in ("src", "alt", "width", "height"))
    seen: set[tuple[int, str]] = set()
    for node in np.flatnonzero(work.images & content).tolist():
        url, page = src.get(node, "").strip(), int(flat.page[node])
        key = (page, re.sub(r"^https?:", "", url))
        caption = work.value.pop(node, None)
        if not url or key in seen or any(x.get(node, "").strip() in ("0", "1", "2") for x in (width, height)):
            work.gone[node] = True
            continue
        seen.add(key)
        url = url if url.startswith("data:") else urljoin(work.urls[page], url)
        words = caption if caption is not None else " ".join(alt.get(node, "").split())
        work.piece(node, f"![{words}]({url.replace('(', '%28').replace(')', '%29')})", inline=caption is None)


def write_tables(work: Rewrite) -> None:
    """Tables of data become pipe tables, those that lay out code become code, those that lay out a page give way to their cells."""
    flat = work.flat
    tables = flat.tags("table")
    if not (tables & work.asked).any():
        return
    cells, pre = flat.tags("td", "th", "cell"), flat.tags("pre")
    table_of, row_of = flat.nearest(tables), flat.nearest(flat.tags("tr"))
    shown, marked, images, paragraphs = (flat.below(x) for x in (flat.size > 0, pre, work.images & ~work.gone, flat.tags("p")))
    chars, nested = flat.below(flat.size), flat.below(tables)
    spans = [flat.attr("rowspan"), flat.attr("colspan")]
    big = cells & ((paragraphs > 1) | (chars > LAYOUT_CELL_CHARS))
    holds_big = flat.below(big)
    in_row = np.bincount(row_of[np.flatnonzero(cells)], minlength=flat.n + 1)
    wide = flat.below(flat.tags("tr") & (in_row[: flat.n] > 1))
    own_parts, captions = flat.tags(*TABLE_PARTS, "colgroup", "col"), flat.tags("caption")
    left = work.left()
    for table in np.flatnonzero(tables & left & work.asked).tolist():
        inside = slice(table, int(flat.last[table]) + 1)
        if work.whole[table]:
            continue
        if not shown[table] and not images[table]:
            work.gone[table] = True
        elif marked[table]:
            code = [flat.raw_text(i).rstrip("\n") for i in np.flatnonzero(pre[inside] & left[inside]) + table]
            code = [x for x in code if not re.fullmatch(r"[\s\d]*", x)]
            if code:
                work.piece(table, "```\n" + "\n".join(code) + "\n```")
            else:
                work.gone[table] = True
            work.whole[inside] |= tables[inside]
        elif holds_big[table] or nested[table] or not wide[table]:
            own = table_of[inside] == table
            work.open[inside] |= own & own_parts[inside]
            work.gone[inside] |= own & captions[inside]
            for cell in np.flatnonzero(own & cells[inside]) + table:
                work.name[int(cell)] = "div"
        else:
            rows: dict[int, list[dict]] = {int(r): [] for r in np.flatnonzero(flat.tags("tr")[inside]) + table}
            for cell in (np.flatnonzero(cells[inside] & left[inside]) + table).tolist():
                if row_of[cell] in rows:
                    rows[int(row_of[cell])].append({
                        "text": _cell_text(work, cell), "head": flat.tag(cell) == "th",
                        "rows": _span(spans[0].get(cell)), "cols": _span(spans[1].get(cell)),
                    })
            caption = flat.first_below(captions, table)
            work.piece(table, pipe_table(list(rows.values()), flat.text_of(caption) if caption < flat.n else None))


def _span(value: str | None) -> int:
    value = (value or "1").strip()
    return min(max(int(value[:12]), 1), MAX_SPAN) if re.fullmatch(r"[0-9]+", value) else 1


def _cell_text(work: Rewrite, cell: int) -> str:
    """The text of a cell on one line, with note calls and formulas, without other marks in brackets."""
    flat, out, at = work.flat, [], cell + 1
    while at <= flat.last[cell]:
        if work.gone[at] or work.out[at] or flat.tag(at) == "sup" and not work.whole[at] and CELL_MARK.match(flat.text_of(at)):
            at = int(flat.last[at])
        elif work.whole[at]:
            out += [work.value[at]] if work.name.get(at) == "#inline" else []
            at = int(flat.last[at])
        elif flat.size[at]:
            out.append(flat.stripped[at])
        at += 1
    return " ".join(out)


def main_content(flat: Flat, encyclopedia: bool) -> np.ndarray:
    """Marks the nodes of each page's content: the article or main element with most text, else the body, else all."""
    out = np.zeros(flat.n, bool)
    size = flat.below(flat.size + (flat.size > 0)) if flat.n else flat.size
    best: dict[int, int] = {}
    if not encyclopedia:
        for node in np.flatnonzero(flat.tags("article", "main")).tolist():
            page = int(flat.page[node])
            if page not in best or size[node] > size[best[page]]:
                best[page] = node
    for node in np.flatnonzero(flat.tags("body")).tolist():
        best.setdefault(int(flat.page[node]), node)
    for page, (low, high) in enumerate(zip(flat.ends[:-1], flat.ends[1:])):
        node = best.get(page)
        out[low if node is None else node : high if node is None else flat.last[node] + 1] = True
    return out


def rewritten(flat: Flat, urls: list[str], encyclopedia: bool, notes_only: bool = False) -> tuple[pa.Array, pa.ListArray, pa.ListArray]:
    """For each page the draft of its content, its notes as ``(n, said, draft)`` and the calls of notes as ``(no, mark, n)``.

    ``notes_only``: no content is written, and what neither lies in a note nor holds one is not rewritten.
    """
    work = Rewrite(flat, urls)
    lift_notes(work)
    noted = np.zeros(flat.n, bool)
    held = [node for nodes in work.notes.values() for node in nodes]
    noted[held] = True
    if notes_only:
        work.asked = flat.below(noted) > 0
    noted = flat.inside(noted)
    work.asked |= noted
    write_formulas(work)
    (drop_encyclopedia_furniture if encyclopedia else drop_furniture)(work)
    write_code(work)
    place_images(work)
    content = main_content(flat, encyclopedia)
    # An image is written where it stands first, be that in a note or not.
    if (work.images & work.asked).any():
        write_images(work, (content & work.left()) | (noted & ~flat.inside(work.gone)))
    write_tables(work)
    if encyclopedia:
        for node, href in work.href.items():
            if work.asked[node]:
                work.href[node] = urljoin(urls[int(flat.page[node])], href)
    for node in held:
        if flat.tag(node) in ("li", "dd", "section", "aside"):
            work.name[node] = "div"
    alive = ~flat.inside(work.gone) & ~flat.inside(work.whole, itself=False) & ~work.open
    body, notes = content & alive & ~flat.inside(work.out) & (not notes_only), noted & alive
    classes, shown = flat.attr("class"), flat.tags("span")

    def tag(node: int) -> str:
        return work.name.get(node) or flat.tag(node)

    def mark(node: int, name: str, path: str) -> tuple[str, str]:
        return marks(name, path, work.value.get(node, flat.text[node]), flat.item[node], work.href.get(node), classes.get(node) if shown[node] else None)

    def said(own: np.ndarray) -> str:
        runs = [work.value.get(i, flat.text[i]).strip(BLANKS) for i in own.tolist() if tag(i) == "#text"]
        return " ".join(x for x in runs if x)

    drafts = [None] * len(urls) if notes_only else flat.written([np.flatnonzero(body[a:b]) + a for a, b in zip(flat.ends[:-1], flat.ends[1:])], body, tag, mark)
    numbered = [(i + 1, node) for page in range(len(urls)) for i, node in enumerate(work.notes.get(page, []))]
    groups = [np.flatnonzero(notes[node : flat.last[node] + 1]) + node for _, node in numbered]
    ends = np.concatenate(([0], np.cumsum([len(work.notes.get(page, [])) for page in range(len(urls))])))
    rows = pa.StructArray.from_arrays([
        pa.array([i for i, _ in numbered], pa.int32()), pa.array([said(own) for own in groups], pa.string()),
        pa.array(flat.written(groups, notes, tag, mark), pa.string()),
    ], ["n", "said", "draft"])
    called = [work.calls.get(page, []) for page in range(len(urls))]
    calls = pa.array([[{"no": no, "mark": mark, "n": n} for no, mark, n in own] for own in called], CALLS)
    return pa.array(drafts, pa.string()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows), calls


def article_texts(flat: Flat) -> pa.Array:
    """The text runs of each page outside an encyclopedia page's furniture, its appendix and its head, joined by spaces."""
    away = named(flat, WIKI_FURNITURE) | flat.tags("style", "link", "math", "script", "head")
    away |= flat.tags("sup") & named(flat, ("mw-ref", "citation"))
    away |= flat.tags("table") & named(flat, ("collapsed", "mw-collapsed"))
    text = {i: flat.text[i].strip(BLANKS) for i in np.flatnonzero(flat.raw_size).tolist()}
    shown = np.array([i for i, t in text.items() if t], np.int64)
    section, heading = flat.tags("section"), named(flat, ("mw-heading",))
    first: dict[int, int] = {}
    for h in np.flatnonzero(flat.tags("h2")).tolist():
        up = int(flat.parent[h])
        # A heading's box counts as the heading: the section may be its own parent or that box's.
        holders = [x for x in (up, int(flat.parent[up]) if up < flat.n and heading[up] else flat.n) if x < flat.n and section[x]]
        low, high = np.searchsorted(shown, (h, flat.last[h] + 1))
        if holders and " ".join(text[i] for i in shown[low:high].tolist()).lower() in BACK_MATTER:
            page = int(flat.page[h])
            first[page] = min([first.get(page, flat.n), *holders])
    for page, node in first.items():
        own = slice(node, int(flat.ends[page + 1]))
        away[own] |= section[own] & (flat.parent[own] == flat.parent[node])
    kept = shown[~flat.inside(away)[shown]]
    bounds = np.searchsorted(kept, flat.ends)
    return pa.array([" ".join(text[i] for i in kept[a:b].tolist()) for a, b in zip(bounds[:-1], bounds[1:])], pa.string())


def named(flat: Flat, names: tuple[str, ...]) -> np.ndarray:
    """The nodes with one of some classes, which white space of ASCII alone sets apart."""
    out, wanted = np.zeros(flat.n, bool), re.compile(rf"(?a:(?:^|\s)(?:{'|'.join(names)})(?:\s|$))")
    out[[node for node, value in flat.attr("class").items() if wanted.search(value)]] = True
    return out


def encyclopedia_text(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """``pages(key, url, html)`` to (key, text): the article's own text, without furniture and back matter."""
    kind = dict(pages.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, read in parsed(batches):
            yield pa.RecordBatch.from_arrays([part.column(0), article_texts(Flat.of(read))], [key, "text"])

    return pages.select(key, "url", "html").mapInArrow(run, f"{key} {kind}, text STRING")


def cleaned_pages(pages: DataFrame, key: str = "page_id", encyclopedia: bool = False, notes_only: bool = False) -> DataFrame:
    """``pages(key, url, html)`` to (key, url, draft, notes, calls): the draft of each page's content, its notes and what calls them.

    ``encyclopedia``: the page is an encyclopedia's; its whole body is content up to the appendix, and its links are made absolute.
    ``notes_only``: no draft of the content is asked for, it is null.
    """
    kind = dict(pages.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, read in parsed(batches):
            columns = rewritten(Flat.of(read), [u or "" for u in part.column(1).to_pylist()], encyclopedia, notes_only)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *columns], [key, "url", "draft", "notes", "calls"])

    return pages.select(key, "url", "html").mapInArrow(run, f"{key} {kind}, url STRING, draft STRING, notes ARRAY<STRUCT<n: INT, said: STRING, draft: STRING>>, calls ARRAY<STRUCT<no: INT, mark: STRING, n: INT>>")
