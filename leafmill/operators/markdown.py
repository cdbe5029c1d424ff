"""Markdown documents, one per row. Everything that stays inside a document is done inside its row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions.text import blank, col, let, rstrip, strip
from leafmill.operators.ordered import salted_left_join
from leafmill.shared import settle

FENCE_LINE = r"(?m)^[^\S\n]*```[^\n]*$"
HEADING_LEVEL = r"(?m)^(#{1,6})[^\S\n]"
HEADING = r"^(#{1,6})(\s.*)$"
LONE_LINK = r"\[([^\]]+)\]\([^)]+\)"
PREVIEW_CHARS = 8000
IMAGE = r"""!\[((?:[^\[\]]|\[[^\[\]]*\])*)\]\(\s*(\S+?)(\s+"[^"]*")?\s*\)"""
FIGURE = r"^!\[((?:[^\[\]]|\[[^\[\]]*\])*)\]\((\S+?)\)$"
# Inline marks in the order in which they are tried at a position.
INLINE = (
    r"(\[\^[^\]\s]+\]|\*\*[^*]+\*\*|\*(?=\S)[^*]*?\S\*|\[[^\]]+\]\([^)\s]+(?:\s+\"[^\"]*\")?\)|`[^`]+`|\\[!-/:-@\[-`{-~]"
    r"|<sup>.*?</sup>|<sub>.*?</sub>|\$\$[\s\S]+?\$\$|\$(?=\S)[^$\n]*?\S\$(?!\d))"
)


def demote_headings(markdown: Column | str, floor: int = 2) -> Column:
    """Headings shifted down so that the shallowest outside code fences is ``floor``; never promoted."""
    markdown = col(markdown)

    def shifted(parts: Column) -> Column:
        outside = F.filter(parts, lambda p, i: i % 2 == 0)
        levels = F.transform(
            F.flatten(F.transform(outside, lambda p: F.regexp_extract_all(p, F.lit(HEADING_LEVEL), 1))), lambda h: F.length(h)
        )
        shift = F.lit(floor) - F.array_min(levels)

        def demoted(part: Column) -> Column:
            # Deepest first, so that no heading is shifted twice.
            for level in range(6, 0, -1):
                marks = F.repeat(F.lit("#"), F.least(F.lit(6), shift + level))
                part = F.regexp_replace(part, F.lit(rf"(?m)^#{{{level}}}(?=[^\S\n])"), marks)
            return part

        fences = F.regexp_extract_all(markdown, F.lit(f"({FENCE_LINE})"), 1)
        changed = F.transform(parts, lambda p, i: F.when(i % 2 == 0, demoted(p)).otherwise(p))
        whole = F.array_join(F.zip_with(changed, fences, lambda p, f: F.concat(p, F.coalesce(f, F.lit("")))), "")
        return F.when(F.coalesce(shift, F.lit(0)) <= 0, markdown).otherwise(whole)

    return let(F.split(markdown, FENCE_LINE, -1), shifted)


def plain_title(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def strip_leading_title(markdown: Column | str, title: Column | str) -> Column:
    """Drop a first heading that repeats the title, with the breadcrumb links above it."""
    markdown, wanted = col(markdown), plain_title(col(title))

    def cut(lines: Column) -> Column:
        def at(i: Column) -> Column:
            line = F.get(lines, i - 1)
            heading = plain_title(F.regexp_replace(F.regexp_extract(line, HEADING, 2), LONE_LINK, "$1"))
            same = (heading == wanted) | heading.startswith(wanted) | wanted.startswith(heading)
            above = F.filter(F.slice(lines, F.lit(1), i - 1), lambda x: ~strip(x).rlike(f"^{LONE_LINK}$"))
            tidy = let(above, lambda a: F.filter(a, lambda x, k: ~(blank(x) & (k > 0) & blank(F.get(a, k - 1)))))
            skip = F.when(blank(F.coalesce(F.get(lines, i), F.lit("x"))), 2).otherwise(1)
            below = F.slice(lines, i + skip, F.size(lines))
            return F.when((i > 0) & same, F.array_join(F.concat(tidy, below), "\n")).otherwise(markdown)

        first = F.array_position(F.transform(lines, lambda x: x.rlike(HEADING)), True).cast("int")
        return let(first, lambda i: F.when(i > 0, at(F.greatest(i, F.lit(1)))).otherwise(markdown))

    return F.regexp_replace(let(F.split(markdown, "\n"), cut), r"^\n+", "")


def preview(markdown: Column | str, limit: int = PREVIEW_CHARS) -> tuple[Column, Column]:
    """The opening of a text, and whether it was cut."""
    markdown = col(markdown)
    truncated = F.length(markdown) > limit
    return F.when(truncated, F.concat(rstrip(F.left(markdown, F.lit(limit))), F.lit("…"))).otherwise(markdown), truncated


def heading_title(text: Column) -> Column:
    return strip(F.regexp_replace(text, r"\s*\{([^{}]*)\}\s*$", ""))


def heading_attributes(text: Column) -> Column:
    return F.regexp_extract(text, r"\s*\{([^{}]*)\}\s*$", 1)


def _h1_sections(books: DataFrame, pattern: str, keep: str) -> DataFrame:
    parts = books.select(keep, F.posexplode(F.split(F.concat(F.lit("\n"), "md"), pattern)).alias("section", "_part"))
    lines = parts.filter("section > 0").withColumn("_head", F.regexp_extract("_part", r"^([^\n]*)", 1))
    return lines.withColumn("_rest", F.regexp_replace("_part", r"^[^\n]*\n?", ""))


def split_chapters(books: DataFrame, key: str = "book_id") -> DataFrame:
    """Chapters of compiled books: H1 sections without front matter; the last of equal titles counts."""
    sections = _h1_sections(books, r"\n# ", key).withColumns(
        {"title": heading_title(F.col("_head")), "_attrs": heading_attributes(F.col("_head"))}
    )
    chapters = sections.filter(~F.col("_attrs").contains(".front-matter")).groupBy(key, "title").agg(
        F.max_by(strip("_rest"), "section").alias("body")
    )
    return chapters.filter(~F.col("title").isin("Sources", "Preface"))


def split_reader_chapters(books: DataFrame, key: str = "book_id") -> DataFrame:
    """Chapters as a reader shows them: attribution blocks dropped, the source link read from them."""
    fence = r"(?m)^[^\S\n]*:::[^\n]*$"
    unix = F.regexp_replace(F.concat(F.lit("\n"), "md"), r"\r\n?", "\n")
    parts = books.select(key, F.split(unix, r"\n#[^\S\n]+").alias("_parts"))
    # A block left open reaches into the next chapter: fences are counted over the whole book.
    fences = F.transform("_parts", lambda p: F.size(F.split(F.regexp_replace(p, r"^[^\n]*\n?", ""), fence, -1)) - 1)
    before = F.aggregate(fences, F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))
    rows = parts.select(key, F.posexplode(F.arrays_zip(F.col("_parts").alias("part"), before.alias("open"))).alias("section", "_s")).filter(
        (F.col("section") > 0) & F.col("_s.part").isNotNull()
    )
    sections = rows.withColumns({
        "_head": F.regexp_extract("_s.part", r"^([^\n]*)", 1),
        "_pieces": F.split(F.regexp_replace("_s.part", r"^[^\n]*\n?", ""), fence, -1), "_open": F.col("_s.open"),
    })
    lines = lambda want: F.filter("_pieces", lambda p, i: (i + F.col("_open")) % 2 == want)
    text = F.array_join(F.transform(lines(0), lambda p, i: F.when(i > 0, F.regexp_replace(p, r"^\n", "")).otherwise(p)), "")
    source = F.regexp_extract(F.array_join(lines(1), "\n"), r"\]\((https?://[^)\s]+)\)", 1)
    attributed = F.col("_head").rlike(r"\{[^{}]*\}\s*$")
    title = heading_title(F.col("_head"))
    front = heading_attributes(F.col("_head")).contains(".front-matter") | (~attributed & title.isin("Sources", "Preface"))
    return sections.filter(~front).select(
        key, "section", title.alias("title"), strip(text).alias("body"), F.nullif(source, F.lit("")).alias("source")
    )


CHUNK = "STRUCT<first: INT, kind: STRING>"


def _chunk_starts(lines: Column) -> Column:
    """Where each chunk of lines starts: a fenced block whole, a heading alone, else up to a blank line."""
    state = F.struct(
        F.array().cast(f"ARRAY<{CHUNK}>").alias("starts"), F.lit("").alias("mode"), F.lit(0).alias("at")
    )

    def step(acc: Column, line: Column) -> Column:
        fence = F.regexp_extract(line, r"^\s*(```|~~~)", 1)
        in_code, in_text = acc["mode"].isin("```", "~~~"), acc["mode"] == "text"
        empty, heading = blank(line), line.rlike(r"^#{1,6}\s+")
        kind = (
            F.when(in_code, "").when(~in_text & (fence != ""), "code").when(empty, "")
            .when(heading, "heading").when(in_text, "").otherwise("text")
        )
        mode = (
            F.when(in_code, F.when(F.trim(line).startswith(acc["mode"]), "").otherwise(acc["mode"]))
            .when(~in_text & (fence != ""), fence).when(empty | heading, "").otherwise("text")
        )
        start = F.struct(acc["at"].alias("first"), kind.alias("kind"))
        starts = F.when(kind == "", acc["starts"]).otherwise(F.concat(acc["starts"], F.array(start)))
        return F.struct(starts.alias("starts"), mode.alias("mode"), (acc["at"] + 1).alias("at"))

    return F.aggregate(lines, state, step, lambda acc: acc["starts"])


INDENTED = r"^ {2,}\S"
# Markdown's list markers, and its form of a footnote definition.
MARKER = r"^([-*]|\d+\.)\s+(.*)$"
NOTE = r"^\[\^([^\]\s]+)\]:\s*(.*)$"


def _all(lines: Column, test) -> Column:
    return F.forall(lines, test)


def _classify(kind: Column, lines: Column) -> Column:
    """(kind, level, text, items) of one chunk."""
    first = F.get(lines, F.lit(0))
    table = (F.size(lines) > 1) & _all(lines, lambda x: x.startswith("|")) & F.get(lines, F.lit(1)).rlike(r"^\|[\s|:-]+$")
    listed = _all(lines, lambda x: x.rlike(MARKER) | x.rlike(INDENTED))
    figure = (F.size(lines) == 1) & F.trim(first).rlike(FIGURE)
    markers = F.size(F.filter(lines, lambda x: x.rlike(MARKER))).cast("int")
    closed = (F.size(lines) > 1) & F.element_at(lines, -1).rlike(r"^\s*(```|~~~)")
    code = F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1 - closed.cast("int"), F.lit(0)))
    name = (
        F.when(kind == "code", "code").when(kind == "heading", "heading")
        .when(_all(lines, lambda x: x.startswith(">")), "quote").when(first.rlike(NOTE), "note").when(figure, "figure")
        .when(table, "table").when(listed & first.rlike(r"^\d"), "ordered").when(listed, "bullets").otherwise("paragraph")
    )

    def shaped(n: Column) -> Column:
        text = (
            F.when(n == "code", F.array_join(code, "\n"))
            .when(n == "heading", F.regexp_extract(first, r"^#{1,6}\s+(.*)$", 1))
            .when(n == "quote", F.array_join(F.transform(lines, lambda x: F.regexp_replace(x, "^> ?", "")), "\n"))
            .when(n == "note", F.concat(F.regexp_extract(first, NOTE, 1), F.lit("\n"), F.regexp_extract(first, NOTE, 2)))
            .when(n == "figure", F.regexp_extract(F.trim(first), FIGURE, 1))
            .when(n == "paragraph", F.array_join(lines, " ")).otherwise(F.array_join(lines, "\n"))
        )
        level = F.when(n == "heading", F.length(F.regexp_extract(first, "^(#{1,6})", 1))).otherwise(0)
        items = F.when(n.isin("ordered", "bullets"), markers).when(n == "table", F.size(lines) - 2).otherwise(0)
        return F.struct(n.alias("kind"), level.cast("int").alias("level"), text.alias("text"), items.cast("int").alias("items"))

    return let(name, shaped)


def markdown_blocks(docs: DataFrame, key: str) -> DataFrame:
    """Documents as typed blocks (block_no, kind, level, text, items).

    Indented chunks after a note or a list belong to it, and a list right after one of its kind goes on.
    """
    lines = docs.select(key, F.split(F.regexp_replace("md", r"\r\n?", "\n"), "\n").alias("_lines"))
    started = lines.withColumn("_starts", _chunk_starts(F.col("_lines")))

    def chunk(start: Column, i: Column) -> Column:
        until = F.coalesce(F.get(F.col("_starts"), i + 1)["first"], F.size("_lines"))
        body = F.slice("_lines", start["first"] + 1, F.greatest(until - start["first"], F.lit(1)))
        kept = F.when(start["kind"] == "code", _trim_blank_tail(body)).otherwise(F.filter(body, lambda x: ~blank(x)))
        return F.struct(start["kind"].alias("kind"), kept.alias("lines"))

    chunked = started.withColumn("_chunks", F.transform("_starts", chunk))
    block = "STRUCT<kind: STRING, level: INT, text: STRING, items: INT>"
    empty = F.array().cast(f"ARRAY<{block}>")

    def fold(acc: Column, c: Column) -> Column:
        last = F.element_at(acc, F.when(F.size(acc) > 0, -1))
        in_list = F.coalesce(last["kind"].isin("ordered", "bullets"), F.lit(False))
        text_chunk = c["kind"] == "text"
        flags = F.transform(c["lines"], lambda x: x.rlike(INDENTED))
        lead = F.when(F.array_position(flags, False) == 0, F.size(flags)).otherwise(F.array_position(flags, False).cast("int") - 1)
        absorbed = text_chunk & (lead == F.size(flags)) & (in_list | F.coalesce(last["kind"] == "note", F.lit(False)))
        rest = F.when(in_list & text_chunk, F.slice(c["lines"], lead + 1, F.size(c["lines"]))).otherwise(c["lines"])

        def appended(b: Column) -> Column:
            merged = F.struct(
                last["kind"].alias("kind"), last["level"].alias("level"),
                F.concat(last["text"], F.lit("\n"), b["text"]).alias("text"), (last["items"] + b["items"]).alias("items"),
            )
            goes_on = in_list & (b["kind"] == last["kind"])
            return F.when(goes_on, F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(merged))).otherwise(
                F.concat(acc, F.array(b))
            )

        return F.when(absorbed, acc).otherwise(let(_classify(c["kind"], rest), appended))

    folded = chunked.select(key, F.posexplode(F.aggregate("_chunks", empty, fold)).alias("block_no", "_b"))
    return folded.select(key, "block_no", "_b.*")


def _trim_blank_tail(lines: Column) -> Column:
    """A code chunk ends at its closing fence; blank lines up to the next chunk are not its own."""
    closing = F.array_position(
        F.transform(lines, lambda x, i: (i > 0) & F.trim(x).startswith(F.regexp_extract(F.get(lines, F.lit(0)), r"^\s*(```|~~~)", 1))), True
    ).cast("int")
    return F.when(closing > 0, F.slice(lines, F.lit(1), F.greatest(closing, F.lit(1)))).otherwise(lines)


def inline_inventory(docs: DataFrame, key: str) -> DataFrame:
    """Counts of inline marks per document, and its link and image targets."""
    images = F.regexp_extract_all("md", F.lit(f"({IMAGE})"), 1)
    bare = F.regexp_replace("md", IMAGE, "")
    marks = docs.select(key, images.alias("_images"), F.regexp_extract_all(bare, F.lit(INLINE), 1).alias("_marks"))

    def count(pattern: str) -> Column:
        return F.size(F.filter("_marks", lambda m: m.rlike(pattern)))

    links = F.filter("_marks", lambda m: m.rlike(r"^\[[^^]"))
    return marks.select(
        key, F.size("_images").alias("images"), F.size(links).alias("links"), count(r"^\[\^").alias("note_calls"),
        count("^`").alias("code"), count(r"^\$").alias("math"), count("^<su[pb]>").alias("raised"),
        count(r"^\*\*").alias("strong"), count(r"^\*[^*]").alias("emphasis"),
        F.array_join(F.transform(links, lambda m: F.regexp_extract(m, r"\]\(([^)\s]+)", 1)), " ").alias("link_targets"),
        F.array_join(F.transform("_images", lambda m: F.regexp_extract(m, IMAGE, 2)), " ").alias("image_targets"),
    )


def localize_images(docs: DataFrame, manifest: DataFrame, key: str) -> DataFrame:
    """Remote image references rewritten to stored files; references without one are removed.

    Documents without a remote image never reach the join. A picture used everywhere is one hot join
    key: references to such pictures alone are salted, and their manifest rows follow.
    """
    refs = docs.select(
        key, F.posexplode(F.regexp_extract_all("md", F.lit(f"({IMAGE})"), 1)).alias("_pos", "_ref")
    ).withColumn("url", F.regexp_extract("_ref", IMAGE, 2)).filter(F.col("url").rlike("(?i)^https?://"))
    found = salted_left_join(settle(refs, "image-refs"), manifest.select("url", "path"), "url")
    text = F.when(F.col("path").isNull(), "").otherwise(
        F.concat(F.lit("!["), F.regexp_extract("_ref", IMAGE, 1), F.lit("]("), "path", F.regexp_extract("_ref", IMAGE, 3), F.lit(")"))
    )
    # One entry per picture of one document.
    per_doc = found.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("_pos", text))).alias("_new"))
    joined = docs.join(per_doc, key, "left")
    pieces = F.split("md", IMAGE, -1)
    olds = F.regexp_extract_all("md", F.lit(f"({IMAGE})"), 1)
    news = F.transform(olds, lambda old, i: F.coalesce(F.col("_new")[i], old))
    rebuilt = F.array_join(F.zip_with(pieces, news, lambda p, n: F.concat(p, F.coalesce(n, F.lit("")))), "")
    return joined.select(key, F.when(F.col("_new").isNull(), F.col("md")).otherwise(rebuilt).alias("md"))
