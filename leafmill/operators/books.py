"""Chapters to books. A book stays a table of ordered parts: no book is ever one value in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions import urls
from leafmill.functions.text import blank, col, collapse, escape_tags, null_if_empty, strip
from leafmill.operators.language import chrome, dominant_language
from leafmill.operators.ordered import block_of, number_rows, settle

BOOK_LABEL = r"\[\^fn(\d+)\]"
NOTE_TOKEN = r"⟦fn(\d+)⟧"
FIRST_DEFINITION = r"(?m)^\[\^fn\d+\]:"
TITLE_MAX = 100
NO_CONTENT = "The selected items had no usable content."


def usable_chapters(chapters: DataFrame) -> DataFrame:
    """Chapters with text, numbered from 1 in their book."""
    kept = chapters.filter(F.col("content_md").isNotNull() & ~blank("content_md"))
    return number_rows(kept, ["book_id"], [block_of("chapter_no")], [F.col("chapter_no")], "number")


def book_headers(chapters: DataFrame) -> DataFrame:
    """One row per book: its language, its chapter count, or why it cannot be built."""
    kept = chapters.filter(F.col("content_md").isNotNull() & ~blank("content_md"))
    counts = chapters.groupBy("book_id").agg(
        F.count_if(F.col("content_md").isNotNull() & ~blank("content_md")).alias("chapters")
    )
    joined = counts.join(dominant_language(kept), "book_id", "left")
    return joined.withColumn("error", F.when(F.col("chapters") == 0, NO_CONTENT))


def number_footnotes(markdown: Column | str, chapter: Column | str) -> Column:
    """Footnote labels made a chapter's own."""
    return F.regexp_replace(col(markdown), F.lit(BOOK_LABEL), F.concat(F.lit("[^c"), col(chapter).cast("string"), F.lit("fn$1]")))


def write_footnotes(markdown: Column | str, notes: Column) -> Column:
    """Tokens become calls, followed by the called notes in call order. ``notes`` maps number to Markdown."""
    markdown = col(markdown)
    numbers = F.transform(F.regexp_extract_all(markdown, F.lit(NOTE_TOKEN), 1), lambda n: n.cast("int"))
    calls = F.transform(numbers, lambda n: F.when(notes[n].isNotNull(), F.concat(F.lit("[^fn"), n, F.lit("]"))).otherwise(""))
    pieces = F.split(markdown, NOTE_TOKEN, -1)
    body = F.array_join(F.zip_with(pieces, calls, lambda p, c: F.concat(p, F.coalesce(c, F.lit("")))), "")
    called = F.array_distinct(F.filter(numbers, lambda n: notes[n].isNotNull()))

    def definition(n: Column) -> Column:
        lines = F.split(strip(notes[n]), "\n")
        indented = F.transform(
            lines, lambda line, i: F.when(i == 0, line).when(blank(line), "").otherwise(F.concat(F.lit("    "), line))
        )
        return F.concat(F.lit("[^fn"), n, F.lit("]: "), F.array_join(indented, "\n"))

    tail = F.array_join(F.transform(called, definition), "\n\n")
    text = F.regexp_replace(body, r"[\s\p{Z}]+$", "")
    return F.when(F.size(called) == 0, text).otherwise(F.concat(text, F.lit("\n\n"), tail))


def split_definitions(markdown: Column | str) -> tuple[Column, Column]:
    """The text, and the notes set after it."""
    markdown = col(markdown)
    at = F.regexp_instr(markdown, F.lit(FIRST_DEFINITION))
    text = F.when(at == 0, markdown).otherwise(F.regexp_replace(F.substr(markdown, F.lit(1), at - 1), r"[\s\p{Z}]+$", ""))
    return text, F.when(at == 0, "").otherwise(strip(F.substr(markdown, at)))


def book_parts(chapters: DataFrame, prefaces: DataFrame) -> DataFrame:
    """A book as ordered parts (book_id, section, number, text); joined by newlines they are its Markdown.

    Sections: 0 the index heading, 1 one index line per chapter, 2 the blank after it, 3 the preface,
    4 the chapters.
    """
    kept = chapters.filter(F.col("content_md").isNotNull() & ~blank("content_md"))
    # Texts are read twice: once to measure them here, once to write them below.
    slim = settle(kept.select("book_id", "chapter_no", "title", "source_url", "language", F.length("content_md").alias("_size")))
    books = settle(dominant_language(slim, F.col("_size")).withColumnRenamed("language", "book_language"))
    numbers = number_rows(slim, ["book_id"], [block_of("chapter_no")], [F.col("chapter_no")], "number")
    rows = kept.join(numbers.select("book_id", "chapter_no", "number"), ["book_id", "chapter_no"]).join(books, "book_id")
    zero = F.lit(0).cast("bigint")

    def front(label: str) -> Column:
        return F.concat(F.lit("# "), chrome("book_language", label), F.lit(" {.front-matter}\n"))

    head = books.select("book_id", F.lit(0).alias("section"), zero.alias("number"), front("sources").alias("text"))
    index = numbers.select(
        "book_id", F.lit(1).alias("section"), "number",
        F.concat(F.lit("- ["), escape_tags("title"), F.lit("]("), "source_url", F.lit(")")).alias("text"),
    )
    gap = books.select("book_id", F.lit(2).alias("section"), zero.alias("number"), F.lit("").alias("text"))
    opened = books.join(prefaces.filter(~blank("preface")), "book_id").select(
        "book_id", F.lit(3).alias("section"), zero.alias("number"),
        F.concat(front("preface"), F.lit("\n"), strip("preface"), F.lit("\n")).alias("text"),
    )
    lang = F.when(null_if_empty("language").isNotNull(), F.concat(F.lit(" {lang="), "language", F.lit("}"))).otherwise("")
    link = F.concat(F.lit("*"), chrome("book_language", "source"), F.lit(": ["), "source_url", F.lit("]("), "source_url", F.lit(")*"))
    author = F.when(null_if_empty("author").isNotNull(),
                    F.concat(F.lit("*"), chrome("book_language", "author"), F.lit(": "), escape_tags("author"), F.lit("*")))
    date = F.when(F.col("published").isNotNull(),
                  F.concat(F.lit("*"), chrome("book_language", "date"), F.lit(": "), "published", F.lit("*")))
    voice = F.when(F.col("language") != F.col("book_language"), F.concat(F.lit(" lang="), "book_language"))
    text = F.concat(
        F.lit("# "), escape_tags("title"), lang, F.lit("\n::: {.source-attribution"), F.coalesce(voice, F.lit("")), F.lit("}\n"),
        F.concat_ws(" | ", link, author, date), F.lit("\n:::\n\n"), number_footnotes("content_md", "number"), F.lit("\n"),
    )
    body = rows.select("book_id", F.lit(4).alias("section"), "number", text.alias("text"))
    return head.unionByName(index).unionByName(gap).unionByName(opened).unionByName(body)


BUCKETS = 256


def write_books(parts: DataFrame, path: str) -> None:
    """Books as JSON lines (book_id, section, number, text) in reading order, in ``BUCKETS`` folders by a hash of the book.

    A long book spreads over several files; its order is in the rows.
    """
    order = ["bucket", "book_id", "section", "number"]
    bucketed = parts.withColumn("bucket", F.pmod(F.xxhash64("book_id"), F.lit(BUCKETS)))
    bucketed.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").partitionBy("bucket").json(path)


def single_origin_books(chapters: DataFrame) -> DataFrame:
    """Books whose pages are all of one site, or whose videos are all of one channel; episodes do not count."""
    page, video = F.col("source_type") == "blog", F.col("source_type") == "youtube"
    site, channel = F.when(page, urls.netloc("source_url")), F.when(video, null_if_empty("channel_url"))
    books = chapters.groupBy("book_id").agg(
        F.count_if(page).alias("pages"), F.count_if(video).alias("videos"), F.min(site).alias("_s0"), F.max(site).alias("_s1"),
        F.min(channel).alias("_c0"), F.max(channel).alias("_c1"), F.min_by("source_url", F.when(page, F.col("chapter_no"))).alias("_first"),
    )
    one_site = (F.col("pages") > 0) & (F.col("videos") == 0) & (F.col("_s0") == F.col("_s1"))
    one_channel = (F.col("videos") > 0) & (F.col("pages") == 0) & (F.col("_c0") == F.col("_c1"))
    return books.filter(one_site | one_channel).select(
        "book_id", F.when(one_site, "site").otherwise("channel").alias("kind"),
        F.when(one_site, F.col("_first")).otherwise(F.col("_c0")).alias("origin"),
    )


def credited_authors(chapters: DataFrame) -> DataFrame:
    """Distinct authors of a book in order of first appearance, one row each."""
    named = chapters.withColumn("author", strip("author")).filter("author <> ''")
    firsts = named.groupBy("book_id", "author").agg(F.min("chapter_no").alias("_first"))
    return number_rows(firsts, ["book_id"], [block_of("_first")], [F.col("_first"), F.col("author")], "rank").drop("_first")


def typed_authors(line: Column | str) -> Column:
    """A typed line of names split on commas; null when blank, so the sources are credited."""
    names = F.filter(F.transform(F.split(col(line), ","), lambda n: strip(n)), lambda n: n != "")
    return F.when(F.size(names) > 0, names)


def default_title(sources: DataFrame, fallback: str) -> DataFrame:
    """A book's name from its sources' names: the first, and how many more."""
    named = sources.withColumn("_name", null_if_empty(strip("name")))
    books = named.groupBy("job_id").agg(
        F.min_by("_name", F.when(F.col("_name").isNotNull(), F.col("source_index"))).alias("_first"), F.count("_name").alias("_n")
    )
    many = F.concat("_first", F.lit(" (+"), F.col("_n") - 1, F.lit(" more)"))
    title = F.when(F.col("_n") == 0, fallback).when(F.col("_n") == 1, F.col("_first")).otherwise(many)
    return books.select("job_id", title.alias("title"))


def selection_title(items: DataFrame, sources: DataFrame) -> DataFrame:
    """The name while it follows the selection: a lone source's name or title, else the number of sources."""
    picked = items.filter("selected").select("job_id", "source_index").distinct()
    lone = F.coalesce(null_if_empty(strip("name")), null_if_empty(strip("title")))
    joined = picked.join(sources, ["job_id", "source_index"], "left").groupBy("job_id").agg(
        F.count("*").alias("_n"), F.max(lone).alias("_name")
    )
    counted = F.concat(F.lit("Compilation of "), "_n", F.when(F.col("_n") == 1, " source").otherwise(" sources"))
    title = F.when((F.col("_n") == 1) & F.col("_name").isNotNull(), F.col("_name")).otherwise(counted)
    return joined.select("job_id", F.left(title, F.lit(TITLE_MAX)).alias("title"))
