"""Timed segments to readable paragraphs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions.text import blank, col, escape_tags, null_if_empty, strip, word_count
from leafmill.operators.ordered import Running, block_of, islands, number_rows, running, settle
from leafmill.operators.packing import pack

# When a paragraph ends.
PAUSE_S = 0.75
SOFT_MAX_CHARS = 900
MIN_CHARS = 200
SENTENCE_CHARS = 800
LINES_PER_GROUP = 8
SENTENCE_BREAK = r"(?<=[.!?…])\s+"
# What a whole-sentence segment ends on.
SENTENCE_TAIL = r"[.!?…\"”)][\s\p{Z}]*$"
WORDS_PER_MINUTE = 200
SAMPLE_CHARS = 4000


def marks_of(text: Column | str) -> Column:
    return F.regexp_count(col(text), F.lit("[.!?]"))


def punctuated(words: Column, marks: Column) -> Column:
    return (words >= 20) & (F.try_divide(marks, words) >= 0.02)


def shape_flags(segments: DataFrame, keys: Sequence[str] = ("transcript_id",)) -> DataFrame:
    """What kind of captions each transcript has: punctuated, one sentence per segment, timed."""
    counts = segments.groupBy(*keys).agg(
        F.sum(word_count("text")).alias("words"), F.sum(marks_of("text")).alias("marks"), F.count("*").alias("segments"),
        F.count_if(F.col("text").rlike(SENTENCE_TAIL)).alias("_tails"),
        F.bool_or(F.col("duration_s") > 0).alias("_moves"),
        F.bool_or(F.coalesce("speaker", F.lit("")) != "").alias("has_speakers"),
    )
    return counts.select(
        *keys, "words", punctuated(F.col("words"), F.col("marks")).alias("punctuated"),
        ((F.col("segments") >= 3) & (F.col("_tails") / F.col("segments") >= 0.6)).alias("sentence_segmented"),
        ((F.col("segments") >= 2) & F.col("_moves")).alias("timed"), "has_speakers",
    )


def transcript_stats(segments: DataFrame, languages: DataFrame) -> DataFrame:
    """Words, reading time and language of each transcript."""
    flags = shape_flags(segments).select("transcript_id", "words", "punctuated")
    minutes = F.greatest(F.lit(1), F.bround(F.col("words") / WORDS_PER_MINUTE).cast("bigint"))
    return flags.join(languages, "transcript_id", "left").select(
        "transcript_id", "words", "punctuated", "language", minutes.alias("reading_min")
    )


def assign_chapters(segments: DataFrame, marks: DataFrame, block_s: float = 600.0) -> DataFrame:
    """Each segment with the last chapter that starts at or before it, the first one if none does.

    As-of join as one ordered union: marks and segments on one time line, the last mark seen wins.
    """
    firsts = marks.groupBy("transcript_id").agg(F.min("mark_no").alias("_first"))
    empty = {f.name: F.lit(None).cast(f.dataType) for f in segments.schema.fields}
    as_rows = marks.select(
        "transcript_id", "start_s", *[v.alias(n) for n, v in empty.items() if n not in ("transcript_id", "start_s")],
        F.lit(0).alias("_kind"), F.col("mark_no").alias("_mark"),
    )
    timeline = segments.withColumns({"_kind": F.lit(1), "_mark": F.lit(None).cast("bigint")}).unionByName(as_rows)
    seen = running(
        timeline, ["transcript_id"], [F.floor(F.col("start_s") / block_s)],
        [F.col("start_s"), F.col("_kind"), F.coalesce("_mark", "seq")], {"_seen": Running("last", F.col("_mark"))},
    ).filter("_kind = 1")
    joined = seen.join(firsts, "transcript_id")
    return joined.select(*segments.columns, F.coalesce("_seen", "_first").alias("chapter_no"))


def spoken(segments: DataFrame) -> DataFrame:
    return segments.filter(~blank("text")).withColumn("text", strip("text"))


def speaker_turns(segments: DataFrame, keys: Sequence[str] = ("transcript_id",), block_rows: int = 4096) -> DataFrame:
    """``turn`` of each non-blank segment: consecutive segments of one speaker (unknown equals unknown)."""
    return islands(spoken(segments), keys, block_of("seq", block_rows), [F.col("seq")], F.col("speaker"), "turn")


def pause_groups(segments: DataFrame, keys: Sequence[str] = ("transcript_id",), block_rows: int = 4096) -> DataFrame:
    """``para_no`` of each non-blank segment: cut at a speaker change, a real pause or a length.

    ``opens`` marks the first segment of a speaker's turn.
    """
    place = ([block_of("seq", block_rows)], [F.col("seq")])
    ends = F.struct("speaker", (F.col("start_s") + F.col("duration_s")).alias("end_s"))
    before = running(spoken(segments), keys, *place, {"_prev": Running("lag", ends)}).withColumn(
        "opens", F.col("_prev").isNull() | ~F.col("_prev.speaker").eqNullSafe(F.col("speaker"))
    )
    packed = pack(
        before, keys, block_of("seq", block_rows), ["seq"],
        length=F.length("text") + 1,
        soft=F.col("start_s") - F.col("_prev.end_s") >= PAUSE_S,
        hard=F.col("opens"),
        allowed=F.lit(True), low=MIN_CHARS, high=SOFT_MAX_CHARS, name="para_no",
    )
    return packed.drop("_prev")


def join_texts(order: Sequence[str], text: str = "text", sep: str = " ") -> Column:
    """Texts of a bounded group in order."""
    rows = F.array_sort(F.collect_list(F.struct(*order, F.col(text).alias("_t"))))
    return F.array_join(F.transform(rows, lambda x: x["_t"]), sep)


def pause_paragraphs(segments: DataFrame, keys: Sequence[str] = ("transcript_id",), block_rows: int = 4096) -> DataFrame:
    groups = pause_groups(segments, keys, block_rows).groupBy(*keys, "para_no")
    return groups.agg(
        F.min_by("speaker", "seq").alias("speaker"), F.min_by("opens", "seq").alias("opens"), join_texts(["seq"]).alias("text")
    )


def sentence_paragraphs(segments: DataFrame, keys: Sequence[str] = ("transcript_id",), block_rows: int = 4096) -> DataFrame:
    """Sentences, whichever segments they span, packed into paragraphs of about 800 characters."""
    texts = spoken(segments).select(*keys, "seq", F.posexplode(F.split("text", SENTENCE_BREAK)).alias("piece", "text"))
    pieces = texts.withColumn("text", strip("text")).filter("text <> ''")
    order = [F.col("seq"), F.col("piece")]
    before = running(
        pieces, keys, [block_of("seq", block_rows)], order, {"_prev": Running("last", F.right("text", F.lit(1)), False)}
    )
    opens = F.col("_prev").isNull() | F.col("_prev").rlike("[.!?…]")
    packed = pack(
        before, keys, block_of("seq", block_rows), ["seq", "piece"],
        length=F.length("text") + F.when(opens, 0).otherwise(1), soft=F.lit(False), hard=F.lit(False), allowed=opens,
        low=SENTENCE_CHARS, high=SENTENCE_CHARS, name="para_no",
    )
    return packed.groupBy(*keys, "para_no").agg(join_texts(["seq", "piece"]).alias("text"))


def fixed_groups(segments: DataFrame, keys: Sequence[str] = ("transcript_id",), block_rows: int = 4096) -> DataFrame:
    """Raw captions have no sentences: every eight non-blank lines make a paragraph."""
    numbered = number_rows(spoken(segments), keys, [block_of("seq", block_rows)], [F.col("seq")], "_n")
    grouped = numbered.withColumn("para_no", F.floor((F.col("_n") - 1) / LINES_PER_GROUP).cast("bigint"))
    return grouped.groupBy(*keys, "para_no").agg(join_texts(["seq"]).alias("text"))


def known_names(names: DataFrame) -> DataFrame:
    """Display names worth using: 1 to 60 characters after trimming."""
    tidy = names.withColumn("name", strip("name"))
    return tidy.filter((F.length("name") >= 1) & (F.length("name") <= 60))


def speaker_label(speaker: Column, name: Column, word: Column) -> Column:
    digits = null_if_empty(F.regexp_extract(speaker, r"(\d+)$", 1))
    return F.coalesce(name, F.concat(word, F.lit(" "), digits), null_if_empty(speaker), word)


def with_speaker_labels(rows: DataFrame, names: DataFrame, word: Column) -> DataFrame:
    """``label`` of each row's speaker: its known name, else a numbered word, else the raw id."""
    joined = rows.join(known_names(names), ["transcript_id", "speaker"], "left")
    return joined.withColumn("label", speaker_label(F.col("speaker"), F.col("name"), word)).drop("name")


def dialogue(paragraphs: DataFrame, names: DataFrame, word: Column, keys: Sequence[str] = ("transcript_id",)) -> DataFrame:
    """Paragraphs with the speaker named on the first one of each turn."""
    labelled = with_speaker_labels(paragraphs, names, word)
    text = F.when(
        F.col("opens") & F.col("speaker").isNotNull(), F.concat(F.lit("**"), "label", F.lit(":** "), "text")
    ).otherwise(F.col("text"))
    return labelled.select(*keys, "para_no", text.alias("text"))


def distinct_speakers(segments: DataFrame) -> DataFrame:
    """Speakers in order of first appearance, one row each, with whether there are several."""
    firsts = segments.filter("speaker IS NOT NULL AND speaker <> ''").groupBy("transcript_id", "speaker").agg(
        F.min("seq").alias("first_seq")
    )
    several = firsts.groupBy("transcript_id").agg((F.count("*") >= 2).alias("multi_speaker"))
    ranked = number_rows(firsts, ["transcript_id"], [block_of("first_seq")], [F.col("first_seq")], "rank")
    return ranked.join(several, "transcript_id").select("transcript_id", "speaker", "rank", "multi_speaker")


def dialogue_sample(segments: DataFrame, max_chars: int = SAMPLE_CHARS) -> DataFrame:
    """The opening of each transcript, speaker-labelled lines, up to the segment that reaches the limit.

    Characters are summed in blocks of positions, so a long transcript is not one task. What stays under the
    limit is grouped after that: every non-blank segment has a character, so it is at most ``max_chars`` rows.
    """
    named = spoken(segments).withColumn("speaker", F.coalesce(null_if_empty("speaker"), F.lit("speaker_?")))
    summed = running(
        named, ["transcript_id"], [block_of("seq")], [F.col("seq")],
        {"_so_far": Running("sum", F.length("text").cast("bigint"), inclusive=False)},
    ).filter(F.col("_so_far") < max_chars)
    ahead = Window.partitionBy("transcript_id").orderBy("seq")
    kept = summed.withColumn("_new", (F.lag("speaker").over(ahead) != F.col("speaker")).cast("int"))
    turns = kept.withColumn("turn", F.sum(F.coalesce("_new", F.lit(0))).over(ahead)).groupBy("transcript_id", "turn")
    lines = turns.agg(F.concat(F.min_by("speaker", "seq"), F.lit(": "), join_texts(["seq"])).alias("line"))
    return lines.groupBy("transcript_id").agg(join_texts(["turn"], "line", "\n").alias("sample"))


def transcript_paragraphs(segments: DataFrame, marks: DataFrame, names: DataFrame, word: Column) -> DataFrame:
    """Every transcript as paragraph rows: (transcript_id, chapter_no, para_no, kind, text).

    Without chapters: dialogue when a speaker is known, pause paragraphs when segments are timed
    sentences, else sentence or fixed groups. With chapters each chapter chooses for itself, under a
    heading row (para_no -1); chapters without text give nothing.
    """
    keys = ["transcript_id", "chapter_no"]
    chaptered = assign_chapters(segments, marks)
    plain = segments.join(marks.select("transcript_id").distinct(), "transcript_id", "left_anti").withColumn(
        "chapter_no", F.lit(-1).cast("bigint")
    )
    rows = plain.unionByName(chaptered)
    flags = shape_flags(rows, keys)
    clean = shape_flags(spoken(rows), keys).select(*keys, F.col("punctuated").alias("_clean_punctuated"))
    route = (
        F.when((F.col("chapter_no") == -1) & F.col("has_speakers"), "dialogue")
        .when(F.col("sentence_segmented") & F.col("timed"), "pauses")
        .when(F.col("_clean_punctuated"), "sentences").otherwise("fixed")
    )
    # The as-of join is done once; every route reads its own rows of the settled table.
    routed = settle(rows.join(flags.join(clean, keys).select(*keys, route.alias("kind")), keys))

    def of(kind: str) -> DataFrame:
        return routed.filter(F.col("kind") == kind).drop("kind")

    talk = dialogue(pause_paragraphs(of("dialogue"), keys), names, word, keys)
    parts = {
        "dialogue": talk, "pauses": pause_paragraphs(of("pauses"), keys).drop("speaker", "opens"),
        "sentences": sentence_paragraphs(of("sentences"), keys), "fixed": fixed_groups(of("fixed"), keys),
    }
    body = None
    for kind, part in parts.items():
        part = part.select(*keys, "para_no", F.lit(kind).alias("kind"), "text")
        body = part if body is None else body.unionByName(part)
    headed = spoken(routed.filter("chapter_no >= 0")).select(*keys).distinct().join(
        marks.select("transcript_id", F.col("mark_no").alias("chapter_no"), "title"), keys
    )
    headings = headed.select(
        *keys, F.lit(-1).cast("bigint").alias("para_no"), F.lit("heading").alias("kind"),
        F.concat(F.lit("## "), escape_tags("title")).alias("text"),
    )
    return body.unionByName(headings)
