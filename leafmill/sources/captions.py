"""Caption, transcript and speech payloads, one per row, to timed segments.

A payload is one row, so everything inside it is parsed with ``from_json``, ``split`` and
``posexplode``: no shuffle. A payload that does not parse gives no segments.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions.text import blank, collapse, let, null_if_empty, strip
from leafmill.operators.ordered import Running, block_of, running
from leafmill.shared import settle

EVENTS = "events ARRAY<STRUCT<tStartMs: DOUBLE, dDurationMs: DOUBLE, segs: ARRAY<STRUCT<utf8: STRING>>>>"
ROWS = "rows ARRAY<STRUCT<text: STRING, startMs: BIGINT, endMs: BIGINT>>"
EPISODE = "segments ARRAY<STRUCT<body: STRING, startTime: DOUBLE, endTime: DOUBLE, speaker: STRING>>"
SPEECH = (
    "text STRING, words ARRAY<STRUCT<text: STRING, type: STRING, start: DOUBLE, `end`: DOUBLE, speaker_id: STRING>>, "
    "segments ARRAY<STRUCT<text: STRING, start: DOUBLE, `end`: DOUBLE, speaker_id: STRING>>"
)
ARROW = "-->"
# The shape of a cue's time stamp and of its voice tag.
STAMP = r"(?:(\d+):)?(\d{1,2}):(\d{2})[.,](\d{1,3})"
VOICE = r"<v(?:\.[^ >]*)?\s+([^>]+)>"
# What ends a sentence in a word stream.
SENTENCE_END = r"[.?!…][\s\p{Z}]*$"
# The lines of a speaker-turn page.
TURN = r"^\*\*([^*]+?) · ([\d:.]+)–([\d:.]+)\*\*\s*$"
FIELD = r"(?m)^- \*\*([^*]+):\*\* (.+)$"


def _rows(payloads: DataFrame, schema: str, array: str, keep: tuple[str, ...]) -> DataFrame:
    parsed = payloads.select(*keep, F.from_json("body", schema).alias("_p"))
    return parsed.select(*keep, F.posexplode(f"_p.{array}").alias("seq", "_r"))


def caption_events(payloads: DataFrame, keep=("payload_id",)) -> DataFrame:
    text = strip(F.array_join(F.transform("_r.segs", lambda s: s["utf8"]), ""))
    rows = _rows(payloads, EVENTS, "events", keep).filter("_r.segs IS NOT NULL")
    out = rows.select(
        *keep, "seq", text.alias("text"),
        (F.coalesce("_r.tStartMs", F.lit(0.0)) / 1000).alias("start_s"),
        (F.coalesce("_r.dDurationMs", F.lit(0.0)) / 1000).alias("duration_s"),
    )
    return out.filter("text <> ''")


def caption_rows(payloads: DataFrame, keep=("payload_id",)) -> DataFrame:
    start = F.coalesce("_r.startMs", F.lit(0))
    end = F.coalesce(F.nullif("_r.endMs", F.lit(0)), start)
    out = _rows(payloads, ROWS, "rows", keep).select(
        *keep, "seq", strip("_r.text").alias("text"), (start / 1000).alias("start_s"),
        (F.greatest(end - start, F.lit(0)) / 1000).alias("duration_s"),
    )
    return out.filter("text <> ''")


def episode_segments(payloads: DataFrame, keep=("payload_id",)) -> DataFrame:
    start = F.coalesce("_r.startTime", F.lit(0.0))
    end = F.coalesce(F.nullif("_r.endTime", F.lit(0.0)), start)
    out = _rows(payloads, EPISODE, "segments", keep).select(
        *keep, "seq", strip("_r.body").alias("text"), start.alias("start_s"),
        F.greatest(end - start, F.lit(0.0)).alias("duration_s"), null_if_empty("_r.speaker").alias("speaker"),
    )
    return out.filter("text <> ''")


def stamp_seconds(stamp: Column) -> Column:
    """``[H:]MM:SS,mmm`` in seconds; short milliseconds are padded on the right."""
    part = [F.regexp_extract(stamp, STAMP, i) for i in (1, 2, 3, 4)]
    hours = F.coalesce(part[0].try_cast("bigint"), F.lit(0))
    whole = hours * 3600 + part[1].try_cast("bigint") * 60 + part[2].try_cast("bigint")
    return F.when(stamp.rlike(STAMP), whole + F.rpad(part[3], 3, "0").try_cast("bigint") / 1000)


def cue_segments(files: DataFrame, keep=("file_id",)) -> DataFrame:
    """SRT and WebVTT: blank-line blocks whose arrow line holds the times."""
    body = F.replace("body", F.lit("﻿"), F.lit(""))
    blocks = files.select(*keep, F.posexplode(F.split(body, r"\r?\n\s*\r?\n")).alias("seq", "_block"))
    lines = blocks.select(*keep, "seq", F.split(strip("_block"), r"\r?\n").alias("_lines")).withColumn(
        "_at", F.array_position(F.transform("_lines", lambda x: x.contains(ARROW)), True)
    )
    cues = lines.filter("_at > 0").withColumns({
        "_times": F.element_at("_lines", F.col("_at").cast("int")),
        "_raw": F.array_join(
            F.transform(F.slice("_lines", F.col("_at").cast("int") + 1, F.size("_lines")), lambda x: strip(x)), " "
        ),
    })
    start = stamp_seconds(F.split_part("_times", F.lit(ARROW), F.lit(1)))
    end = stamp_seconds(F.regexp_extract("_times", ARROW + r"(.*)$", 1))
    out = cues.select(
        *keep, "seq", collapse(F.regexp_replace("_raw", "<[^>]+>", "")).alias("text"), start.alias("start_s"),
        F.greatest(F.coalesce(F.nullif(end, F.lit(0.0)), start) - start, F.lit(0.0)).alias("duration_s"),
        null_if_empty(F.trim(F.regexp_extract("_raw", VOICE, 1))).alias("speaker"),
    )
    return out.filter("start_s IS NOT NULL AND text <> ''")


def plain_paragraphs(texts: DataFrame, text: str, keep: tuple[str, ...]) -> DataFrame:
    """Blank-line paragraphs with white space collapsed, no timing."""
    rows = texts.select(*keep, F.posexplode(F.split(text, r"\n\s*\n")).alias("seq", "_p"))
    zero = F.lit(0.0)
    out = rows.select(*keep, "seq", collapse("_p").alias("text"), zero.alias("start_s"), zero.alias("duration_s"))
    return out.filter("text <> ''")


def clock_seconds(stamp: Column) -> Column:
    """``64:37.329`` or ``1:04:37.329`` in seconds, null for anything else."""
    parts = F.transform(F.split(stamp, ":"), lambda p: p.try_cast("double"))
    return F.aggregate(parts, F.lit(0.0), lambda total, p: total * 60 + p)


def page_fields(pages: DataFrame) -> DataFrame:
    """Language tag and length that a speaker-turn page states before its transcript."""
    header = F.regexp_extract("text", r"(?s)^(.*?)(?:\n## Transcript.*)?$", 1)
    fields = F.map_from_entries(F.array_distinct(F.transform(
        F.regexp_extract_all(header, F.lit(FIELD), 0),
        lambda f: F.struct(F.lower(F.trim(F.regexp_extract(f, FIELD, 1))), F.trim(F.regexp_extract(f, FIELD, 2))),
    )))
    return pages.select(
        "page_id", fields["language"].alias("language"), clock_seconds(fields["duration"]).alias("duration_s")
    )


def speaker_turns(pages: DataFrame) -> DataFrame:
    """The turns of a page's transcript section. A turn with an unreadable stamp starts where the last ended.

    A page is one row, so its turns are cut inside the row and the windows over one page stay small.
    """
    body = F.regexp_extract("text", r"(?s)\n## Transcript(.*?)(?:\n## .*)?$", 1)
    line = r"(?m)^\s*?(\*\*[^*\n]+? · [\d:.]+–[\d:.]+\*\*)[^\S\n]*$"
    cut = pages.filter(F.col("text").contains("\n## Transcript")).select(
        "page_id", F.regexp_extract_all(body, F.lit(line), 1).alias("_heads"), F.split(body, line, -1).alias("_bodies")
    )

    def said(text: Column) -> Column:
        lines = F.filter(F.transform(F.split(text, "\n"), lambda x: strip(x)), lambda x: x != "")
        return F.array_join(lines, " ")

    turns = F.zip_with("_heads", F.slice("_bodies", F.lit(2), F.size("_heads")), lambda h, t: F.struct(h.alias("head"), said(t).alias("text")))
    rows = cut.select("page_id", F.posexplode(turns).alias("turn", "t")).filter("t.text <> ''")
    timed = rows.select(
        "page_id", (F.col("turn") + 1).cast("bigint").alias("turn"), "t.text", F.trim(F.regexp_extract("t.head", TURN, 1)).alias("speaker"),
        clock_seconds(F.regexp_extract("t.head", TURN, 2)).alias("_start"), clock_seconds(F.regexp_extract("t.head", TURN, 3)).alias("_end"),
    )
    # Runs of turns with unreadable starts hang on the last readable one and end at the latest end seen.
    page = Window.partitionBy("page_id").orderBy("turn")
    hung = timed.withColumn("_run", F.count("_start").over(page))
    run = Window.partitionBy("page_id", "_run").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    ends = hung.withColumn("_reach", F.max(F.greatest("_start", "_end")).over(run))
    start = F.coalesce("_start", "_reach", F.lit(0.0))
    return ends.select(
        "page_id", "turn", "speaker", "text", start.alias("start_s"),
        F.greatest(F.coalesce("_end", start) - start, F.lit(0.0)).alias("duration_s"),
    )


def _word(pos: Column, text: Column, kind: Column, start_s: Column, end_s: Column, speaker: Column) -> Column:
    parts = (pos.cast("bigint"), F.coalesce(text, F.lit("")), kind == "word", start_s.cast("double"), end_s.cast("double"), speaker)
    names = ("pos", "t", "is_word", "start_s", "end_s", "speaker")
    return F.struct(*[part.alias(name) for part, name in zip(parts, names)])


def _pieces(words: Column) -> Column:
    """Words and spacings in order, cut before each word that follows a sentence's end or another speaker; what comes before the first word is a piece of its own.

    A slice for each piece, so linear in the words. ``reach`` is the last end known at the piece.
    """
    def cut(x: Column) -> Column:
        own = F.filter(F.transform(x, lambda w, i: F.struct(i.alias("i"), w.alias("w"))), lambda e: e["w"]["is_word"])

        def starts(ws: Column) -> Column:
            def opens(e: Column, j: Column) -> Column:
                before = F.get(ws, j - 1)["w"]
                return (j == 0) | before["t"].rlike(SENTENCE_END) | ~before["speaker"].eqNullSafe(e["w"]["speaker"])

            return F.transform(F.filter(ws, opens), lambda e: e["i"])

        def sliced(at: Column) -> Column:
            whole = F.when((F.size(at) == 0) | (F.get(at, F.lit(0)) > 0), F.concat(F.array(F.lit(0)), at)).otherwise(at)
            return let(whole, lambda s: F.transform(s, lambda low, k: F.slice(x, low + 1, F.coalesce(F.get(s, k + 1), F.size(x)) - low)))

        return let(let(own, starts), sliced)

    def piece(p: Column) -> Column:
        def described(ws: Column) -> Column:
            ends = F.filter(F.transform(ws, lambda w: w["end_s"]), lambda e: e.isNotNull())
            first = F.get(ws, F.lit(0))
            return F.struct(
                F.array_join(F.transform(p, lambda w: w["t"]), "").alias("t"), (F.size(ws) > 0).alias("spoken"), first["start_s"].alias("start_s"),
                F.element_at(ends, F.when(F.size(ends) > 0, -1)).alias("end_s"), first["speaker"].alias("speaker"),
                F.coalesce(F.element_at(ws, F.when(F.size(ws) > 0, -1))["t"].rlike(SENTENCE_END), F.lit(False)).alias("ended"),
            )

        return let(F.filter(p, lambda w: w["is_word"]), described)

    def reached(ps: Column) -> Column:
        def last_end(p: Column, k: Column) -> Column:
            # Only a piece without an end of its own looks back.
            known = F.filter(F.slice(ps, F.lit(1), k), lambda q: q["end_s"].isNotNull())
            return p.withField("reach", F.coalesce(p["end_s"], F.element_at(known, F.when(F.size(known) > 0, -1))["end_s"]))

        return F.transform(ps, last_end)

    return let(F.transform(cut(words), piece), reached)


def word_segments(words: DataFrame, key: str, block_rows: int = 4096) -> DataFrame:
    """A word stream (pos, text, kind, start_s, end_s, speaker_id) cut at sentence ends and speaker changes.

    Sound events are dropped. Spacings belong to the word before them. A segment whose words have no end ends where the one before did.
    Words are shuffled once, by blocks of their positions, and cut in a block's row, which is settled; a table with one row for each block that
    has others before it says how its first piece hangs on them. Only the first and the last piece of a block meet those of others.
    """
    spoken = words.filter("kind <> 'audio_event'")
    word = _word(F.col("pos"), F.col("text"), F.col("kind"), F.col("start_s"), F.col("end_s"), F.col("speaker_id"))
    blocks = spoken.groupBy(key, block_of("pos", block_rows).alias("_block")).agg(F.array_sort(F.collect_list(word)).alias("_w"))
    cut = settle(blocks.select(key, "_block", _pieces(F.col("_w")).alias("_p")), "pieces", free=True)
    said = F.filter("_p", lambda p: p["spoken"])
    ends = F.filter(F.transform("_p", lambda p: p["end_s"]), lambda e: e.isNotNull())
    count = lambda x: F.when(F.size(x) > 0, -1)
    steps = cut.withColumn("_said", said).select(
        key, "_block", F.size("_said").cast("bigint").alias("_n"), F.when(F.size("_said") > 0, F.struct(F.get("_said", F.lit(0))["speaker"].alias("s"))).alias("_head"),
        F.when(F.size("_said") > 0, let(F.element_at("_said", -1), lambda p: F.struct(p["ended"].alias("ended"), p["speaker"].alias("speaker")))).alias("_tail"),
        F.element_at(ends, count(ends)).alias("_end"),
    )
    across = Window.partitionBy(key).orderBy("_block")
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    came = steps.withColumns({"_came": F.last("_tail", ignorenulls=True).over(before), "_reach": F.last("_end", ignorenulls=True).over(before)})
    opens = F.col("_came").isNotNull() & F.col("_head").isNotNull() & (F.col("_came.ended") | ~F.col("_came.speaker").eqNullSafe(F.col("_head.s")))
    counted = came.withColumn("_opens", F.coalesce(opens, F.lit(False)).cast("bigint"))
    carry = counted.select(
        F.col(key).alias("_key"), F.col("_block").alias("_at"), "_opens", "_reach",
        F.coalesce(F.sum(F.greatest(F.col("_n") - 1, F.lit(0)) + F.col("_opens")).over(before), F.lit(0)).alias("_carry"),
    ).filter("_opens <> 0 OR _carry <> 0 OR _reach IS NOT NULL")
    placed = cut.join(carry, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_block") == F.col("_at")), "left").fillna(0, ["_opens", "_carry"])
    lead = (~F.get("_p", F.lit(0))["spoken"]).cast("int")
    rows = placed.select(key, "_block", "_opens", "_carry", "_reach", lead.alias("_lead"), F.size("_p").alias("_size"), F.posexplode("_p").alias("_i", "p"))
    number = F.col("_carry") + F.when(F.col("p.spoken"), F.col("_opens") + F.col("_i") - F.col("_lead")).otherwise(F.lit(0))
    inner = (F.col("_i") > F.col("_lead")) & (F.col("_i") < F.col("_size") - 1)
    numbered = rows.select(key, number.cast("bigint").alias("seg_no"), F.struct("_block", "_i").alias("_spot"), "p", F.coalesce("p.reach", "_reach", F.lit(0.0)).alias("_until"), inner.alias("_inner"))
    whole = numbered.filter("_inner").select(
        key, "seg_no", strip(F.col("p.t")).alias("text"), F.coalesce("p.start_s", F.lit(0.0)).alias("start_s"), F.col("_until").alias("end_s"), F.col("p.speaker").alias("speaker"))
    spot = F.when(F.col("p.spoken"), F.col("_spot"))
    ordered = F.array_sort(F.collect_list(F.struct("_spot", F.col("p.t").alias("t"))))
    out = numbered.filter("NOT _inner").groupBy(key, "seg_no").agg(
        strip(F.array_join(F.transform(ordered, lambda x: x["t"]), "")).alias("text"),
        F.coalesce(F.min_by("p.start_s", spot), F.lit(0.0)).alias("start_s"), F.max_by("_until", "_spot").alias("end_s"), F.min_by("p.speaker", spot).alias("speaker"),
    )
    return whole.unionAll(out).filter("text <> ''")


def words_in_row(words: Column) -> Column:
    """The segments (seq, text, start_s, end_s, speaker) of a word stream that is one array: the same cuts, without a shuffle."""
    def glued(ps: Column) -> Column:
        # Spacings before the first word belong to its segment.
        lead = F.when(~F.get(ps, F.lit(0))["spoken"] & (F.size(ps) > 1), F.get(ps, F.lit(0))["t"]).otherwise("")
        rest = F.when(lead != "", F.slice(ps, F.lit(2), F.size(ps))).otherwise(ps)
        return F.transform(rest, lambda p, i: F.struct(
            i.cast("bigint").alias("seq"), strip(F.concat(F.when(i == 0, lead).otherwise(""), p["t"])).alias("text"), F.coalesce(p["start_s"], F.lit(0.0)).alias("start_s"),
            F.coalesce(p["reach"], F.lit(0.0)).alias("end_s"), p["speaker"].alias("speaker"),
        ))

    return F.filter(let(_pieces(words), glued), lambda s: s["text"] != "")


def speech_segments(payloads: DataFrame) -> DataFrame:
    """Speech-to-text answers: word streams are cut into sentences, segment lists taken as they are. All of it in the answer's row."""
    parsed = payloads.select("payload_id", F.from_json("body", SPEECH).alias("p"))
    spoken = F.filter(F.transform("p.words", lambda w, i: _word(
        i, w["text"], F.coalesce(w["type"], F.lit("word")), w["start"], w["end"], w["speaker_id"]).withField("event", F.coalesce(w["type"] == "audio_event", F.lit(False)))), lambda w: ~w["event"])
    listed = F.filter(
        F.transform("p.segments", lambda s, i: F.struct(
            i.cast("bigint").alias("seq"), strip(s["text"]).alias("text"), s["start"].cast("double").alias("start_s"), s["end"].cast("double").alias("end_s"), s["speaker_id"].alias("speaker"))),
        lambda s: s["start_s"].isNotNull() & s["end_s"].isNotNull() & (s["text"] != ""),
    )
    rows = parsed.select("payload_id", F.explode(F.when(F.col("p.words").isNotNull(), words_in_row(spoken)).otherwise(listed)).alias("s"))
    return rows.select("payload_id", "s.*")


def speech_text(payloads: DataFrame) -> DataFrame:
    """The flat text of each answer."""
    text = strip(F.coalesce(F.from_json("body", SPEECH)["text"], F.lit("")))
    return payloads.select("payload_id", text.alias("text"))


def stitch_chunks(chunks: DataFrame, segments: DataFrame, block_rows: int = 4096) -> DataFrame:
    """Chunk-local times to episode times.

    ``chunks(episode_id, chunk_no, text, probed_s)``, ``segments(episode_id, chunk_no, seq, text,
    start_s, end_s, speaker)``. A chunk lasts until its last segment ends, else as long as probed.
    A chunk with flat text only is one segment; speakers hold only in a one-chunk episode.
    """
    keys = ["episode_id", "chunk_no"]
    spans = segments.groupBy(*keys).agg(F.max("end_s").alias("_span"))
    sized = chunks.join(spans, keys, "left").withColumn("_length", F.coalesce("_span", "probed_s", F.lit(0.0)))
    placed = running(
        sized, ["episode_id"], [block_of("chunk_no", block_rows)], [F.col("chunk_no")],
        {"_offset": Running("sum", F.col("_length"), False)},
    )
    counts = chunks.groupBy("episode_id").agg((F.count("*") == 1).alias("_single"))
    located = placed.join(counts, "episode_id")
    timed = segments.withColumnRenamed("text", "_t").join(located, keys).select(
        *keys, "seq", F.col("_t").alias("text"), (F.col("_offset") + F.col("start_s")).alias("start_s"),
        F.greatest(F.col("end_s") - F.col("start_s"), F.lit(0.0)).alias("duration_s"),
        F.when(F.col("_single"), F.col("speaker")).alias("speaker"),
    )
    flat = located.filter(F.col("_span").isNull() & ~blank("text")).select(
        *keys, F.lit(0).cast("bigint").alias("seq"), strip("text").alias("text"), F.col("_offset").alias("start_s"),
        F.col("_length").alias("duration_s"), F.lit(None).cast("string").alias("speaker"),
    )
    return timed.unionByName(flat)


def chapter_marks_from_starts(marks: DataFrame, block_rows: int = 4096) -> DataFrame:
    """Marks that give only their start: each ends at the next, the last with the video."""
    usable = marks.filter("title IS NOT NULL AND title <> '' AND start_s IS NOT NULL")
    # Reading backwards, the mark before a mark is the next one.
    nexts = running(
        usable, ["transcript_id"], [-block_of("mark_no", block_rows)], [-F.col("mark_no")],
        {"_next": Running("lag", F.col("start_s"))},
    )
    end = F.coalesce("_next", F.greatest("total_s", "start_s"))
    return nexts.select("transcript_id", "mark_no", strip("title").alias("title"), "start_s", end.alias("end_s"))


def chapter_marks_with_ends(marks: DataFrame) -> DataFrame:
    usable = marks.withColumn("title", strip("title")).filter("title <> '' AND start_s IS NOT NULL AND end_s IS NOT NULL")
    return usable.select("transcript_id", "mark_no", "title", "start_s", "end_s")
