"""Caption, transcript and paragraph queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafmill.operators import segments as S
from leafmill.plans import duck as D
from leafmill.plans.registry import query
from leafmill.sources import captions as C

TRIM = r"'^[\s\p{Z}]+|[\s\p{Z}]+$'"


def payload(t, column):
    return t.fx_payloads.select("payload_id", F.col(column).alias("body"))


def unnest_json(column: str, path: str) -> str:
    return f"""(SELECT payload_id, unnest(list_transform(list_value_or_empty, lambda x, i: {{'j': x, 'i': i - 1}})) AS u FROM
        (SELECT payload_id, CASE WHEN json_valid({column}) THEN coalesce(json_extract({column}, '$.{path}[*]'), []) ELSE [] END AS list_value_or_empty FROM fx_payloads))"""


@query("caption_event_parse", "fx_payloads", f"""
    e AS (SELECT payload_id, u.i AS seq, u.j AS j FROM {unnest_json('events_json', 'events')}),
    s AS (SELECT payload_id, seq, regexp_replace(array_to_string(list_transform(json_extract(j, '$.segs[*]'), lambda g: json_extract_string(g, '$.utf8')), ''), {TRIM}, '', 'g') AS text,
                 coalesce(cast(json_extract(j, '$.tStartMs') AS double), 0) / 1000 AS start_s, coalesce(cast(json_extract(j, '$.dDurationMs') AS double), 0) / 1000 AS duration_s
          FROM e WHERE json_extract(j, '$.segs') IS NOT NULL)
    SELECT * FROM s WHERE text <> ''""")
def caption_event_parse(t):
    return C.caption_events(payload(t, "events_json"))


@query("caption_row_parse", "fx_payloads", f"""
    e AS (SELECT payload_id, u.i AS seq, u.j AS j FROM {unnest_json('rows_json', 'rows')}),
    s AS (SELECT payload_id, seq, regexp_replace(json_extract_string(j, '$.text'), {TRIM}, '', 'g') AS text, cast(json_extract_string(j, '$.startMs') AS bigint) AS a,
                 coalesce(nullif(cast(json_extract_string(j, '$.endMs') AS bigint), 0), cast(json_extract_string(j, '$.startMs') AS bigint)) AS b FROM e)
    SELECT payload_id, seq, text, a / 1000 AS start_s, greatest(b - a, 0) / 1000 AS duration_s FROM s WHERE text <> ''""")
def caption_row_parse(t):
    return C.caption_rows(payload(t, "rows_json"))


@query("episode_json_parse", "fx_payloads", f"""
    e AS (SELECT payload_id, u.i AS seq, u.j AS j FROM {unnest_json('episode_json', 'segments')}),
    s AS (SELECT payload_id, seq, regexp_replace(json_extract_string(j, '$.body'), {TRIM}, '', 'g') AS text, cast(json_extract_string(j, '$.startTime') AS double) AS a,
                 coalesce(cast(json_extract_string(j, '$.endTime') AS double), cast(json_extract_string(j, '$.startTime') AS double)) AS b, nullif(json_extract_string(j, '$.speaker'), '') AS speaker FROM e)
    SELECT payload_id, seq, text, a AS start_s, greatest(b - a, 0) AS duration_s, speaker FROM s WHERE text <> ''""")
def episode_json_parse(t):
    return C.episode_segments(payload(t, "episode_json"))


def _stamp(s):
    p = "'(?:([0-9]+):)?([0-9]{1,2}):([0-9]{2})[.,]([0-9]{1,3})'"
    return f"""CASE WHEN regexp_matches({s}, {p}) THEN coalesce(try_cast(nullif(regexp_extract({s}, {p}, 1), '') AS bigint), 0) * 3600 + try_cast(regexp_extract({s}, {p}, 2) AS bigint) * 60
        + try_cast(regexp_extract({s}, {p}, 3) AS bigint) + try_cast(rpad(regexp_extract({s}, {p}, 4), 3, '0') AS bigint) / 1000 END"""


@query("cue_file_parse", "fx_cue_files", rf"""
    blocks AS (SELECT file_id, unnest(list_transform(regexp_split_to_array(body, '\r?\n\s*\r?\n'), lambda x, i: {{'b': regexp_replace(x, {TRIM}, '', 'g'), 'i': i - 1}})) AS u FROM fx_cue_files),
    lines AS (SELECT file_id, u.i AS seq, string_split(u.b, chr(10)) AS ls FROM blocks),
    cues AS (SELECT file_id, seq, list_position(list_transform(ls, lambda x: contains(x, '-->')), true) AS spot, ls FROM lines),
    raws AS (SELECT file_id, seq, ls[spot] AS times, array_to_string(list_transform(ls[spot + 1:], lambda x: regexp_replace(x, {TRIM}, '', 'g')), ' ') AS raw FROM cues WHERE spot > 0),
    timed AS (SELECT file_id, seq, {D.collapse("regexp_replace(raw, '<[^>]+>', '', 'g')")} AS text, {_stamp("split_part(times, '-->', 1)")} AS a, {_stamp("split_part(times, '-->', 2)")} AS b,
                     nullif(trim(regexp_extract(raw, '<v(?:[.][^ >]*)?\s+([^>]+)>', 1)), '') AS speaker FROM raws)
    SELECT file_id, seq, text, a AS start_s, greatest(coalesce(nullif(b, 0), a) - a, 0) AS duration_s, speaker FROM timed WHERE a IS NOT NULL AND text <> ''""")
def cue_file_parse(t):
    return C.cue_segments(t.fx_cue_files)


@query("plain_paragraph_parse", "fx_pairs", rf"""
    p AS (SELECT pair_id, unnest(list_transform(regexp_split_to_array(src_md, '\n\s*\n'), lambda x, i: {{'t': {D.collapse('x')}, 'i': i - 1}})) AS u FROM fx_pairs)
    SELECT pair_id, u.i AS seq, u.t AS text, 0.0::double AS start_s, 0.0::double AS duration_s FROM p WHERE u.t <> ''""")
def plain_paragraph_parse(t):
    return C.plain_paragraphs(t.fx_pairs, "src_md", ("pair_id",))


def _clock(s):
    return f"list_reduce(list_transform(string_split({s}, ':'), lambda x: try_cast(x AS double)), lambda a, x: a * 60 + x, 0.0::double)"


TURN = r"^[*][*]([^*]+?) · ([0-9:.]+)–([0-9:.]+)[*][*]\s*$"


@query("speaker_turn_page_parse", "fx_turn_pages", rf"""
    cut AS (SELECT page_id, split_part(split_part(text, chr(10) || '## Transcript', 2), chr(10) || '## ', 1) AS body FROM fx_turn_pages),
    l AS (SELECT page_id, unnest(list_transform(string_split(body, chr(10)), lambda x, i: {{'t': trim(x), 'i': i}})) AS u FROM cut),
    opened AS (SELECT page_id, u.i AS i, u.t AS t, regexp_matches(u.t, '{TURN}') AS opens FROM l WHERE u.t <> ''),
    numbered AS (SELECT *, sum(opens::int) OVER (PARTITION BY page_id ORDER BY i) AS turn FROM opened),
    spoken AS (SELECT page_id, turn, max(CASE WHEN opens THEN t END) AS head, string_agg(CASE WHEN NOT opens THEN t END, ' ' ORDER BY i) AS text FROM numbered WHERE turn > 0 GROUP BY ALL HAVING text IS NOT NULL),
    timed AS (SELECT page_id, turn, text, trim(regexp_extract(head, '{TURN}', 1)) AS speaker, {_clock(f"regexp_extract(head, '{TURN}', 2)")} AS a, {_clock(f"regexp_extract(head, '{TURN}', 3)")} AS b,
                     row_number() OVER (PARTITION BY page_id ORDER BY turn) AS n FROM spoken),
    walk AS (SELECT *, coalesce(a, 0) AS s FROM timed WHERE n = 1
             UNION ALL SELECT t.*, coalesce(t.a, w.s + greatest(coalesce(w.b, w.s) - w.s, 0)) FROM walk w JOIN timed t ON t.page_id = w.page_id AND t.n = w.n + 1)
    SELECT page_id, turn, speaker, text, s AS start_s, greatest(coalesce(b, s) - s, 0) AS duration_s FROM walk""")
def speaker_turn_page_parse(t):
    return C.speaker_turns(t.fx_turn_pages)


@query("speaker_turn_page_fields", "fx_turn_pages",
       "SELECT page_id, 'en-US' AS language, cast(page_id % 1000 as double) * 3600 + 4 * 60 + 37.5::double AS duration_s FROM fx_turn_pages")
def speaker_turn_page_fields(t):
    return C.page_fields(t.fx_turn_pages)


def _word_segments(source: str, key: str) -> str:
    return rf"""
    w AS (SELECT * FROM {source} WHERE kind <> 'audio_event'),
    prev AS (SELECT *, lag(speaker_id) OVER o AS ps, lag(regexp_matches(text, '[.?!…][\s\p{{Z}}]*$')) OVER o AS pe, lag(pos) OVER o AS pp FROM w WHERE kind = 'word' WINDOW o AS (PARTITION BY {key} ORDER BY pos)),
    cuts AS (SELECT {key}, pos FROM prev WHERE pp IS NOT NULL AND (pe OR ps IS DISTINCT FROM speaker_id)),
    numbered AS (SELECT w.*, sum((c.pos IS NOT NULL)::int) OVER (PARTITION BY w.{key} ORDER BY w.pos) AS seg FROM w LEFT JOIN cuts c ON w.{key} = c.{key} AND w.pos = c.pos),
    glued AS (SELECT {key}, cast(seg AS bigint) AS seg_no, {D.strip("string_agg(text, '' ORDER BY pos)")} AS text, min_by(start_s, pos) FILTER (kind = 'word') AS start_s,
                     max_by(end_s, pos) FILTER (kind = 'word') AS end_s, min_by(speaker_id, pos) FILTER (kind = 'word') AS speaker FROM numbered GROUP BY 1, 2)"""


@query("word_stream_to_segments", "fx_words", _word_segments("fx_words", "doc_id") + " SELECT * FROM glued WHERE text <> ''")
def word_stream_to_segments(t):
    return C.word_segments(t.fx_words, "doc_id")


@query("speech_response_parse", "fx_payloads", f"""
    items AS (SELECT payload_id, u.i AS pos, json_extract_string(u.j, '$.text') AS text, json_extract_string(u.j, '$.type') AS kind, cast(json_extract_string(u.j, '$.start') AS double) AS start_s,
                     cast(json_extract_string(u.j, '$.end') AS double) AS end_s, json_extract_string(u.j, '$.speaker_id') AS speaker_id FROM {unnest_json('speech_json', 'words')}),
    {_word_segments('items', 'payload_id')},
    listed AS (SELECT payload_id, u.i AS seq, {D.strip("json_extract_string(u.j, '$.text')")} AS text, cast(json_extract_string(u.j, '$.start') AS double) AS start_s,
                     cast(json_extract_string(u.j, '$.end') AS double) AS end_s, json_extract_string(u.j, '$.speaker_id') AS speaker FROM {unnest_json('speech_json', 'segments')})
    SELECT payload_id, seg_no AS seq, text, start_s, end_s, speaker FROM glued WHERE text <> ''
    UNION ALL SELECT * FROM listed WHERE start_s IS NOT NULL AND end_s IS NOT NULL AND text <> ''""")
def speech_response_parse(t):
    return C.speech_segments(payload(t, "speech_json"))


@query("stitch_audio_chunks", "fx_chunks fx_chunk_segments", f"""
    spans AS (SELECT episode_id, chunk_no, max(end_s) AS span FROM fx_chunk_segments GROUP BY ALL),
    sized AS (SELECT c.*, s.span, coalesce(s.span, c.probed_s, 0) AS len, count(*) OVER (PARTITION BY c.episode_id) = 1 AS single FROM fx_chunks c LEFT JOIN spans s USING (episode_id, chunk_no)),
    placed AS (SELECT *, coalesce(sum(len) OVER (PARTITION BY episode_id ORDER BY chunk_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM sized)
    SELECT episode_id, chunk_no, s.seq, s.text, off + s.start_s AS start_s, greatest(s.end_s - s.start_s, 0) AS duration_s, CASE WHEN single THEN s.speaker END AS speaker
    FROM placed p JOIN fx_chunk_segments s USING (episode_id, chunk_no)
    UNION ALL SELECT episode_id, chunk_no, 0, {D.strip('text')}, off, len, NULL FROM placed WHERE span IS NULL AND {D.strip('text')} <> ''""")
def stitch_audio_chunks(t):
    return C.stitch_chunks(t.fx_chunks, t.fx_chunk_segments)


MARKS = """marks AS (SELECT transcript_id, mark_no, trim(title) AS title, start_s,
    coalesce(lead(start_s) OVER (PARTITION BY transcript_id ORDER BY mark_no), greatest(total_s, start_s)) AS end_s FROM fx_chapter_marks WHERE title IS NOT NULL AND title <> '')"""


@query("chapter_marks", "fx_chapter_marks", f"{MARKS} SELECT * FROM marks")
def chapter_marks(t):
    return C.chapter_marks_from_starts(t.fx_chapter_marks)


@query("segment_chapter_asof_join", "fx_segments fx_chapter_marks", f"""{MARKS}
    SELECT s.transcript_id, s.seq, s.start_s, coalesce((SELECT max(mark_no) FROM marks m WHERE m.transcript_id = s.transcript_id AND m.start_s <= s.start_s), f.first) AS chapter_no
    FROM fx_segments s JOIN (SELECT transcript_id, min(mark_no) AS first FROM marks GROUP BY 1) f USING (transcript_id)""")
def segment_chapter_asof_join(t):
    joined = S.assign_chapters(t.fx_segments, C.chapter_marks_from_starts(t.fx_chapter_marks))
    return joined.select("transcript_id", "seq", "start_s", "chapter_no")


def _flags(source: str, keys: str) -> str:
    w, m = f"sum(len({D.words('text')}))", "sum(len(regexp_extract_all(text, '[.!?]')))"
    return rf"""SELECT {keys}, {w} AS words, {w} >= 20 AND {m} / {w} >= 0.02 AS punctuated,
        count(*) >= 3 AND count_if(regexp_matches(text, '[.!?…"”)][\s\p{{Z}}]*$')) / count(*) >= 0.6 AS sentence_segmented,
        count(*) >= 2 AND bool_or(duration_s > 0) AS timed, bool_or(coalesce(speaker, '') <> '') AS has_speakers FROM {source} GROUP BY {keys}"""


@query("transcript_shape_flags", "fx_lines", _flags("fx_lines", "transcript_id"))
def transcript_shape_flags(t):
    return S.shape_flags(t.fx_lines)


@query("transcript_stats", "fx_segments", f"""
    f AS ({_flags('fx_segments', 'transcript_id')}),
    lang AS (SELECT transcript_id, CASE WHEN transcript_id % 3 = 0 THEN NULL ELSE 'en' END AS language FROM (SELECT DISTINCT transcript_id FROM fx_segments) WHERE transcript_id % 10 <> 7)
    SELECT transcript_id, words, punctuated, language, greatest(1, cast(round_even(words / 200, 0) AS bigint)) AS reading_min FROM f LEFT JOIN lang USING (transcript_id)""")
def transcript_stats(t):
    language = F.when(F.col("transcript_id") % 3 == 0, None).otherwise("en").alias("language")
    languages = t.fx_segments.select("transcript_id").distinct().filter("transcript_id % 10 <> 7").select("transcript_id", language)
    return S.transcript_stats(t.fx_segments, languages)


SPOKEN = f"spoken AS (SELECT * REPLACE ({D.strip('text')} AS text) FROM fx_lines WHERE NOT {D.blank('text')})"
TURNS = f"""{SPOKEN},
    ordered AS (SELECT *, row_number() OVER o AS n, lag(seq) OVER o AS pq, lag(speaker) OVER o AS ps, lag(start_s + duration_s) OVER o AS pe FROM spoken WINDOW o AS (PARTITION BY transcript_id ORDER BY seq)),
    turned AS (SELECT *, sum((pq IS NOT NULL AND ps IS DISTINCT FROM speaker)::int) OVER (PARTITION BY transcript_id ORDER BY seq) AS turn FROM ordered)"""


@query("speaker_turn_islands", "fx_lines", f"{TURNS} SELECT transcript_id, seq, speaker, cast(turn AS bigint) AS turn FROM turned")
def speaker_turn_islands(t):
    return S.speaker_turns(t.fx_lines).select("transcript_id", "seq", "speaker", "turn")


def _fold(source: str, keys: str, same: str) -> str:
    """Pause paragraphs by walking the segments one after the other."""
    return f"""
    walk AS (SELECT {keys}, seq, n, text, speaker, len(text) + 1 AS size, 0 AS para FROM {source} WHERE n = 1
        UNION ALL SELECT {same}, o.seq, o.n, o.text, o.speaker,
            CASE WHEN c.cut THEN 0 ELSE w.size END + len(o.text) + 1, w.para + c.cut::int
        FROM walk w JOIN {source} o ON o.transcript_id = w.transcript_id AND o.n = w.n + 1 {'AND o.chapter_no = w.chapter_no' if 'chapter_no' in keys else ''},
        LATERAL (SELECT o.ps IS DISTINCT FROM o.speaker OR (w.size >= 200 AND (w.size >= 900 OR o.start_s - o.pe >= 0.75)) AS cut) c),
    paras AS (SELECT {keys}, cast(para AS bigint) AS para_no, min_by(speaker, seq) AS speaker, string_agg(text, ' ' ORDER BY seq) AS text FROM walk GROUP BY ALL)"""


PARAS = f"{TURNS}, {_fold('ordered', 'transcript_id', 'o.transcript_id')}"


@query("pause_paragraphs", "fx_lines", f"{PARAS} SELECT transcript_id, para_no, speaker, text FROM paras")
def pause_paragraphs(t):
    return S.pause_paragraphs(t.fx_lines).drop("opens")


@query("fixed_line_groups", "fx_lines", f"""{SPOKEN},
    g AS (SELECT *, cast(floor((row_number() OVER (PARTITION BY transcript_id ORDER BY seq) - 1) / 8) AS bigint) AS para_no FROM spoken)
    SELECT transcript_id, para_no, string_agg(text, ' ' ORDER BY seq) AS text FROM g GROUP BY ALL""")
def fixed_line_groups(t):
    return S.fixed_groups(t.fx_lines)


NAMES = """names AS (SELECT DISTINCT transcript_id, speaker, CASE WHEN transcript_id % 4 = 3 THEN ' ' ELSE ' Ms ' || speaker END AS name FROM fx_lines WHERE speaker IN ('user', 'speaker_1') AND transcript_id % 2 = 1)"""


def speaker_names(t):
    name = F.when(F.col("transcript_id") % 4 == 3, " ").otherwise(F.concat(F.lit(" Ms "), "speaker"))
    return t.fx_lines.filter("speaker IN ('user', 'speaker_1') AND transcript_id % 2 = 1").select(
        "transcript_id", "speaker", name.alias("name")).distinct()


LABEL = "coalesce(nullif(trim(n.name), ''), 'Speaker ' || nullif(regexp_extract(%s, '([0-9]+)$', 1), ''), nullif(%s, ''), 'Speaker')"


@query("speaker_name_mapping", "fx_lines", f"""{NAMES}
    SELECT s.transcript_id, s.seq, s.speaker, {LABEL % ('s.speaker', 's.speaker')} AS label
    FROM fx_lines s LEFT JOIN names n ON n.transcript_id = s.transcript_id AND n.speaker = s.speaker""")
def speaker_name_mapping(t):
    rows = S.with_speaker_labels(t.fx_lines, speaker_names(t), F.lit("Speaker"))
    return rows.select("transcript_id", "seq", "speaker", "label")


DIALOGUE = f"""{PARAS}, {NAMES},
    opened AS (SELECT *, lag(para_no) OVER o IS NULL OR lag(speaker) OVER o IS DISTINCT FROM speaker AS opens FROM paras WINDOW o AS (PARTITION BY transcript_id ORDER BY para_no)),
    talk AS (SELECT p.transcript_id, p.para_no, CASE WHEN opens AND p.speaker IS NOT NULL THEN '**' || {LABEL % ('p.speaker', 'p.speaker')} || ':** ' || p.text ELSE p.text END AS text
             FROM opened p LEFT JOIN names n ON n.transcript_id = p.transcript_id AND n.speaker = p.speaker)"""


@query("dialogue_rendering", "fx_lines", f"{DIALOGUE} SELECT * FROM talk")
def dialogue_rendering(t):
    return S.dialogue(S.pause_paragraphs(t.fx_lines), speaker_names(t), F.lit("Speaker"))


@query("distinct_speakers", "fx_lines", """
    f AS (SELECT transcript_id, speaker, min(seq) AS first FROM fx_lines WHERE speaker IS NOT NULL AND speaker <> '' GROUP BY ALL)
    SELECT transcript_id, speaker, row_number() OVER (PARTITION BY transcript_id ORDER BY first) AS rank, count(*) OVER (PARTITION BY transcript_id) >= 2 AS multi_speaker FROM f""")
def distinct_speakers(t):
    return S.distinct_speakers(t.fx_lines)


@query("dialogue_sample", "fx_lines", f"""{SPOKEN},
    kept AS (SELECT *, coalesce(nullif(speaker, ''), 'speaker_?') AS who FROM spoken
             QUALIFY coalesce(sum(len(text)) OVER (PARTITION BY transcript_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 4000),
    flagged AS (SELECT *, lag(who) OVER (PARTITION BY transcript_id ORDER BY seq) IS DISTINCT FROM who AS opens FROM kept),
    turned AS (SELECT *, sum(opens::int) OVER (PARTITION BY transcript_id ORDER BY seq) AS turn FROM flagged),
    lines AS (SELECT transcript_id, turn, min(who) || ': ' || string_agg(text, ' ' ORDER BY seq) AS line FROM turned GROUP BY ALL)
    SELECT transcript_id, string_agg(line, chr(10) ORDER BY turn) AS sample FROM lines GROUP BY ALL""")
def dialogue_sample(t):
    return S.dialogue_sample(t.fx_lines)


def routed_lines(t):
    """Lines with a speaker in a third of the transcripts only, so that every route is taken."""
    return t.fx_lines.withColumn("speaker", F.when(F.col("transcript_id") % 3 == 0, F.col("speaker"))).withColumn(
        "text", F.when(F.col("transcript_id") % 5 == 1, F.regexp_replace("text", "[.!?]", "")).when(
            F.col("transcript_id") % 5 == 2, F.concat("text", F.lit(" and"))).otherwise(F.col("text")))


@query("transcript_routing", "fx_lines fx_chapter_marks", rf"""{MARKS}, {NAMES},
    lined AS (SELECT * REPLACE (CASE WHEN transcript_id % 3 = 0 THEN speaker END AS speaker,
        CASE WHEN transcript_id % 5 = 1 THEN regexp_replace(text, '[.!?]', '', 'g') WHEN transcript_id % 5 = 2 THEN text || ' and' ELSE text END AS text) FROM fx_lines),
    placed AS (SELECT s.*, CASE WHEN f.first IS NULL THEN -1 ELSE coalesce((SELECT max(mark_no) FROM marks m WHERE m.transcript_id = s.transcript_id AND m.start_s <= s.start_s), f.first) END AS chapter_no
        FROM lined s LEFT JOIN (SELECT transcript_id, min(mark_no) AS first FROM marks GROUP BY 1) f USING (transcript_id)),
    spoken AS (SELECT * REPLACE ({D.strip('text')} AS text) FROM placed WHERE NOT {D.blank('text')}),
    flags AS ({_flags('placed', 'transcript_id, chapter_no')}),
    clean AS ({_flags('spoken', 'transcript_id, chapter_no')}),
    routes AS (SELECT f.transcript_id, f.chapter_no, CASE WHEN f.chapter_no = -1 AND f.has_speakers THEN 'dialogue' WHEN f.sentence_segmented AND f.timed THEN 'pauses' WHEN c.punctuated THEN 'sentences' ELSE 'fixed' END AS kind
        FROM flags f JOIN clean c USING (transcript_id, chapter_no)),
    ordered AS (SELECT s.*, r.kind, row_number() OVER o AS n, lag(seq) OVER o AS pq, lag(speaker) OVER o AS ps, lag(start_s + duration_s) OVER o AS pe FROM spoken s JOIN routes r USING (transcript_id, chapter_no)
        WINDOW o AS (PARTITION BY transcript_id, chapter_no ORDER BY seq)),
    {_fold('(SELECT * FROM ordered)', 'transcript_id, chapter_no', 'o.transcript_id, o.chapter_no')},
    opened AS (SELECT p.*, r.kind, lag(para_no) OVER o IS NULL OR lag(speaker) OVER o IS DISTINCT FROM speaker AS opens FROM paras p JOIN routes r USING (transcript_id, chapter_no) WINDOW o AS (PARTITION BY transcript_id, chapter_no ORDER BY para_no)),
    paused AS (SELECT p.transcript_id, p.chapter_no, p.para_no, kind, CASE WHEN kind = 'dialogue' AND opens AND p.speaker IS NOT NULL THEN '**' || {LABEL % ('p.speaker', 'p.speaker')} || ':** ' || p.text ELSE p.text END AS text
        FROM opened p LEFT JOIN names n ON n.transcript_id = p.transcript_id AND n.speaker = p.speaker WHERE kind IN ('dialogue', 'pauses')),
    fixed AS (SELECT transcript_id, chapter_no, cast(floor((n - 1) / 8) AS bigint) AS para_no, kind, string_agg(text, ' ' ORDER BY seq) AS text FROM ordered WHERE kind = 'fixed' GROUP BY ALL),
    whole AS (SELECT transcript_id, chapter_no, string_agg(text, ' ' ORDER BY seq) AS text FROM ordered WHERE kind = 'sentences' GROUP BY ALL),
    sents AS (SELECT transcript_id, chapter_no, unnest(list_transform(list_filter(list_transform(string_split(regexp_replace(text, '([.!?…])[\s]+', '\1' || chr(1), 'g'), chr(1)), lambda x: {D.strip('x')}), lambda x: x <> ''), lambda x, i: {{'t': x, 'i': i}})) AS u FROM whole),
    swalk AS (SELECT transcript_id, chapter_no, u.i AS i, u.t AS t, len(u.t) AS size, 0 AS para FROM sents WHERE u.i = 1
        UNION ALL SELECT s.transcript_id, s.chapter_no, s.u.i, s.u.t, CASE WHEN w.size >= 800 THEN 0 ELSE w.size END + len(s.u.t), w.para + (w.size >= 800)::int
        FROM swalk w JOIN sents s ON s.transcript_id = w.transcript_id AND s.chapter_no = w.chapter_no AND s.u.i = w.i + 1)
    SELECT * FROM paused UNION ALL SELECT * FROM fixed
    UNION ALL SELECT transcript_id, chapter_no, cast(para AS bigint), 'sentences', string_agg(t, ' ' ORDER BY i) FROM swalk GROUP BY ALL
    UNION ALL SELECT s.transcript_id, s.chapter_no, -1, 'heading', '## ' || {D.escape_tags('title')} FROM marks m JOIN (SELECT DISTINCT transcript_id, chapter_no FROM spoken) s ON s.transcript_id = m.transcript_id AND s.chapter_no = m.mark_no""")
def transcript_routing(t):
    marks = C.chapter_marks_from_starts(t.fx_chapter_marks)
    return S.transcript_paragraphs(routed_lines(t), marks, speaker_names(t), F.lit("Speaker"))


@query("chapter_marks_with_times", "fx_chapter_marks", "SELECT transcript_id, mark_no, trim(title) AS title, start_s, total_s AS end_s FROM fx_chapter_marks WHERE title IS NOT NULL")
def chapter_marks_with_times(t):
    return C.chapter_marks_with_ends(t.fx_chapter_marks.withColumnRenamed("total_s", "end_s"))


@query("sentence_paragraphs", "fx_lines", rf"""{SPOKEN},
    whole AS (SELECT transcript_id, string_agg(text, ' ' ORDER BY seq) AS text FROM spoken GROUP BY ALL),
    sents AS (SELECT transcript_id, unnest(list_transform(list_filter(list_transform(string_split(regexp_replace(text, '([.!?…])[\s]+', '\1' || chr(1), 'g'), chr(1)), lambda x: {D.strip('x')}), lambda x: x <> ''), lambda x, i: {{'t': x, 'i': i}})) AS u FROM whole),
    swalk AS (SELECT transcript_id, u.i AS i, u.t AS t, len(u.t) AS size, 0 AS para FROM sents WHERE u.i = 1
        UNION ALL SELECT s.transcript_id, s.u.i, s.u.t, CASE WHEN w.size >= 800 THEN 0 ELSE w.size END + len(s.u.t), w.para + (w.size >= 800)::int
        FROM swalk w JOIN sents s ON s.transcript_id = w.transcript_id AND s.u.i = w.i + 1)
    SELECT transcript_id, cast(para AS bigint) AS para_no, string_agg(t, ' ' ORDER BY i) AS text FROM swalk GROUP BY ALL""")
def sentence_paragraphs(t):
    return S.sentence_paragraphs(t.fx_lines)
