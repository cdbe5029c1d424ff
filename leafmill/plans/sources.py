"""Feed and caption-track queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafmill.operators import linkage as L
from leafmill.operators import tracks as T
from leafmill.operators.ordered import settle
from leafmill.plans import duck as D
from leafmill.plans.registry import query
from leafmill.sources import feeds as S

PREFERRED = ["en", "fr"]


@query("feed_flatten", "fx_feed_lines", """
    SELECT doc_id AS feed_id, pos, 'Feed ' || doc_id AS feed_title, 'Episode ' || pos || ': part ' || doc_id AS title, 'https://f.example/' || doc_id || '/' || pos AS url, NULL::VARCHAR AS author,
           strftime(make_timestamp(2024, 1, 1 + pos % 9, 10, 0, (pos % 10)::double) - CASE WHEN pos % 2 = 0 THEN INTERVAL 0 HOUR ELSE INTERVAL 2 HOUR END, '%Y-%m-%d %H:%M:%S') AS published,
           CASE WHEN pos % 3 = 1 THEN 'https://track.example/r/cdn.example/Ep-' || doc_id || '-' || pos || '.mp3?u=1' END AS audio_url, (pos % 50) * 60 + 30 AS duration_s, doc_id % 2 = 0 AND pos % 4 = 1 AS paywalled
    FROM fx_feed_lines WHERE pos < 250""")
def feed_flatten(t):
    rows = S.feed_entries(t.fx_feeds)
    return rows.withColumn("published", F.date_format("published_at", "yyyy-MM-dd HH:mm:ss")).drop("published_at", "content_html")


@query("feed_teaser_flag", "fx_feed_lines", "SELECT doc_id AS feed_id, count_if(doc_id % 2 = 0 AND pos % 4 = 1) AS teasers FROM fx_feed_lines WHERE pos < 250 GROUP BY 1")
def feed_teaser_flag(t):
    return S.feed_entries(t.fx_feeds).groupBy("feed_id").agg(F.count_if("paywalled").alias("teasers"))


@query("feed_transcript_links", "fx_feed_lines", """
    f AS (SELECT doc_id AS feed_id, pos AS wanted_id FROM fx_feed_lines WHERE pos % 6 <> 0)
    SELECT feed_id, wanted_id, k.rank, 'https://t.example/' || CASE k.rank WHEN 2 THEN 'x' ELSE wanted_id || k.ext END AS url, k.type, k.language
    FROM f, (VALUES (0, '.json', 'application/json', 'fr'), (1, '.srt', 'application/srt', 'en'), (2, '', 'text/odd', 'en')) k(rank, ext, type, language)""")
def feed_transcript_links(t):
    return S.transcript_links(t.fx_feeds, t.fx_wanted)


@query("episode_entry_match", "fx_feed_lines", "SELECT doc_id AS feed_id, pos AS wanted_id, pos FROM fx_feed_lines WHERE pos % 6 <> 0")
def episode_entry_match(t):
    entries = S.parsed_feeds(t.fx_feeds).select("feed_id", F.posexplode("f.channel.item").alias("pos", "e")).select(
        "feed_id", "pos", F.get("e.enclosure", F.lit(0))["_url"].alias("enclosure_url"), "e.title")
    return L.match_entries(t.fx_wanted, entries)


def _base(c: str) -> str:
    return f"regexp_extract(lower(trim(coalesce({c}, ''))), '^([a-z]{{2,3}})(?:[-_][a-z0-9]+)*$', 1)"


ORIGINAL = """audio AS (SELECT video_id, split_part(id, '.', 1) AS original FROM fx_audio_tracks WHERE NOT is_dubbed
    QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY NOT ends_with(lower(display_name), 'original'), NOT is_default, track_no) = 1)"""


@query("original_audio_language", "fx_audio_tracks", f"{ORIGINAL} SELECT * FROM audio")
def original_audio_language(t):
    return T.original_audio(t.fx_audio_tracks)


WITH = f"""{ORIGINAL},
    lone AS (SELECT video_id, CASE WHEN count(*) = 1 THEN max(language_code) END AS lone FROM fx_tracks WHERE kind = 'asr' GROUP BY 1),
    tr AS (SELECT t.* EXCLUDE (original), coalesce(a.original, lone) AS original FROM fx_tracks t LEFT JOIN audio a USING (video_id) LEFT JOIN lone USING (video_id))"""


@query("automatic_track_candidates", "fx_tracks fx_audio_tracks", f"""{WITH}
    SELECT video_id, track_no, language_code, kind FROM tr WHERE kind <> 'asr' OR ({_base('language_code')} <> '' AND {_base('language_code')} IN ('en', 'fr', {_base('original')}, {_base('wanted')}))""")
def automatic_track_candidates(t):
    rows = T.automatic_candidates(T.with_original(t.fx_tracks, t.fx_audio_tracks), PREFERRED)
    return rows.select("video_id", "track_no", "language_code", "kind")


FIT = f"(language_code = %s OR {_base('language_code')} = {_base('%s')})"
PICK = f"""{WITH},
    ranked AS (SELECT *, CASE WHEN coalesce(wanted, '') <> '' THEN CASE WHEN {FIT % ('wanted', 'wanted')} THEN (kind = 'asr')::int END
        WHEN {_base('original')} <> '' AND {_base('language_code')} = {_base('original')} THEN (kind = 'asr')::int
        WHEN {_base('language_code')} = 'en' THEN CASE WHEN kind = 'asr' THEN 60 ELSE 10 END WHEN {_base('language_code')} = 'fr' THEN CASE WHEN kind = 'asr' THEN 61 ELSE 11 END
        WHEN kind = 'asr' THEN 200 ELSE 300 END AS r FROM tr),
    pick AS (SELECT video_id, language_code, kind FROM ranked WHERE r IS NOT NULL QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY r, track_no) = 1)"""


@query("track_pick", "fx_tracks fx_audio_tracks", f"{PICK} SELECT * FROM pick")
def track_pick(t):
    return T.pick_track(T.with_original(t.fx_tracks, t.fx_audio_tracks), PREFERRED)


@query("track_options", "fx_tracks fx_audio_tracks", f"""{PICK},
    hand AS (SELECT DISTINCT video_id, {_base('language_code')} AS language FROM tr WHERE kind <> 'asr'),
    dubs AS (SELECT DISTINCT video_id, {_base("split_part(id, '.', 1)")} AS language FROM fx_audio_tracks WHERE is_dubbed EXCEPT SELECT * FROM hand),
    cand AS (SELECT video_id, {_base('language_code')} AS language, 0 AS g FROM pick UNION ALL SELECT video_id, language, 1 FROM hand
        UNION ALL SELECT t.video_id, d.language, 2 FROM tr t JOIN dubs d ON t.video_id = d.video_id AND {_base('t.language_code')} = d.language WHERE t.kind = 'asr'),
    u AS (SELECT video_id, language, min(g) AS g FROM cand WHERE language <> '' GROUP BY ALL),
    o AS (SELECT video_id, max({_base('original')}) AS original FROM tr GROUP BY 1)
    SELECT u.video_id, u.language, CASE WHEN o.original <> '' AND u.language = o.original THEN 'original' WHEN d.language IS NOT NULL THEN 'dubbed' WHEN o.original <> '' THEN 'translation' END AS relation, g = 0 AS is_default
    FROM u LEFT JOIN o USING (video_id) LEFT JOIN dubs d ON d.video_id = u.video_id AND d.language = u.language QUALIFY count(*) OVER (PARTITION BY u.video_id) > 1""")
def track_options(t):
    rows = settle(T.with_original(t.fx_tracks, t.fx_audio_tracks))
    return T.track_options(rows, T.pick_track(rows, PREFERRED), T.dubbed_languages(t.fx_audio_tracks))
