"""Link, hit and verdict queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafmill.functions import urls
from leafmill.operators import hits as H
from leafmill.operators import links as L
from leafmill.operators import verdicts as V
from leafmill.plans import duck as D
from leafmill.plans.registry import query

KIND = f"""CASE WHEN (contains(lower(url), 'youtube.com/watch') AND contains(lower(url), 'v=')) OR regexp_matches(url, '{L.VIDEO_ID}') THEN 'youtube_video'
    WHEN contains(lower(url), 'list=') OR contains(lower(url), 'youtube.com/playlist') THEN 'youtube_playlist'
    WHEN regexp_matches(lower(url), 'youtube[.]com/(@|channel/|c/|user/)') THEN 'youtube_channel'
    WHEN regexp_matches({D.path('lower(url)')}, '[.](mp3|m4a|aac|ogg|opus|wav)$') THEN 'podcast' ELSE 'blog' END"""
SITE_HOME = f"""(regexp_matches(url, '(?i)^[a-z][a-z0-9+.-]*://') AND {D.home('url')}
    AND NOT (len(string_split({D.host('url')}, '.')) > 2 AND list_contains({D.lit(L.REFERENCE_SUBDOMAINS)}, string_split({D.host('url')}, '.')[1])))"""


@query("url_kind", "fx_links", f"SELECT link_id, {KIND} AS kind FROM fx_links")
def url_kind(t):
    return t.fx_links.select("link_id", L.url_kind("url").alias("kind"))


@query("url_kinds_by_host", "fx_links",
       f"SELECT {D.host('url')} AS host, {KIND} AS kind, count(*) AS links FROM fx_links GROUP BY ALL")
def url_kinds_by_host(t):
    return L.kinds_by_host(t.fx_links)


@query("video_id_and_watch_url", "fx_links", f"""
    v AS (SELECT link_id, coalesce(nullif(regexp_extract(url, '{L.VIDEO_ID}', 1), ''), regexp_extract(rtrim(url, '/'), '([^/]*)$', 1)) AS video_id FROM fx_links)
    SELECT link_id, video_id, 'https://www.youtube.com/watch?v=' || video_id AS watch_url FROM v""")
def video_id_and_watch_url(t):
    v = t.fx_links.select("link_id", L.video_id("url").alias("video_id"))
    return v.withColumn("watch_url", L.watch_url(F.col("video_id")))


@query("article_url_filter", "fx_hits", f"SELECT id, url FROM fx_hits WHERE {D.article_like('url')}")
def article_url_filter(t):
    return t.fx_hits.filter(L.is_article_like("url")).select("id", "url")


@query("canonical_source_key", "fx_hits", f"SELECT id, {D.canonical('url')} AS source_key FROM fx_hits")
def canonical_source_key(t):
    return t.fx_hits.select("id", urls.canonical_key("url").alias("source_key"))


@query("home_and_deep_page_flags", "fx_hits",
       f"SELECT id, {D.home('url')} AS home, len({D.page_segments('url')}) >= 2 AS deep FROM fx_hits")
def home_and_deep_page_flags(t):
    return t.fx_hits.select("id", urls.is_home("url").alias("home"), urls.is_deep("url").alias("deep"))


V4 = "regexp_extract(h, '^([0-9]{1,3})[.]([0-9]{1,3})[.]([0-9]{1,3})[.]([0-9]{1,3})$', %d)"
NETWORKS = " OR ".join(f"n BETWEEN {a} AND {b}" for a, b in map(L.network_bounds, L.CLOSED_NETWORKS))


@query("public_address_filter", "fx_links", f"""
    hosts AS (SELECT link_id, url, regexp_replace({D.netloc('lower(url)')}, ':[0-9]*$', '') AS h FROM fx_links),
    numbers AS (SELECT *, ((try_cast({V4 % 1} AS bigint) * 256 + try_cast({V4 % 2} AS bigint)) * 256 + try_cast({V4 % 3} AS bigint)) * 256 + try_cast({V4 % 4} AS bigint) AS n FROM hosts)
    SELECT link_id, url FROM numbers WHERE regexp_matches(url, '^https?:') AND h <> '' AND NOT starts_with(h, '[')
      AND (n IS NULL OR NOT ({NETWORKS}))""")
def public_address_filter(t):
    return t.fx_links.filter(L.is_public("url")).select("link_id", "url")


@query("wiki_flag_and_title", "fx_links", f"""
    SELECT link_id, replace(url_decode(regexp_extract({D.path('url')}, '^/wiki/([^:]+)$', 1)), '_', ' ') AS title,
           replace({D.host('url')}, '.m.wikipedia.org', '.wikipedia.org') AS host
    FROM fx_links WHERE ends_with({D.host('url')}, '.wikipedia.org') AND regexp_matches({D.path('url')}, '^/wiki/[^:]+$')""")
def wiki_flag_and_title(t):
    titled = t.fx_links.select("link_id", L.wiki_title("url").alias("title"), L.wiki_host("url").alias("host"))
    return titled.filter("title IS NOT NULL")


@query("medium_and_collection", "fx_links", f"""
    k AS (SELECT link_id, url, {KIND} AS kind FROM fx_links)
    SELECT link_id, CASE WHEN kind LIKE 'youtube%' THEN 'video' WHEN kind = 'podcast' THEN 'audio' ELSE 'text' END AS medium,
           kind IN ('youtube_playlist', 'youtube_channel') OR (kind = 'blog' AND {SITE_HOME}) AS collection FROM k""")
def medium_and_collection(t):
    kinds = t.fx_links.withColumn("kind", L.url_kind("url"))
    return kinds.select(
        "link_id", L.medium(F.col("kind")).alias("medium"), L.is_collection(F.col("kind"), "url").alias("collection")
    )


SLUG = f"regexp_replace(url_decode(regexp_extract(rtrim({D.path('url')}, '/'), '([^/]*)$', 1)), '(?i)[.](html?|php|aspx?|jsp)$', '')"
STEM = f"regexp_replace(regexp_extract({D.path('url')}, '([^/]*)/*$', 1), '(.)[.][^.]*$', '\\1')"


@query("link_labels", "fx_links", f"""
    s AS (SELECT link_id, url, name, title, {SLUG} AS slug, {STEM} AS stem,
                 CASE WHEN {D.host('url')} = 'youtu.be' OR (ends_with({D.host('url')}, 'youtube.com') AND {D.path('url')} = '/watch') THEN 'YouTube video'
                      WHEN {D.host('url')} = '' THEN url ELSE {D.host('url')} || rtrim({D.path('url')}, '/') END AS pretty FROM fx_links),
    c AS (SELECT *, coalesce(nullif(regexp_replace(slug, '([-_][0-9]{{4,}})+$', ''), ''), slug) AS cut FROM s)
    SELECT link_id, coalesce(nullif(trim(name), ''), nullif(trim(title), ''), pretty) AS source_name, pretty AS pretty_url,
           CASE WHEN rtrim({D.path('url')}, '/') = '' THEN url ELSE coalesce(nullif({D.title_case("trim(translate(cut, '-_', '  '))")}, ''), url) END AS slug_title,
           coalesce(nullif({D.title_case("trim(translate(stem, '-_', '  '))")}, ''), url) AS episode_title,
           rtrim(regexp_replace(rtrim(split_part(url, '?', 1), '/'), '/(videos|streams|shorts|featured)$', ''), '/') || '/videos' AS channel_videos_url
    FROM c""")
def link_labels(t):
    return t.fx_links.select(
        "link_id", L.source_name("name", "title", "url").alias("source_name"), L.pretty_url("url").alias("pretty_url"),
        urls.slug_title("url").alias("slug_title"), urls.stem_title("url").alias("episode_title"),
        L.channel_videos_url("url").alias("channel_videos_url"),
    )


FIRST = f"""
    keyed AS (SELECT *, {D.canonical('url')} AS source_key, {D.host('url')} AS host, {D.home('url')} AS home FROM fx_hits WHERE {D.article_like('url')}),
    firsts AS (SELECT * FROM keyed QUALIFY row_number() OVER (PARTITION BY query_id, source_key ORDER BY pos) = 1),
    deep AS (SELECT * FROM firsts QUALIFY NOT (home AND bool_or(NOT home) OVER (PARTITION BY query_id, host))),
    capped AS (SELECT *, row_number() OVER (PARTITION BY query_id, host ORDER BY pos) AS host_rank FROM deep QUALIFY host_rank <= 3)"""


@query("first_rank_dedup", "fx_hits", f"{FIRST} SELECT id, source_key FROM firsts")
def first_rank_dedup(t):
    return H.first_of_each_source(t.fx_hits).select("id", "source_key")


@query("home_vs_deep_collapse", "fx_hits", f"{FIRST} SELECT id, host FROM deep")
def home_vs_deep_collapse(t):
    return H.without_redundant_homes(H.first_of_each_source(t.fx_hits)).select("id", "host")


@query("per_host_cap", "fx_hits", f"{FIRST} SELECT id, host, host_rank FROM capped")
def per_host_cap(t):
    return H.tidy(t.fx_hits).select("id", "host", "host_rank")


SCORED = rf"""
    asked AS (SELECT query_id, list_filter(string_split(regexp_replace(lower(trim(query)), '[^\p{{L}}\p{{N}}_]+', ' ', 'g'), ' '), lambda x: x <> '') AS tokens,
                     regexp_replace(lower(trim(query)), '[^\p{{L}}\p{{N}}_]+', '', 'g') AS compact FROM fx_queries),
    labelled AS (SELECT h.*, a.tokens, a.compact, string_split({D.host('h.url')}, '.') AS labels,
                        len(list_filter(a.tokens, lambda t: contains(lower(h.title), t))) AS found FROM fx_hits h JOIN asked a USING (query_id)),
    scored AS (SELECT *, CASE WHEN len(tokens) = 0 THEN 0 ELSE
                 CASE WHEN compact <> '' AND compact = (CASE WHEN len(labels) >= 2 THEN labels[-2] ELSE labels[1] END) THEN 100 ELSE 0 END
                 + found * 5 + CASE WHEN found = len(tokens) THEN 20 ELSE 0 END
                 + CASE WHEN compact <> '' AND contains(regexp_replace(lower(coalesce(author, '')), '[^\p{{L}}\p{{N}}_]+', '', 'g'), compact) THEN 10 ELSE 0 END END AS score FROM labelled)"""


@query("keyword_rank", "fx_hits fx_queries", f"""{SCORED}
    SELECT id, score, round_even(least(3.0::double, 3.0::double * score / (len(tokens) * 5 + 20)), 2)::double AS relevance,
           row_number() OVER (PARTITION BY query_id, provider ORDER BY score DESC, pos) AS rank FROM scored""")
def keyword_rank(t):
    return H.keyword_rank(t.fx_hits, t.fx_queries).select("id", "score", "relevance", "rank")


UNIQUE = "uniq AS (SELECT * FROM fx_hits QUALIFY row_number() OVER (PARTITION BY query_id, url ORDER BY arrival, pos) = 1)"


@query("batch_merge", "fx_hits", f"""{UNIQUE},
    floors AS (SELECT *, min(coalesce(relevance, -1)) OVER (PARTITION BY query_id, arrival ORDER BY pos ROWS UNBOUNDED PRECEDING) AS floor_rel FROM uniq)
    SELECT id, row_number() OVER (PARTITION BY query_id ORDER BY floor_rel DESC, arrival, pos) AS place FROM floors""")
def batch_merge(t):
    return H.merge_batches(t.fx_hits).select("id", "place")


@query("batch_merge_frozen", "fx_hits",
       f"{UNIQUE} SELECT id, row_number() OVER (PARTITION BY query_id ORDER BY arrival, pos) AS place FROM uniq")
def batch_merge_frozen(t):
    return H.merge_batches(t.fx_hits, frozen=True).select("id", "place")


@query("union_of_providers", "fx_hits", f"{UNIQUE} SELECT query_id, id, provider, url FROM uniq")
def union_of_providers(t):
    hits = t.fx_hits
    parts = [hits.filter(F.col("provider") == p) for p in ("web", "video", "podcast")]
    union = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return H.first_of_each_url(union).select("query_id", "id", "provider", "url")


PUBLISHED = """CASE WHEN regexp_matches(published_at, '^[0-9]{4}-[0-9]{2}-[0-9]{2}') THEN epoch(cast(published_at AS timestamptz) AT TIME ZONE 'UTC') END"""
PUBLISHED_S = """CASE WHEN published_at LIKE '%+02:00' THEN epoch(cast(left(published_at, 19) AS timestamp)) - 7200
    WHEN regexp_matches(published_at, '^[0-9]{4}-[0-9]{2}-[0-9]{2}') THEN epoch(cast(left(published_at, 19) AS timestamp)) END"""


def _gap(a, b):
    levels = "['intro', 'intermediate', 'expert']"
    return f"coalesce(abs(list_position({levels}, {a}) - list_position({levels}, {b})), 0)"


@query("verdict_ranking", "fx_hits fx_verdicts fx_query_verdicts", f"""
    firsts AS (SELECT * FROM fx_verdicts QUALIFY row_number() OVER (PARTITION BY query_id, pos ORDER BY verdict_no) = 1),
    joined AS (SELECT h.id, h.query_id, h.pos, h.relevance AS own, v.compilable, v.relevance, {_gap('v.level', 'q.level')} AS gap,
                      CASE WHEN q.freshness = 'recent' THEN coalesce(-({PUBLISHED_S}), 0) ELSE 0 END AS newest
               FROM fx_hits h LEFT JOIN firsts v ON h.query_id = v.query_id AND h.pos = v.pos LEFT JOIN fx_query_verdicts q ON h.query_id = q.query_id),
    kept AS (SELECT * FROM joined WHERE compilable IS NULL OR (compilable AND relevance >= 1.0))
    SELECT id, coalesce(relevance, own) AS relevance, row_number() OVER (PARTITION BY query_id ORDER BY compilable IS NULL,
        CASE WHEN compilable IS NOT NULL THEN -relevance END, CASE WHEN compilable IS NOT NULL THEN gap END,
        CASE WHEN compilable IS NOT NULL THEN newest END, pos) AS place FROM kept""")
def verdict_ranking(t):
    ranked = V.rank_by_verdict(t.fx_hits, t.fx_verdicts, t.fx_query_verdicts)
    return ranked.select("id", "relevance", "place")


@query("original_title_overwrite", "fx_hits", """
    originals AS (SELECT id, CASE WHEN pos % 4 = 0 THEN '' ELSE 'Original ' || id END AS title FROM fx_hits WHERE provider = 'video' AND pos % 2 = 0)
    SELECT h.id, coalesce(nullif(o.title, ''), h.title) AS title FROM fx_hits h LEFT JOIN originals o ON h.id = o.id""")
def original_title_overwrite(t):
    originals = t.fx_hits.filter("provider = 'video' AND pos % 2 = 0").select(
        "id", F.when(F.col("pos") % 4 == 0, "").otherwise(F.concat(F.lit("Original "), "id")).alias("title")
    )
    return H.with_original_titles(t.fx_hits, originals).select("id", "title")


@query("search_summary", "fx_hits", f"""{FIRST},
    batches AS (SELECT DISTINCT query_id, provider, CASE WHEN query_id % 3 = 1 AND provider = 'web' THEN 'timed out' WHEN query_id % 4 = 1 AND provider = 'video' THEN 'HTTP 500' END AS error
                FROM fx_hits WHERE NOT (query_id % 5 = 4 AND provider = 'podcast')),
    f AS (SELECT query_id, count(*) AS found FROM fx_hits GROUP BY 1),
    s AS (SELECT query_id, count(*) AS shown, count_if(type = 'video') AS shown_video, count_if(type = 'web') AS shown_web, count_if(type = 'episode') AS shown_episode FROM capped GROUP BY 1),
    b AS (SELECT query_id, coalesce(string_agg(CASE WHEN error IS NOT NULL THEN provider END, ',' ORDER BY provider), '') AS failed, count(*) < 3 AS aborted FROM batches GROUP BY 1)
    SELECT query_id, coalesce(found, 0) AS found, coalesce(shown, 0) AS shown, coalesce(shown_video, 0) AS shown_video, coalesce(shown_web, 0) AS shown_web,
           coalesce(shown_episode, 0) AS shown_episode, failed, aborted FROM b LEFT JOIN f USING (query_id) LEFT JOIN s USING (query_id)""")
def search_summary(t):
    error = F.when((F.col("query_id") % 3 == 1) & (F.col("provider") == "web"), "timed out").when(
        (F.col("query_id") % 4 == 1) & (F.col("provider") == "video"), "HTTP 500")
    batches = t.fx_hits.filter("NOT (query_id % 5 = 4 AND provider = 'podcast')").select("query_id", "provider", error.alias("error")).distinct()
    return H.search_summary(t.fx_hits, H.tidy(t.fx_hits), batches, providers=3)


@query("result_sort_by_title", "fx_hits",
       "SELECT id, row_number() OVER (PARTITION BY query_id ORDER BY title COLLATE en, pos) AS place FROM fx_hits")
def result_sort_by_title(t):
    return H.sort_order(t.fx_hits, "title").select("id", "place")


@query("result_sort_by_duration", "fx_hits", """
    SELECT id, row_number() OVER (PARTITION BY query_id ORDER BY duration_s NULLS LAST, pos) AS shortest,
           row_number() OVER (PARTITION BY query_id ORDER BY duration_s DESC NULLS LAST, pos) AS longest FROM fx_hits""")
def result_sort_by_duration(t):
    up = H.sort_order(t.fx_hits, "duration-asc").select("id", F.col("place").alias("shortest"))
    down = H.sort_order(t.fx_hits, "duration-desc").select("id", F.col("place").alias("longest"))
    return up.join(down, "id")


@query("medium_filter", "fx_hits", "SELECT id FROM fx_hits WHERE type = 'episode'")
def medium_filter(t):
    return H.filter_medium(t.fx_hits, "audio").select("id")


@query("top_per_provider", "fx_hits", """
    SELECT id, row_number() OVER (PARTITION BY query_id, provider ORDER BY pos) AS rank FROM fx_hits QUALIFY rank <= 12""")
def top_per_provider(t):
    return H.top_per_provider(t.fx_hits).select("id", "rank")


@query("set_aside_reasons", "fx_items fx_item_verdicts fx_sources", """
    firsts AS (SELECT * FROM fx_item_verdicts QUALIFY row_number() OVER (PARTITION BY job_id, source_index, item_index ORDER BY verdict_no) = 1),
    r AS (SELECT i.id, CASE WHEN NOT v.compilable THEN 'Likely nothing to read' WHEN s.query IS NOT NULL AND v.relevance < 1.0 THEN 'Likely off-topic' END AS reason
          FROM fx_items i JOIN firsts v USING (job_id, source_index, item_index) LEFT JOIN fx_sources s USING (job_id, source_index))
    SELECT id, reason FROM r WHERE reason IS NOT NULL""")
def set_aside_reasons(t):
    return V.set_aside_reasons(t.fx_items, t.fx_item_verdicts, t.fx_sources)


@query("candidate_description", "fx_hits", f"""
    parts AS (SELECT id, type AS kind, title, nullif(author, '') AS channel_or_show,
        CASE WHEN duration_s <> 0 THEN cast(round_even(duration_s / 60, 0) AS bigint) END AS minutes, genre,
        strftime(make_timestamp(cast(({PUBLISHED_S}) * 1000000 AS bigint)), '%Y-%m-%d') AS date,
        nullif(left(trim(replace(coalesce(snippet, ''), chr(10), ' ')), 240), '') AS description FROM fx_hits)
    SELECT id, kind, title, channel_or_show, minutes, genre, date, description FROM parts""")
def candidate_description(t):
    described = H.describe(
        F.col("type"), F.col("title"), F.col("author"), F.col("duration_s"), F.col("genre"), F.col("published_at"), F.col("snippet")
    )
    schema = "kind STRING, title STRING, channel_or_show STRING, minutes BIGINT, genre STRING, date STRING, description STRING"
    return t.fx_hits.select("id", F.from_json(described, schema).alias("d")).select("id", "d.*")
