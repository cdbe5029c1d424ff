"""Job, review, cost and store queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafmill.operators import costs as C
from leafmill.operators import jobs as J
from leafmill.operators import review as R
from leafmill.operators import stores as K
from leafmill.plans import duck as D
from leafmill.plans.registry import query
from leafmill.shared import shared_folder
from leafmill.sources.buckets import BucketTable

FLAGS = """flagged AS (SELECT *, item_type = 'youtube' AND coalesce(has_transcript, false) AND is_punctuated IS NOT DISTINCT FROM false AS raw_captions,
    item_type = 'podcast' AND has_transcript IS DISTINCT FROM true AS needs_transcription, item_type IN ('youtube', 'blog') AS polishable,
    CASE WHEN item_type = 'podcast' AND has_transcript IS DISTINCT FROM true THEN job_id % 2 = 0
         ELSE paywalled OR unreadable OR (item_type = 'youtube' AND has_transcript IS NOT DISTINCT FROM false) END AS left_out FROM fx_items)"""


@query("review_predicates", "fx_items", f"{FLAGS} SELECT id, raw_captions, needs_transcription, left_out, polishable FROM flagged")
def review_predicates(t):
    flagged = R.with_review_flags(t.fx_items, F.col("job_id") % 2 == 0)
    return flagged.select("id", "raw_captions", "needs_transcription", "left_out", "polishable")


@query("skip_reasons", "fx_items", """
    SELECT id, CASE WHEN item_type = 'blog' AND paywalled THEN 'Behind a paywall, only a teaser is public.'
        WHEN item_type = 'youtube' AND has_transcript IS DISTINCT FROM true THEN 'No transcript available.'
        WHEN item_type = 'podcast' AND has_transcript IS DISTINCT FROM true THEN 'Transcription unavailable.'
        WHEN unreadable THEN 'No readable content.' END AS reason FROM fx_items""")
def skip_reasons(t):
    has_text = (F.col("item_type") == "blog") | F.col("has_transcript").eqNullSafe(True)
    reason = J.skip_reason(F.col("item_type"), has_text, F.col("unreadable"), F.col("paywalled"))
    return t.fx_items.select("id", reason.alias("reason"))


STATES = """states AS (SELECT job_id, item_id, state, note FROM fx_state_events QUALIFY row_number() OVER (PARTITION BY job_id, item_id ORDER BY ts_us DESC, event_id DESC) = 1)"""


@query("latest_item_state", "fx_state_events", f"{STATES} SELECT * FROM states")
def latest_item_state(t):
    return J.latest_states(t.fx_state_events)


@query("job_progress", "fx_state_events", f"{STATES} SELECT job_id, count_if(state IN ('done', 'skipped', 'failed')) AS finished, count(*) AS total FROM states GROUP BY 1")
def job_progress(t):
    return J.progress(J.latest_states(t.fx_state_events))


@query("compile_outcomes", "fx_state_events", f"""{STATES},
    c AS (SELECT job_id, count_if(state = 'done') AS chapters, count_if(state = 'skipped') AS skipped, count_if(state = 'failed') AS failed,
                 count_if(state = 'failed' AND note = 'rate limited') AS rate_limited FROM states GROUP BY 1)
    SELECT *, CASE WHEN chapters = 0 THEN CASE WHEN job_id % 7 = 3 THEN 'stopped' WHEN rate_limited > 0 THEN 'rate_limited' WHEN failed > 0 THEN 'nothing_built' ELSE 'no_content' END END AS failure FROM c""")
def compile_outcomes(t):
    states = J.latest_states(t.fx_state_events)
    stopped = t.fx_state_events.select("job_id").distinct().filter("job_id % 7 = 3")
    return J.compile_outcomes(states, stopped)


SUMMARY = f"""
    counts AS (SELECT job_id, source_index, count(*) AS n FROM fx_items GROUP BY ALL),
    bysource AS (SELECT s.job_id, s.source_index, CASE WHEN problem IS NULL THEN coalesce(n, 0) ELSE 0 END AS item_count,
        CASE WHEN problem = 'refused' THEN '{J.BUSY.replace("'", "''")}' WHEN problem IS NOT NULL THEN '{J.UNREADABLE.replace("'", "''")}' END AS error, problem FROM fx_sources s LEFT JOIN counts USING (job_id, source_index)),
    byjob AS (SELECT job_id, sum(item_count) AS items, bool_and(coalesce(problem = 'refused', false)) AS refused, bool_or(problem IS NULL) AS clean FROM bysource GROUP BY 1)"""


@query("discovery_by_source", "fx_sources fx_items", f"{SUMMARY} SELECT job_id, source_index, item_count, error FROM bysource")
def discovery_by_source(t):
    return J.discovery_summary(t.fx_sources, t.fx_items)[0]


@query("discovery_by_job", "fx_sources fx_items", f"""{SUMMARY} SELECT job_id, items, CASE WHEN items = 0 THEN 'failed' ELSE 'reviewing' END AS status,
    CASE WHEN items = 0 THEN CASE WHEN refused THEN '{J.BUSY.replace("'", "''")}' WHEN clean THEN '{J.NOTHING_FOUND}' ELSE '{J.NOT_READ.replace("'", "''")}' END END AS error FROM byjob""")
def discovery_by_job(t):
    return J.discovery_summary(t.fx_sources, t.fx_items)[1]


@query("review_counts", "fx_items", f"""{FLAGS.replace('job_id % 2 = 0', 'true')},
    s AS (SELECT *, CASE doc_id % 4 WHEN 0 THEN 'done' WHEN 1 THEN 'failed' WHEN 2 THEN 'pending' END AS state FROM flagged)
    SELECT job_id, source_index, count_if(selected) AS picked, count_if(selected AND NOT left_out) AS included, count_if(selected AND raw_captions) AS raw,
           count_if(selected AND polishable) AS polishable, count_if(state IN ('done', 'skipped', 'failed')) AS finished FROM s GROUP BY ALL""")
def review_counts(t):
    k = F.col("doc_id") % 4
    states = t.fx_items.select("id", F.when(k == 0, "done").when(k == 1, "failed").when(k == 2, "pending").alias("state"))
    return R.review_counts(t.fx_items, states, stt_missing=True)


@query("source_caps_and_preselection", "fx_items", """
    r AS (SELECT *, row_number() OVER (PARTITION BY job_id, source_index ORDER BY item_index) AS place, bool_or(NOT uncertain) OVER s AS any_sure, count(*) OVER s >= 2 AS several
          FROM fx_items WINDOW s AS (PARTITION BY job_id, source_index))
    SELECT id, NOT uncertain AND set_aside IS NULL AND (item_type <> 'podcast' OR item_index < 10) AS preselected, NOT uncertain OR NOT any_sure AS sure,
           item_type = 'youtube' AND place <= 50 AS probed, several AND place <= 50 AS judged FROM r WHERE place <= 250""")
def source_caps_and_preselection(t):
    return R.preselected(t.fx_items)


@query("source_caps_reached", "fx_items", """
    i AS (SELECT * REPLACE (doc_id // 600 AS job_id, 0::BIGINT AS source_index, doc_id % 600 AS item_index) FROM fx_items),
    r AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY item_index) AS place FROM i QUALIFY place <= 250),
    l AS (SELECT job_id, bool_or(NOT uncertain) AS any_sure, count(*) >= 2 AS several FROM r GROUP BY 1)
    SELECT id, NOT uncertain AND set_aside IS NULL AND (item_type <> 'podcast' OR item_index < 10) AS preselected, NOT uncertain OR NOT any_sure AS sure,
           item_type = 'youtube' AND place <= 50 AS probed, several AND place <= 50 AS judged FROM r JOIN l USING (job_id)""")
def source_caps_reached(t):
    """Sources of 600 items, so that both limits cut."""
    place = {"job_id": F.floor(F.col("doc_id") / 600).cast("bigint"), "source_index": F.lit(0).cast("bigint"), "item_index": F.col("doc_id") % 600}
    return R.preselected(t.fx_items.withColumns(place))


@query("ordered_selection", "fx_items fx_sources", """
    SELECT i.job_id, i.id, row_number() OVER (PARTITION BY i.job_id ORDER BY (i.source_index * 3 + i.job_id) % 5, i.item_index) AS chapter_no
    FROM fx_items i JOIN fx_sources s USING (job_id, source_index) WHERE i.selected""")
def ordered_selection(t):
    order = t.fx_sources.select("job_id", "source_index", ((F.col("source_index") * 3 + F.col("job_id")) % 5).alias("source_rank"))
    return R.ordered_selection(t.fx_items, order)


@query("compile_order", "fx_items", """
    SELECT job_id, id, row_number() OVER (PARTITION BY job_id ORDER BY 97 - doc_id % 97, source_index, item_index) AS place, 'pending' AS compile_state FROM fx_items WHERE selected""")
def compile_order(t):
    picks = t.fx_items.filter("selected").select("job_id", "id", (97 - F.col("doc_id") % 97).alias("position"))
    return J.compile_order(t.fx_items, picks)


@query("selection_stats", "fx_items", """
    roles AS (SELECT DISTINCT job_id, r.role FROM fx_items, (VALUES ('copyedit', 2), ('sections', 3), ('punctuate', 5)) r(role, k) WHERE job_id % r.k = 0),
    rc AS (SELECT job_id, count(*) AS roles FROM roles GROUP BY 1),
    p AS (SELECT job_id, count(*) AS picked, count_if(item_type = 'youtube') AS youtube, count_if(item_type = 'podcast') AS podcast, count_if(item_type = 'blog') AS blog FROM fx_items WHERE selected GROUP BY 1)
    SELECT p.*, coalesce(roles, 0) AS roles, CASE WHEN roles > 0 THEN 'server/m' || (job_id % 4) END AS model FROM p LEFT JOIN rc USING (job_id)""")
def selection_stats(t):
    jobs = t.fx_items.select("job_id").distinct()
    models = jobs.select("job_id", F.concat(F.lit("server/m"), F.col("job_id") % 4).alias("model"))
    return J.selection_stats(t.fx_items, job_roles(jobs), models)


def job_roles(jobs):
    roles = None
    for role, k in (("copyedit", 2), ("sections", 3), ("punctuate", 5)):
        part = jobs.filter(F.col("job_id") % k == 0).select("job_id", F.lit(role).alias("role"))
        roles = part if roles is None else roles.unionByName(part)
    return roles


RATES = """
    held AS (SELECT DISTINCT job_id, CASE job_id % 4 WHEN 0 THEN 'openai' WHEN 1 THEN 'mistral' WHEN 2 THEN 'elevenlabs' END AS llm_provider,
                    CASE job_id % 3 WHEN 0 THEN 'mistral' WHEN 1 THEN 'openrouter' END AS stt_provider FROM fx_items),
    rates AS (SELECT job_id, job_id % 5 <> 4 OR llm_provider IS NOT NULL AS llm_available, job_id % 6 <> 5 OR stt_provider IS NOT NULL AS stt_available,
        coalesce(CASE llm_provider WHEN 'openai' THEN 0.15 WHEN 'mistral' THEN 0.20 WHEN 'openrouter' THEN 0.15 END, 1.0)::double AS llm_in,
        coalesce(CASE llm_provider WHEN 'openai' THEN 0.60 WHEN 'mistral' THEN 0.60 WHEN 'openrouter' THEN 0.60 END, 2.0)::double AS llm_out,
        coalesce(CASE stt_provider WHEN 'openai' THEN 0.006 WHEN 'mistral' THEN 0.003 WHEN 'elevenlabs' THEN 0.0067 END, 0.01)::double AS stt_per_minute FROM held)"""


def rates(t):
    k, s = F.col("job_id") % 4, F.col("job_id") % 3
    held = t.fx_items.select("job_id").distinct().select(
        "job_id", F.when(k == 0, "openai").when(k == 1, "mistral").when(k == 2, "elevenlabs").alias("llm_provider"),
        F.when(s == 0, "mistral").when(s == 1, "openrouter").alias("stt_provider"),
        (F.col("job_id") % 5 != 4).alias("server_llm"), (F.col("job_id") % 6 != 5).alias("server_stt"),
        F.lit(1.0).alias("server_in"), F.lit(2.0).alias("server_out"), F.lit(0.01).alias("server_minute"),
    )
    return C.effective_rates(held)


@query("rate_join", "fx_items", f"{RATES} SELECT * FROM rates")
def rate_join(t):
    return rates(t)


COSTS = f"""{FLAGS}, {RATES},
    c AS (SELECT i.job_id, i.id, CASE WHEN needs_transcription AND stt_available THEN coalesce(duration_s, 0) / 60 * stt_per_minute ELSE 0 END AS stt,
        CASE WHEN llm_available AND has_transcript IS DISTINCT FROM false AND item_type <> 'podcast' THEN
            ((job_id % 2 = 0)::int + (job_id % 3 = 0)::int + CASE WHEN raw_captions THEN (job_id % 5 = 0)::int ELSE 0 END)
            * (CASE WHEN item_type = 'youtube' THEN coalesce(word_count, 0) ELSE coalesce(size_chars, 0) / 6 END) * 1.33::double * ((llm_in + llm_out) / 1e6) ELSE 0 END AS llm
        FROM flagged i JOIN rates USING (job_id) WHERE selected)"""


@query("cost_per_item", "fx_items", f"{COSTS} SELECT job_id, id, stt, llm FROM c")
def cost_per_item(t):
    return R.item_costs(t.fx_items, rates(t), job_roles(t.fx_items.select("job_id").distinct()))


@query("cost_per_job", "fx_items", f"""{COSTS},
    s AS (SELECT job_id, round(sum(stt), 6) AS stt, round(sum(llm), 6) AS llm, round(sum(stt + llm), 6) AS total FROM c GROUP BY 1)
    SELECT *, CASE WHEN total <= 0 THEN NULL WHEN total < 0.01 THEN '< $0.01' ELSE '~$' || format('{{:.2f}}', total) END AS label FROM s""")
def cost_per_job(t):
    return R.job_costs(R.item_costs(t.fx_items, rates(t), job_roles(t.fx_items.select("job_id").distinct())))


CUT = 1705276800000000
CACHE = f"""
    cache AS (SELECT key, max(ts_us) AS stored FROM fx_calls WHERE ts_us < {CUT} AND status IN (200, 404) GROUP BY 1),
    req AS (SELECT r.*, coalesce(r.ts_us - c.stored < {7 * 86400} * 1000000::bigint, false) AS hit FROM fx_calls r LEFT JOIN cache c USING (key) WHERE ts_us >= {CUT})"""


def cached_requests(t):
    calls = t.fx_calls
    cache = K.cache_store(calls.filter(F.col("ts_us") < CUT))
    return K.split_by_cache(calls.filter(F.col("ts_us") >= CUT), cache, K.DETAIL_TTL_S)


@query("cache_hit_miss_split", "fx_calls", f"""{CACHE} SELECT event_id, hit, sha256(to_json({{'provider': provider, 'endpoint': endpoint, 'key': key}})) AS request_key FROM req""")
def cache_hit_miss_split(t):
    return cached_requests(t).select("event_id", "hit", K.request_key("provider", "endpoint", "key").alias("request_key"))


@query("billable_misses", "fx_calls", f"""{CACHE} SELECT key, event_id, cost FROM req WHERE NOT hit QUALIFY row_number() OVER (PARTITION BY key ORDER BY ts_us, event_id) = 1""")
def billable_misses(t):
    return K.billable(cached_requests(t)).select("key", "event_id", "cost")


@query("paid_call_spend", "fx_calls", f"""{CACHE},
    b AS (SELECT * FROM req WHERE NOT hit QUALIFY row_number() OVER (PARTITION BY key ORDER BY ts_us, event_id) = 1)
    SELECT provider, endpoint, sum(cost) AS cost, count(*) AS calls FROM b GROUP BY ROLLUP (provider, endpoint)""")
def paid_call_spend(t):
    return C.paid_spend(K.billable(cached_requests(t)))


@query("item_list", "fx_items fx_sources", """
    SELECT i.job_id, row_number() OVER (PARTITION BY i.job_id ORDER BY i.source_index, i.item_index) AS number, CASE item_type WHEN 'youtube' THEN 'video' WHEN 'podcast' THEN 'episode' ELSE 'article' END AS type,
           i.title, i.url, coalesce(nullif(s.name, ''), s.url) AS source, duration_s, CASE WHEN word_count IS NOT NULL THEN greatest(1, cast(round_even(word_count / 200, 0) AS bigint)) END AS reading_time_min, has_transcript
    FROM fx_items i LEFT JOIN fx_sources s USING (job_id, source_index)""")
def item_list(t):
    return J.item_list(t.fx_items, t.fx_sources)


@query("store_upsert", "fx_calls", """
    SELECT key, status, cost, provider, ts_us, event_id FROM fx_calls QUALIFY row_number() OVER (PARTITION BY key ORDER BY ts_us DESC, event_id DESC) = 1""")
def store_upsert(t):
    rows = t.fx_calls.select("key", "status", "cost", "provider", "ts_us", "event_id")
    return K.upsert(rows.filter(F.col("ts_us") < CUT), rows.filter(F.col("ts_us") >= CUT), ["key"], ["ts_us", "event_id"])


@query("store_upsert_buckets", "fx_calls", """
    SELECT key, status, cost, provider, ts_us, event_id FROM fx_calls QUALIFY row_number() OVER (PARTITION BY key ORDER BY ts_us DESC, event_id DESC) = 1""")
def store_upsert_buckets(t):
    """The same store kept in buckets: the calls before the cut, then those after it as two changes."""
    rows = t.fx_calls.select("key", "status", "cost", "provider", "ts_us", "event_id")
    store = BucketTable(t.spark, shared_folder(t.spark, "store"), rows.schema, ["key"], ["ts_us", "event_id"], 16)
    store.upsert(rows.filter(F.col("ts_us") < CUT))
    for part in range(2):
        store.upsert(rows.filter((F.col("ts_us") >= CUT) & (F.col("event_id") % 2 == part)))
    return store.read()


@query("guarded_item_update", "fx_items", """
    SELECT job_id, id, CASE WHEN item_index % 3 = 0 AND job_id % 2 = 1 THEN 'Renamed ' || id ELSE title END AS title FROM fx_items""")
def guarded_item_update(t):
    jobs = t.fx_items.select("job_id").distinct().select(
        "job_id", F.when(F.col("job_id") % 2 == 1, "reviewing").otherwise("processing").alias("status"))
    changes = t.fx_items.filter("item_index % 3 = 0").select("job_id", "id", F.concat(F.lit("Renamed "), "id").alias("title"))
    return K.guarded_update(t.fx_items.select("job_id", "id", "title"), changes, jobs, "title")


@query("legacy_item_migration", "fx_items", f"""
    store AS (SELECT job_id, id, '{{}}' AS item, source_index, item_index, selected FROM fx_items WHERE doc_id % 3 = 0)
    SELECT * FROM store UNION ALL SELECT job_id, id, cast(to_json({{{', '.join(f"'{c}': {c}" for c in K.ITEM_FIELDS)}}}) as varchar), source_index, item_index, selected
    FROM fx_items WHERE doc_id % 2 = 0 AND id NOT IN (SELECT id FROM store)""")
def legacy_item_migration(t):
    store = t.fx_items.filter("doc_id % 3 = 0").select("job_id", "id", F.lit("{}").alias("item"), "source_index", "item_index", "selected")
    return K.merge_legacy_items(store, t.fx_items.filter("doc_id % 2 = 0"))


@query("transcript_cache_merge", "fx_transcripts", """
    a AS (SELECT key, language, stored_at, 0 AS r FROM fx_transcripts WHERE stored_at = 0 AND length(key) % 2 = 0
        UNION ALL SELECT key, language, stored_at, 1 FROM fx_transcripts WHERE stored_at = 1 AND key NOT LIKE 'http%'
        UNION ALL SELECT key, language, stored_at, 2 FROM fx_transcripts WHERE stored_at = 2 AND key LIKE 'http%' AND length(language) % 2 = 0)
    SELECT key, language, stored_at FROM a QUALIFY row_number() OVER (PARTITION BY key ORDER BY r) = 1""")
def transcript_cache_merge(t):
    rows = t.fx_transcripts.select("key", "language", "stored_at")
    store = rows.filter("stored_at = 0 AND length(key) % 2 = 0")
    videos = rows.filter("stored_at = 1 AND NOT startswith(key, 'http')")
    episodes = rows.filter("stored_at = 2 AND startswith(key, 'http')").withColumn("format_version", F.when(F.length("language") % 2 == 0, 2).otherwise(1))
    return K.merge_transcript_caches(store, videos, episodes)


STALE = "stale AS (SELECT DISTINCT key FROM fx_transcripts WHERE key NOT LIKE 'http%' AND (language IN ('en', 'fr') OR language LIKE 'en-%' OR language LIKE 'fr-%'))"


@query("stale_transcript_purge", "fx_transcripts", f"{STALE} SELECT key, language, stored_at FROM fx_transcripts WHERE key NOT IN (FROM stale)")
def stale_transcript_purge(t):
    rows = t.fx_transcripts.select("key", "language", "stored_at")
    return K.purge_stale(rows, polished(t), ["en", "fr-FR"], done_version=1)[0]


@query("stale_polish_purge", "fx_transcripts", f"{STALE} SELECT key AS content_key, 'copyedit' AS roles_key, count(*) AS versions FROM fx_transcripts WHERE key NOT IN (FROM stale) GROUP BY 1")
def stale_polish_purge(t):
    rows = t.fx_transcripts.select("key", "language", "stored_at")
    return K.purge_stale(rows, polished(t), ["en", "fr-FR"], done_version=1)[1]


def polished(t):
    return t.fx_transcripts.groupBy(F.col("key").alias("content_key"), F.lit("copyedit").alias("roles_key")).agg(F.count("*").alias("versions"))


REAPED = f"""{STATES}, running AS (SELECT DISTINCT job_id FROM states WHERE job_id % 3 <> 0)"""


@query("orphan_reaper_items", "fx_state_events", f"""{REAPED}
    SELECT job_id, item_id, CASE WHEN job_id % 3 <> 0 AND state IN ('pending', 'compiling') THEN 'failed' ELSE state END AS state,
           CASE WHEN job_id % 3 <> 0 AND state IN ('pending', 'compiling') THEN '{J.ORPHAN_NOTE}' ELSE note END AS note FROM states""")
def orphan_reaper_items(t):
    return J.reap_orphans(J.latest_states(t.fx_state_events), job_status(t))[0]


@query("orphan_reaper_jobs", "fx_state_events", """
    SELECT DISTINCT job_id, CASE WHEN job_id % 3 <> 0 THEN 'failed' ELSE 'completed' END AS status FROM fx_state_events""")
def orphan_reaper_jobs(t):
    return J.reap_orphans(J.latest_states(t.fx_state_events), job_status(t))[1]


def job_status(t):
    k = F.col("job_id") % 3
    status = F.when(k == 1, "processing").when(k == 2, "discovering").otherwise("completed")
    return t.fx_state_events.select("job_id").distinct().select("job_id", status.alias("status"))


@query("duration_and_date_parse", "fx_durations", r"""
    d AS (SELECT id, day_text, CASE WHEN raw IS NULL OR list_contains(list_transform(string_split(trim(raw), ':'), lambda x: try_cast(x AS double) IS NULL), true) THEN NULL
        ELSE list_reduce(list_transform(string_split(trim(raw), ':'), lambda x: cast(trunc(try_cast(x AS double)) AS bigint)), lambda a, x: a * 60 + x, 0::bigint) END AS s FROM fx_durations)
    SELECT id, nullif(s, 0) AS seconds, CASE WHEN regexp_matches(day_text, '^[0-9]{4}-[0-9]{2}-[0-9]{2}$') THEN day_text || ' 00:00:00' WHEN regexp_matches(day_text, '^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9:]{8}$') THEN replace(day_text, 'T', ' ') END AS day FROM d""")
def duration_and_date_parse(t):
    from leafmill.functions.media import clock_to_seconds, parse_date

    return t.fx_durations.select(
        "id", clock_to_seconds("raw").alias("seconds"), F.date_format(parse_date("day_text"), "yyyy-MM-dd HH:mm:ss").alias("day"))
