"""Fidelity audit, polishing and linkage queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafmill.operators import audit as A
from leafmill.operators import linkage as L
from leafmill.operators import polish as P
from leafmill.plans import duck as D
from leafmill.plans.books import TIDY
from leafmill.plans.registry import query
from leafmill.shared import settle


def _figures(text: str) -> str:
    return (f"list_distinct(list_filter(list_transform(regexp_extract_all({text}, '\\b[0-9][0-9 .,]*\\b'), "
            "lambda n: regexp_replace(n, '[ .,]', '', 'g')), lambda n: n <> ''))")


def _pattern(p: str) -> str:
    return p.replace("(?iu)", "(?i)").replace("'", "''")


LOST = f"list_sort(list_filter({_figures('src_md')}, lambda n: NOT list_contains({_figures('out_md')}, n)))"
PARAS = f"list_filter(string_split(out_md, chr(10) || chr(10)), lambda p: NOT ({D.blank('p')}))"
CARD = f"""
    m AS (SELECT pair_id, title, out_md, len({D.norm_words('src_md')}) AS src_words, len({D.norm_words('out_md')}) AS out_words,
                 list_transform({PARAS}, lambda p: len(p)) AS lens, {LOST} AS lost FROM fx_pairs),
    r AS (SELECT *, CASE WHEN src_words > 0 THEN out_words / src_words ELSE 1 END AS word_ratio, len(lens) AS paragraphs,
                 CASE WHEN len(lens) > 1 THEN list_aggregate(lens, 'stddev_pop') / list_avg(lens) ELSE 0 END AS rhythm FROM m),
    card AS (SELECT pair_id, title, src_words, out_words, word_ratio, paragraphs, rhythm, lost, list_filter([
        CASE WHEN word_ratio < 0.8 THEN 'lost ' || cast(round_even((1 - word_ratio) * 100, 0) AS bigint) || '% of the words' WHEN word_ratio > 1.1 THEN 'added ' || cast(round_even((word_ratio - 1) * 100, 0) AS bigint) || '% more words' END,
        CASE WHEN len(lost) > 0 THEN len(lost) || ' figure(s) dropped: ' || array_to_string(lost[1:5], ', ') END,
        CASE WHEN regexp_matches(out_md, '{_pattern(A.PREAMBLE)}') THEN 'opens with model preamble' END,
        CASE WHEN regexp_matches(out_md, '{_pattern(A.SOUND_CUE)}') THEN 'sound cues left in' END,
        CASE WHEN regexp_matches(out_md, '{_pattern(A.MEDIUM_TALK)}') THEN 'addresses a viewer / points at the video' END,
        CASE WHEN regexp_matches(out_md, '{_pattern(A.SPONSOR)}') THEN 'sponsor read present' END,
        CASE WHEN paragraphs > 3 AND rhythm < 0.18 THEN 'paragraphs cut by length, not by meaning' END], lambda f: f IS NOT NULL) AS flags FROM r)"""


@query("chapter_scorecard", "fx_pairs", f"""{CARD}
    SELECT pair_id, title, src_words, out_words, round(word_ratio, 9) AS word_ratio, paragraphs, round(rhythm, 6) AS para_rhythm,
           array_to_string(lost, ' ') AS lost_numbers, array_to_string(flags, '; ') AS flags FROM card""")
def chapter_scorecard(t):
    card = A.scorecard(t.fx_pairs, with_similarity=False)
    return card.withColumns({
        "word_ratio": F.round("word_ratio", 9), "para_rhythm": F.round("para_rhythm", 6),
        "lost_numbers": F.array_join("lost_numbers", " "), "flags": F.array_join("flags", "; "),
    })


@query("chapter_similarity")
def chapter_similarity(t):
    return A.scorecard(t.fx_pairs).select("pair_id", "similarity", F.array_join("flags", "; ").alias("flags"))


@query("paragraph_rhythm", "fx_pairs", f"""{CARD} SELECT pair_id, paragraphs, round(rhythm, 6) AS para_rhythm, paragraphs > 3 AND rhythm < 0.18 AS mechanical FROM card""")
def paragraph_rhythm(t):
    lengths = F.transform(A.paragraphs("out_md"), lambda p: F.length(p))
    r = t.fx_pairs.select("pair_id", F.size(lengths).alias("paragraphs"), A.rhythm(lengths).alias("para_rhythm"))
    return r.select("pair_id", "paragraphs", F.round("para_rhythm", 6).alias("para_rhythm"),
                    ((F.col("paragraphs") > 3) & (F.col("para_rhythm") < A.MECHANICAL_RHYTHM)).alias("mechanical"))


@query("lost_figures", "fx_pairs", f"SELECT pair_id, array_to_string({LOST}, ' ') AS lost FROM fx_pairs")
def lost_figures(t):
    return t.fx_pairs.select("pair_id", F.array_join(A.lost_figures("src_md", "out_md"), " ").alias("lost"))


@query("figure_set_difference", "fx_pairs", f"""
    s AS (SELECT DISTINCT pair_id, unnest({_figures('src_md')}) AS figure FROM fx_pairs), o AS (SELECT DISTINCT pair_id, unnest({_figures('out_md')}) AS figure FROM fx_pairs)
    SELECT * FROM s EXCEPT SELECT * FROM o""")
def figure_set_difference(t):
    src = t.fx_pairs.select("pair_id", F.explode(A.figures("src_md")).alias("figure"))
    out = t.fx_pairs.select("pair_id", F.explode(A.figures("out_md")).alias("figure"))
    return src.subtract(out)


@query("figure_set_intersection", "fx_pairs", f"""
    s AS (SELECT DISTINCT pair_id, unnest({_figures('src_md')}) AS figure FROM fx_pairs), o AS (SELECT DISTINCT pair_id, unnest({_figures('out_md')}) AS figure FROM fx_pairs)
    SELECT * FROM s INTERSECT SELECT * FROM o""")
def figure_set_intersection(t):
    src = t.fx_pairs.select("pair_id", F.explode(A.figures("src_md")).alias("figure"))
    out = t.fx_pairs.select("pair_id", F.explode(A.figures("out_md")).alias("figure"))
    return src.intersect(out)


@query("similarity_bounds", "fx_pairs", f"""
    w AS (SELECT pair_id, {D.norm_words('src_md')} AS a, {D.norm_words('out_md')} AS b FROM fx_pairs),
    ca AS (SELECT pair_id, w, count(*) AS n FROM (SELECT pair_id, unnest(a) AS w FROM w) GROUP BY ALL), cb AS (SELECT pair_id, w, count(*) AS n FROM (SELECT pair_id, unnest(b) AS w FROM w) GROUP BY ALL),
    sh AS (SELECT pair_id, sum(least(ca.n, cb.n)) AS shared FROM ca JOIN cb USING (pair_id, w) GROUP BY 1)
    SELECT pair_id, CASE WHEN len(a) + len(b) > 0 THEN 2 * least(len(a), len(b)) / (len(a) + len(b)) ELSE 1 END AS length_bound,
           CASE WHEN len(a) + len(b) > 0 THEN 2 * coalesce(shared, 0) / (len(a) + len(b)) ELSE 1 END AS word_bound FROM w LEFT JOIN sh USING (pair_id)""")
def similarity_bounds(t):
    return A.similarity_bounds(t.fx_pairs)


PAIRING = TIDY.replace("FROM fx_titles", "FROM (SELECT doc_id AS item_id, title, source FROM (SELECT doc_id, source, title FROM x0))") 


@query("audit_pairing", "fx_chapters", f"""
    x0 AS (SELECT chapter_no AS doc_id, book_id AS source, CASE WHEN chapter_no % 5 = 0 THEN '#' || chapter_no || ' - ' || title ELSE title END AS title FROM fx_chapters),
    {PAIRING},
    ch AS (SELECT book_id, title, max_by(content_md, chapter_no) AS body FROM fx_chapters WHERE chapter_no % 7 <> 0 GROUP BY ALL)
    SELECT item_id AS pair_id, tidied.title, f.content_md AS src_md, ch.body AS out_md FROM tidied JOIN ch ON ch.book_id = tidied.source AND ch.title = tidied.tidy JOIN fx_chapters f ON f.chapter_no = tidied.item_id WHERE f.chapter_no % 11 <> 0""")
def audit_pairing(t):
    return _pairing(t)[0]


@query("audit_unmeasured", "fx_chapters", f"""
    x0 AS (SELECT chapter_no AS doc_id, book_id AS source, CASE WHEN chapter_no % 5 = 0 THEN '#' || chapter_no || ' - ' || title ELSE title END AS title FROM fx_chapters),
    {PAIRING},
    ch AS (SELECT DISTINCT book_id, title FROM fx_chapters WHERE chapter_no % 7 <> 0)
    SELECT source AS book_id, item_id AS id, tidied.title FROM tidied LEFT JOIN ch ON ch.book_id = tidied.source AND ch.title = tidied.tidy WHERE ch.title IS NULL OR item_id % 11 = 0""")
def audit_unmeasured(t):
    return _pairing(t)[1]


def _pairing(t):
    marked = F.when(F.col("chapter_no") % 5 == 0, F.concat(F.lit("#"), "chapter_no", F.lit(" - "), "title")).otherwise(F.col("title"))
    items = t.fx_chapters.select("book_id", F.col("chapter_no").alias("id"), marked.alias("title"))
    chapters = t.fx_chapters.filter("chapter_no % 7 <> 0").groupBy("book_id", "title").agg(F.max_by("content_md", "chapter_no").alias("body"))
    renderings = t.fx_chapters.filter("chapter_no % 11 <> 0").select(F.col("chapter_no").alias("id"), F.col("content_md").alias("src_md"))
    return A.audit_pairs(items, chapters, renderings)


@query("passage_alignment")
def passage_alignment(t):
    return A.passages(t.fx_pairs)


@query("passage_verdict_flags")
def passage_verdict_flags(t):
    k = F.col("doc_id")
    scores = t.labels.select(k.alias("pair_id"), F.lit(1).alias("passage_no"), (k % 10 / 10).alias("adds"), (k % 7 / 6).alias("changes"))
    clean = A.scorecard(t.fx_pairs, with_similarity=False).select("pair_id", (F.size("flags") == 0).alias("clean"))
    writer = F.when(F.col("pair_id") % 6 == 0, "judge").otherwise("writer")
    models = settle(clean.withColumns({"writer": writer, "judge": F.lit("judge")}), "models")
    # Only what a judge may read is aligned.
    aligned = A.passages(t.fx_pairs.join(A.readable(models), "pair_id", "left_semi"))
    return A.passage_flags(aligned, scores, models)


@query("word_chunks", "fx_docs", f"""
    w AS (SELECT doc_id, {D.words('text')} AS ws FROM fx_docs), k AS (SELECT doc_id, ws, unnest(generate_series(0, cast(ceil(len(ws) / 100) AS bigint) - 1)) AS k FROM w)
    SELECT doc_id, k AS chunk_no, array_to_string(ws[k * 100 + 1 : k * 100 + 100], ' ') AS chunk FROM k""")
def word_chunks(t):
    return t.fx_docs.select("doc_id", F.posexplode(P.word_chunks("text", 100)).alias("chunk_no", "chunk"))


PACK = f"""
    ps AS (SELECT pair_id, unnest(list_transform(list_filter(string_split(src_md, chr(10) || chr(10)), lambda p: NOT ({D.blank('p')})), lambda p, i: {{'t': p, 'i': i}})) AS u FROM fx_pairs),
    pw AS (SELECT pair_id, u.i AS i, u.t AS t, len({D.words('u.t')}) AS n FROM ps),
    walk AS (SELECT pair_id, i, t, n AS size, 0 AS k FROM pw WHERE i = 1
        UNION ALL SELECT p.pair_id, p.i, p.t, CASE WHEN w.size + p.n > 150 THEN p.n ELSE w.size + p.n END, w.k + (w.size + p.n > 150)::int FROM walk w JOIN pw p ON p.pair_id = w.pair_id AND p.i = w.i + 1),
    chunks AS (SELECT pair_id, k AS chunk_no, string_agg(t, chr(10) || chr(10) ORDER BY i) AS src FROM walk GROUP BY ALL)"""


@query("paragraph_chunks", "fx_pairs", f"{PACK} SELECT pair_id, chunk_no, src AS chunk FROM chunks")
def paragraph_chunks(t):
    return t.fx_pairs.select("pair_id", F.posexplode(P.paragraph_chunks("src_md", 150)).alias("chunk_no", "chunk"))


def copyedit_chunks(t):
    return P.chunk_rows(t.fx_pairs, "pair_id", "src_md", "copyedit", 150)


def outputs(chunks):
    k = (F.col("chunk_no") + F.col("pair_id")) % 4
    out = F.when(k == 0, F.col("src")).when(k == 1, F.upper(F.replace("src", F.lit("ß"), F.lit("ss")))).when(k == 2, F.left("src", F.length("src") - 300))
    return chunks.select("pair_id", "role", "chunk_no", out.alias("out"), (k == 3).alias("transient"))


GUARDED = f"""{PACK},
    outs AS (SELECT *, CASE (chunk_no + pair_id) % 4 WHEN 0 THEN src WHEN 1 THEN upper(replace(src, 'ß', 'ss')) WHEN 2 THEN left(src, greatest(len(src) - 300, 0)) END AS out, (chunk_no + pair_id) % 4 = 3 AS transient FROM chunks),
    sized AS (SELECT *, len({D.norm_words('src')}) AS s, len({D.norm_words('coalesce(out, chr(32))')}) AS o FROM outs),
    judged AS (SELECT *, CASE WHEN out IS NULL OR {D.blank('out')} THEN false WHEN s = 0 THEN true ELSE o / s BETWEEN 0.55 AND 1.05 END AS accepted FROM sized)"""


@query("copyedit_guard", "fx_pairs", f"{GUARDED} SELECT pair_id, chunk_no, accepted FROM judged")
def copyedit_guard(t):
    chunks = copyedit_chunks(t)
    joined = chunks.join(outputs(chunks), ["pair_id", "role", "chunk_no"])
    return P.with_verdicts(joined).select("pair_id", "chunk_no", "accepted")


@query("chunked_transform_guarded", "fx_pairs", f"""{GUARDED}
    SELECT pair_id, 'copyedit' AS role, coalesce(string_agg(CASE WHEN accepted THEN out ELSE src END, chr(10) || chr(10) ORDER BY chunk_no) FILTER (NOT {D.blank('CASE WHEN accepted THEN out ELSE src END')}), '') AS text,
           count_if(accepted) AS rewritten, count(*) AS chunks, NOT bool_or(transient) AS cacheable FROM judged GROUP BY 1""")
def chunked_transform_guarded(t):
    chunks = copyedit_chunks(t)
    return P.reassemble(chunks, outputs(chunks), "pair_id")


@query("preserve_guard")
def preserve_guard(t):
    """Whether a word-for-word pass kept the words, on the audit pairs."""
    rows = t.fx_pairs.select("pair_id", F.lit("punctuate").alias("role"), F.col("src_md").alias("src"), F.col("out_md").alias("out"))
    return P.with_verdicts(rows).select("pair_id", "accepted")


@query("sections_guard", "fx_docs", f"""
    c AS (SELECT doc_id, text, {D.words('text')} AS ws FROM fx_docs)
    SELECT doc_id, NOT ({D.blank('text')}) AND doc_id % 3 <> 2 AND len({D.norm_words('text')}) > 0 AS accepted FROM c""")
def sections_guard(t):
    out = F.when(F.col("doc_id") % 3 == 2, "").otherwise(F.concat(F.lit("# Added heading\n\n"), "text"))
    rows = t.fx_docs.select("doc_id", F.lit("sections").alias("role"), F.col("text").alias("src"), out.alias("out"))
    return P.with_verdicts(rows).select("doc_id", "accepted")


@query("role_planning", "fx_items", """
    roles AS (SELECT DISTINCT job_id, r.role FROM fx_items, (VALUES ('copyedit', 2), ('sections', 3), ('punctuate', 1), ('preface', 1)) r(role, k) WHERE job_id % r.k = 0)
    SELECT i.job_id, i.id, coalesce(string_agg(r.role, ',' ORDER BY r.role) FILTER (r.role <> 'preface' AND item_type <> 'podcast' AND (r.role <> 'punctuate' OR (item_type = 'youtube' AND NOT coalesce(is_punctuated, false))) AND (r.role <> 'sections' OR doc_id % 4 <> 0)), '') AS roles,
           coalesce(string_agg(r.role, ',' ORDER BY r.role) FILTER (r.role <> 'preface'), '') AS roles_key FROM fx_items i LEFT JOIN roles r USING (job_id) GROUP BY 1, 2""")
def role_planning(t):
    jobs = t.fx_items.select("job_id").distinct()
    chosen = None
    for role, k in (("copyedit", 2), ("sections", 3), ("punctuate", 1), ("preface", 1)):
        part = jobs.filter(F.col("job_id") % k == 0).select("job_id", F.lit(role).alias("role"))
        chosen = part if chosen is None else chosen.unionByName(part)
    items = t.fx_items.withColumn("structured", F.col("doc_id") % 4 == 0)
    return P.planned_roles(items, chosen)


@query("token_budget", "fx_docs", f"SELECT doc_id, least(8192, greatest(512, len({D.words('text')}) * 3 + 256)) AS budget FROM fx_docs")
def token_budget(t):
    return t.fx_docs.select("doc_id", P.token_budget("text").alias("budget"))


@query("fuzzy_title_linkage")
def fuzzy_title_linkage(t):
    """Three looked-up candidates per title: the next item's, one with a slip, the same without its wrapping."""
    wanted = settle(t.fx_titles, "titles")
    other = wanted.select((F.col("item_id") - 1).alias("item_id"), F.lit(0).alias("rank"), "title", "duration_s")
    slip = wanted.select("item_id", F.lit(1).alias("rank"), F.regexp_replace("title", "e([a-z])", "$1e").alias("title"), (F.col("duration_s") + F.col("item_id") % 400).alias("duration_s"))
    bare = wanted.select("item_id", F.lit(2).alias("rank"), F.regexp_replace("title", " - YouTube$", "").alias("title"), F.when(F.col("item_id") % 2 == 0, F.col("duration_s")).alias("duration_s"))
    return L.linked_titles(wanted, other.unionByName(slip).unionByName(bare))


@query("linkage_duration_filter", "fx_titles", """
    SELECT a.item_id, abs(a.duration_s - b.duration_s) <= greatest(180, 0.15 * greatest(a.duration_s, b.duration_s)) AS close
    FROM fx_titles a JOIN fx_titles b ON b.item_id = a.item_id + 1 + a.item_id % 300""")
def linkage_duration_filter(t):
    a = t.fx_titles.select("item_id", "duration_s", (F.col("item_id") + 1 + F.col("item_id") % 300).alias("_other"))
    b = t.fx_titles.select(F.col("item_id").alias("_other"), F.col("duration_s").alias("_d"))
    return a.join(b, "_other").select("item_id", L.close_durations(F.col("duration_s"), F.col("_d")).alias("close"))


NUMBERS = "regexp_extract_all(n, '[0-9]+')"


@query("linkage_title_normalisation", "fx_titles", rf"""
    c AS (SELECT item_id, {D.collapse(r"regexp_replace(lower(regexp_replace(title, '(?i)^\s*(?:(?:ep(?:isode)?[.]?\s*)?#?[0-9]+\s*[.:\-–—|]\s*|ep(?:isode)?[.]?\s*#?[0-9]+\s+)', '')), '[^\p{L}\p{N}_\s\p{Z}]', ' ', 'g')")} AS n FROM fx_titles)
    SELECT item_id, n AS folded, array_to_string({NUMBERS}, ',') AS numbers FROM c""")
def linkage_title_normalisation(t):
    n = L.link_title(L.compatible("title"))
    rows = t.fx_titles.select("item_id", n.alias("folded"))
    return rows.withColumn("numbers", F.array_join(F.regexp_extract_all("folded", F.lit(r"(\d+)"), 1), ","))
