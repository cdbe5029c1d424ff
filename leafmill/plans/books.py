"""Language, title, book and Markdown queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafmill.functions.text import escape_tags
from leafmill.operators import books as B
from leafmill.operators import language as G
from leafmill.operators import markdown as M
from leafmill.operators import titles as T
from leafmill.plans import duck as D
from leafmill.plans.registry import query
from leafmill.sources.books import scan_book_lines
from leafmill.streaming.tables import shared_folder


def _votes(text: str) -> str:
    ws = f"regexp_extract_all(lower(left({text}, 20000)), '\\p{{L}}+')"
    rows = ", ".join(
        f"{{'hits': len(list_filter(ws, lambda w: list_contains({D.lit(sorted(set(s.split())))}, w))), 'place': {-i}, 'lang': '{g}'}}"
        for i, (g, s) in enumerate(G.STOP_WORDS.items())
    )
    return ws, f"list_max([{rows}])"


WORDS, BEST = _votes("text")


@query("language_vote", "fx_docs", f"""
    w AS (SELECT doc_id, {WORDS} AS ws FROM fx_docs), b AS (SELECT doc_id, {BEST} AS best FROM w)
    SELECT doc_id, CASE WHEN best.hits >= 20 THEN best.lang END AS language FROM b""")
def language_vote(t):
    return t.fx_docs.select("doc_id", G.detect_language("text").alias("language"))


DOMINANT = f"""usable AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY chapter_no) AS number FROM fx_chapters WHERE NOT {D.blank('content_md')}),
    weights AS (SELECT book_id, language, sum(len(content_md)) AS size, min(chapter_no) AS first FROM usable WHERE language IS NOT NULL GROUP BY ALL),
    dominant AS (SELECT book_id, coalesce(max_by(language, (size, -first)), 'en') AS language FROM (SELECT DISTINCT book_id FROM usable) LEFT JOIN weights USING (book_id) GROUP BY 1)"""


@query("dominant_language", "fx_chapters", f"{DOMINANT} SELECT * FROM dominant")
def dominant_language(t):
    return G.dominant_language(B.usable_chapters(t.fx_chapters))


def _chrome(language: str, label: str) -> str:
    cases = " ".join(f"WHEN '{g}' THEN '{v[label]}'" for g, v in G.CHROME.items())
    return f"CASE coalesce({language}, 'en') {cases} ELSE '{G.CHROME['en'][label]}' END"


@query("chrome_labels", "fx_docs", f"""
    SELECT doc_id, {_chrome('l', 'sources')} AS sources, {_chrome('l', 'speaker')} AS speaker, {_chrome('l', 'toc')} AS toc
    FROM (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'nl' WHEN doc_id % 7 = 1 THEN NULL ELSE lang END AS l FROM fx_docs)""")
def chrome_labels(t):
    language = F.when(F.col("doc_id") % 7 == 0, "nl").when(F.col("doc_id") % 7 == 1, None).otherwise(F.col("lang"))
    docs = t.fx_docs.select("doc_id", language.alias("l"))
    return docs.select("doc_id", *[G.chrome("l", x).alias(x) for x in ("sources", "speaker", "toc")])


@query("language_tags", "fx_page_titles", f"""
    SELECT page_id, nullif(regexp_extract(lower(regexp_extract(left(html, 5000), '(?i)<html\\b[^>]*?\\b(?:xml:)?lang\\s*=\\s*["'']?([A-Za-z]{{2,3}}(?:[-_][A-Za-z0-9]+)*)', 1)), '^([a-z]{{2,3}})(?:[-_][a-z0-9]+)*$', 1), '') AS declared,
           nullif(regexp_extract(lower(trim(tag)), '^([a-z]{{2,3}})(?:[-_][a-z0-9]+)*$', 1), '') AS primary_tag
    FROM (SELECT *, CASE page_id % 4 WHEN 0 THEN ' EN-us ' WHEN 1 THEN 'x' WHEN 2 THEN 'fr_CA' ELSE 'deutsch' END AS tag FROM fx_page_titles)""")
def language_tags(t):
    k = F.col("page_id") % 4
    tag = F.when(k == 0, " EN-us ").when(k == 1, "x").when(k == 2, "fr_CA").otherwise("deutsch")
    return t.fx_page_titles.select("page_id", G.html_language("html").alias("declared"), G.normalize_language(tag).alias("primary_tag"))


SHOUT = r"""regexp_matches(x, '\p{L}') AND NOT regexp_matches(x, '[\p{Ll}\p{Lt}\p{Lm}\p{Lo}]') AND (len(regexp_extract_all(x, '[A-Za-z][A-Za-z''’*]*')) >= 2
    OR (len(regexp_extract_all(x, '[A-Za-z][A-Za-z''’*]*')) = 1 AND len(regexp_extract_all(x, '[A-Za-z][A-Za-z''’*]*')[1]) >= 5))"""
CAPITAL = rf"""array_to_string(list_transform(list_filter(regexp_split_to_array(lower(x), '\s+'), lambda w: w <> ''), lambda w, i:
    CASE WHEN i > 1 AND i < len(list_filter(regexp_split_to_array(x, '\s+'), lambda v: v <> '')) AND list_contains({D.lit(T.SMALL_WORDS)}, w) THEN w
    ELSE regexp_extract(w, '^([^\p{{L}}]*)', 1) || upper(regexp_extract(w, '^[^\p{{L}}]*(\p{{L}})', 1)) || regexp_extract(w, '^[^\p{{L}}]*\p{{L}}(.*)$', 1) END), ' ')"""
TIDY = rf"""
    r0 AS (SELECT *, {D.collapse('title')} AS t0 FROM fx_titles),
    r1 AS (SELECT *, regexp_replace(regexp_replace(t0, '\s*[|]\s*[^|]+$', ''), '(?i)\s*[-–—]\s*YouTube(?:\s+Music)?$', '') AS t1 FROM r0),
    r2 AS (SELECT *, regexp_replace(t1, '(?i)^\s*(?:#\s*[0-9]+|(?:episode|ep|chapter|ch|part|pt|vol|e)[.]?\s*[0-9]+)\s*[-–—:|.]\s+', '') AS t2 FROM r1),
    r3 AS (SELECT *, array_to_string(list_transform(string_split(regexp_replace(t2, '(\s+[-–—|]\s+|:\s+)', chr(1) || '\1' || chr(1), 'g'), chr(1)), lambda x: CASE WHEN {SHOUT} THEN {CAPITAL} ELSE x END), '') AS t3 FROM r2),
    tidied AS (SELECT *, coalesce(nullif({D.collapse('t3')}, ''), trim(title)) AS tidy FROM r3)"""


@query("title_tidy", "fx_titles", f"{TIDY} SELECT item_id, tidy FROM tidied")
def title_tidy(t):
    return t.fx_titles.select("item_id", T.tidy_title("title").alias("tidy"))


@query("title_rule_hits", "fx_titles", f"""{TIDY} SELECT count(*) AS titles, count_if(t0 <> t1) AS suffixes, count_if(t1 <> t2) AS markers, count_if(t2 <> t3) AS shouts FROM tidied""")
def title_rule_hits(t):
    return T.rule_hits(t.fx_titles)


SITE = f"regexp_replace({D.host('i.url')}, '^www[.]', '')"
ORIGINS = f"""
    o AS (SELECT i.*, {SITE} AS site, ({SITE} = 'wikipedia.org' OR ends_with({SITE}, '.wikipedia.org')) AS wiki,
                 CASE WHEN count(*) OVER (PARTITION BY i.job_id, i.source_index) > 1 THEN nullif(s.name, '') END AS listed
          FROM fx_items i LEFT JOIN fx_sources s USING (job_id, source_index)),
    labelled AS (SELECT *, CASE WHEN item_type = 'blog' AND wiki THEN 'Wikipedia' WHEN item_type = 'blog' THEN coalesce(nullif(site_name, ''), site) ELSE coalesce(listed, site) END AS origin_label,
                        CASE WHEN item_type = 'blog' AND wiki THEN 'wikipedia.org' WHEN item_type = 'blog' THEN site ELSE lower(coalesce(listed, site)) END AS origin FROM o)"""


@query("origin_labels", "fx_items fx_sources", f"{ORIGINS} SELECT id, origin, origin_label FROM labelled")
def origin_labels(t):
    return T.with_origins(t.fx_items, t.fx_sources).select("id", "origin", "origin_label")


@query("title_disambiguation", "fx_items fx_sources", f"""{ORIGINS},
    keyed AS (SELECT *, {D.fold_title('title')} AS fold FROM labelled)
    SELECT id, CASE WHEN (min(origin) OVER w) <> (max(origin) OVER w) THEN origin_label END AS title_suffix FROM keyed WINDOW w AS (PARTITION BY job_id, fold)""")
def title_disambiguation(t):
    return T.disambiguate(T.with_origins(t.fx_items, t.fx_sources)).select("id", "title_suffix")


@query("single_origin_books", "fx_chapters", f"""
    b AS (SELECT book_id, count_if(source_type = 'blog') AS pages, count_if(source_type = 'youtube') AS videos,
                 count(DISTINCT CASE WHEN source_type = 'blog' THEN {D.netloc('source_url')} END) AS sites, count(DISTINCT CASE WHEN source_type = 'youtube' THEN channel_url END) AS channels,
                 min_by(source_url, chapter_no) FILTER (source_type = 'blog') AS first_page, min(channel_url) FILTER (source_type = 'youtube') AS channel FROM fx_chapters GROUP BY 1)
    SELECT book_id, 'site' AS kind, first_page AS origin FROM b WHERE pages > 0 AND videos = 0 AND sites = 1
    UNION ALL SELECT book_id, 'channel', channel FROM b WHERE videos > 0 AND pages = 0 AND channels = 1""")
def single_origin_books(t):
    return B.single_origin_books(t.fx_chapters)


@query("credited_authors", "fx_chapters", f"""
    a AS (SELECT book_id, {D.strip('author')} AS author, min(chapter_no) AS first FROM fx_chapters WHERE {D.strip('author')} <> '' GROUP BY ALL)
    SELECT book_id, author, row_number() OVER (PARTITION BY book_id ORDER BY first) AS rank FROM a""")
def credited_authors(t):
    return B.credited_authors(t.fx_chapters)


@query("typed_authors", "fx_docs", f"""
    l AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN ' , ' ELSE replace(text, ' ', ' , ') END AS line FROM fx_docs)
    SELECT doc_id, nullif(array_to_string(list_filter(list_transform(string_split(line, ','), lambda x: {D.strip('x')}), lambda x: x <> ''), ';'), '') AS names FROM l""")
def typed_authors(t):
    line = F.when(F.col("doc_id") % 5 == 0, " , ").otherwise(F.replace("text", F.lit(" "), F.lit(" , ")))
    return t.fx_docs.select("doc_id", F.array_join(B.typed_authors(line), ";").alias("names"))


@query("default_book_title", "fx_sources", """
    n AS (SELECT job_id, source_index, nullif(trim(name), '') AS name FROM fx_sources),
    g AS (SELECT job_id, count(name) AS n, min_by(name, source_index) FILTER (name IS NOT NULL) AS first FROM n GROUP BY 1)
    SELECT job_id, CASE WHEN n = 0 THEN 'Untitled' WHEN n = 1 THEN first ELSE first || ' (+' || (n - 1) || ' more)' END AS title FROM g""")
def default_book_title(t):
    return B.default_title(t.fx_sources, "Untitled")


@query("selection_book_title", "fx_items fx_sources", """
    p AS (SELECT DISTINCT job_id, source_index FROM fx_items WHERE selected AND (job_id % 3 <> 0 OR source_index = 2)),
    g AS (SELECT job_id, count(*) AS n, max(coalesce(nullif(trim(name), ''), nullif(trim(title), ''))) AS name FROM p LEFT JOIN fx_sources USING (job_id, source_index) GROUP BY 1)
    SELECT job_id, left(CASE WHEN n = 1 AND name IS NOT NULL THEN name ELSE 'Compilation of ' || n || CASE WHEN n = 1 THEN ' source' ELSE ' sources' END END, 100) AS title FROM g""")
def selection_book_title(t):
    items = t.fx_items.filter("job_id % 3 <> 0 OR source_index = 2")
    return B.selection_title(items, t.fx_sources)


@query("book_headers", "fx_chapters", f"""{DOMINANT},
    c AS (SELECT book_id, count_if(NOT {D.blank('content_md')}) AS chapters FROM fx_chapters GROUP BY 1)
    SELECT book_id, chapters, language, CASE WHEN chapters = 0 THEN 'The selected items had no usable content.' END AS error FROM c LEFT JOIN dominant USING (book_id)""")
def book_headers(t):
    return B.book_headers(t.fx_chapters)


def prefaces(t):
    return t.fx_chapters.select("book_id").distinct().filter("length(book_id) % 2 = 0").select(
        "book_id", F.concat(F.lit(" About "), "book_id", F.lit("\n")).alias("preface"))


PARTS = f"""{DOMINANT},
    rows AS (SELECT u.*, d.language AS bl FROM usable u JOIN dominant d USING (book_id)),
    parts AS (SELECT book_id, 0 AS section, 0 AS number, '# ' || {_chrome('language', 'sources')} || ' {{.front-matter}}' || chr(10) AS text FROM dominant
    UNION ALL SELECT book_id, 1, number, '- [' || {D.escape_tags('title')} || '](' || source_url || ')' FROM rows
    UNION ALL SELECT book_id, 2, 0, '' FROM dominant
    UNION ALL SELECT book_id, 3, 0, '# ' || {_chrome('language', 'preface')} || ' {{.front-matter}}' || chr(10) || chr(10) || 'About ' || book_id || chr(10) FROM dominant WHERE len(book_id) % 2 = 0
    UNION ALL SELECT book_id, 4, number, '# ' || {D.escape_tags('title')} || CASE WHEN language IS NOT NULL THEN ' {{lang=' || language || '}}' ELSE '' END || chr(10)
        || '::: {{.source-attribution' || CASE WHEN language <> bl THEN ' lang=' || bl ELSE '' END || '}}' || chr(10)
        || concat_ws(' | ', '*' || {_chrome('bl', 'source')} || ': [' || source_url || '](' || source_url || ')*', CASE WHEN author <> '' THEN '*' || {_chrome('bl', 'author')} || ': ' || {D.escape_tags('author')} || '*' END,
            '*' || {_chrome('bl', 'date')} || ': ' || published || '*') || chr(10) || ':::' || chr(10) || chr(10)
        || regexp_replace(content_md, '\\[\\^fn([0-9]+)\\]', '[^c' || number || 'fn\\1]', 'g') || chr(10) FROM rows)""".replace("{{", "{").replace("}}", "}")


@query("book_markdown_parts", "fx_chapters", f"{PARTS} SELECT * FROM parts")
def book_markdown_parts(t):
    return B.book_parts(t.fx_chapters, prefaces(t))


@query("tag_escape", "fx_md_images", f"SELECT doc_id, {D.escape_tags('md')} AS md FROM fx_md_images")
def tag_escape(t):
    return t.fx_md_images.select("doc_id", escape_tags("md").alias("md"))


@query("footnote_numbering", "fx_md_docs", "SELECT doc_id, regexp_replace(md, '\\[\\^fn([0-9]+)\\]', '[^c' || doc_id || 'fn\\1]', 'g') AS md FROM fx_md_docs")
def footnote_numbering(t):
    return t.fx_md_docs.select("doc_id", B.number_footnotes("md", "doc_id").alias("md"))


@query("footnote_definitions_split", "fx_md_docs", rf"""
    f AS (SELECT doc_id, md, regexp_extract(md, '(?s)^(.*?)(?:^|\n)\[\^fn[0-9]+\]:', 1) AS head, regexp_matches(md, '(?m)^\[\^fn[0-9]+\]:') AS has FROM fx_md_docs)
    SELECT doc_id, CASE WHEN has THEN regexp_replace(head, '[\s\p{{Z}}]+$', '') ELSE md END AS text, CASE WHEN has THEN {D.strip('md[len(head) + 1:]')} ELSE '' END AS notes FROM f""")
def footnote_definitions_split(t):
    text, notes = B.split_definitions("md")
    return t.fx_md_docs.select("doc_id", text.alias("text"), notes.alias("notes"))


NOTES = {1: "First <note>\nsecond line\n\nthird", 3: " plain "}


@query("footnote_writing", "fx_docs", rf"""
    tok AS (SELECT doc_id, replace(replace(replace(replace(text, 'the', '⟦fn3⟧'), 'an', '⟦fn2⟧'), 'de', '⟦fn1⟧'), 'xx', '') || '  ' AS md FROM fx_docs),
    c AS (SELECT doc_id, md, list_filter(regexp_extract_all(md, '⟦fn([0-9]+)⟧', 1), lambda n: n <> '2') AS calls FROM tok),
    b AS (SELECT doc_id, calls, regexp_replace(regexp_replace(regexp_replace(md, '⟦fn2⟧', '', 'g'), '⟦fn([0-9]+)⟧', '[^fn\1]', 'g'), '[\s\p{{Z}}]+$', '') AS body FROM c)
    SELECT doc_id, CASE WHEN len(calls) = 0 THEN body ELSE body || chr(10) || chr(10) || CASE
        WHEN list_position(calls, '1') IS NULL OR list_position(calls, '1') = 0 THEN '[^fn3]: plain'
        WHEN list_position(calls, '3') IS NULL OR list_position(calls, '3') = 0 THEN '[^fn1]: First <note>' || chr(10) || '    second line' || chr(10) || chr(10) || '    third'
        WHEN list_position(calls, '1') < list_position(calls, '3') THEN '[^fn1]: First <note>' || chr(10) || '    second line' || chr(10) || chr(10) || '    third' || chr(10) || chr(10) || '[^fn3]: plain'
        ELSE '[^fn3]: plain' || chr(10) || chr(10) || '[^fn1]: First <note>' || chr(10) || '    second line' || chr(10) || chr(10) || '    third' END END AS md FROM b""")
def footnote_writing(t):
    md = F.col("text")
    for old, new in (("the", "⟦fn3⟧"), ("an", "⟦fn2⟧"), ("de", "⟦fn1⟧"), ("xx", "")):
        md = F.replace(md, F.lit(old), F.lit(new))
    notes = F.create_map(*[F.lit(x) for pair in NOTES.items() for x in pair])
    docs = t.fx_docs.select("doc_id", F.concat(md, F.lit("  ")).alias("md"))
    return docs.select("doc_id", B.write_footnotes("md", notes).alias("md"))


@query("preview_projection", "fx_docs", r"""
    SELECT doc_id, CASE WHEN len(text) > 8000 THEN regexp_replace(left(text, 8000), '[\s\p{Z}]+$', '') || '…' ELSE text END AS content, len(text) > 8000 AS truncated FROM fx_docs""")
def preview_projection(t):
    content, truncated = M.preview("text")
    return t.fx_docs.select("doc_id", content.alias("content"), truncated.alias("truncated"))


LINES = r"""
    lines AS (SELECT doc_id, title, unnest(list_transform(string_split(md, chr(10)), lambda x, i: {'t': x, 'i': i})) AS u FROM fx_md_docs),
    fenced AS (SELECT doc_id, title, u.i AS i, u.t AS t, regexp_matches(u.t, '^\s*```') AS fence, sum(regexp_matches(u.t, '^\s*```')::int) OVER (PARTITION BY doc_id ORDER BY u.i) % 2 = 1 AS inside FROM lines)"""


@query("heading_demotion", "fx_md_docs", rf"""{LINES},
    levels AS (SELECT *, CASE WHEN NOT inside AND regexp_matches(t, '^#{{1,6}}\s') THEN len(regexp_extract(t, '^(#{{1,6}})\s', 1)) END AS lvl FROM fenced),
    shifts AS (SELECT *, 2 - min(lvl) OVER (PARTITION BY doc_id) AS shift FROM levels)
    SELECT doc_id, string_agg(CASE WHEN lvl IS NOT NULL AND shift > 0 THEN repeat('#', least(6, lvl + shift)::int) || substr(t, lvl + 1) ELSE t END, chr(10) ORDER BY i) AS md FROM shifts GROUP BY 1""")
def heading_demotion(t):
    return t.fx_md_docs.select("doc_id", M.demote_headings("md").alias("md"))


PLAIN = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"


@query("leading_title_strip", "fx_md_docs", rf"""{LINES},
    firsts AS (SELECT doc_id, min(i) FILTER (regexp_matches(t, '^#{{1,6}}\s')) AS f FROM fenced GROUP BY 1),
    heads AS (SELECT l.doc_id, f, {PLAIN.format(r"regexp_replace(regexp_extract(l.t, '^#{1,6}(\s.*)$', 1), '\[([^\]]+)\]\([^)]+\)', '\1', 'g')")} AS h, {PLAIN.format('l.title')} AS w FROM fenced l JOIN firsts USING (doc_id) WHERE l.i = f),
    same AS (SELECT doc_id, f FROM heads WHERE starts_with(h, w) OR starts_with(w, h)),
    marked AS (SELECT l.doc_id, l.i, l.t, s.f, CASE WHEN s.f IS NULL THEN false WHEN l.i = s.f THEN true WHEN l.i = s.f + 1 AND trim(l.t) = '' THEN true
        WHEN l.i < s.f AND regexp_matches(trim(l.t), '^\[([^\]]+)\]\([^)]+\)$') THEN true ELSE false END AS gone FROM fenced l LEFT JOIN same s USING (doc_id)),
    kept AS (SELECT *, lag(t) OVER (PARTITION BY doc_id ORDER BY i) AS pt FROM marked WHERE NOT gone),
    joined AS (SELECT doc_id, ltrim(string_agg(t, chr(10) ORDER BY i), chr(10)) AS md FROM kept WHERE NOT (f IS NOT NULL AND i < f AND trim(t) = '' AND pt IS NOT NULL AND trim(pt) = '') GROUP BY 1)
    SELECT doc_id, coalesce(j.md, '') AS md FROM fx_md_docs LEFT JOIN joined j USING (doc_id)""")
def leading_title_strip(t):
    return t.fx_md_docs.select("doc_id", M.strip_leading_title("md", "title").alias("md"))


def book_texts(t):
    """Compiled books as single texts, a bounded slice of a source each."""
    parts = B.book_parts(t.fx_chapters, prefaces(t))
    rows = F.array_sort(F.collect_list(F.struct("section", "number", "text")))
    return parts.groupBy("book_id").agg(F.array_join(F.transform(rows, lambda x: x["text"]), "\n").alias("md"))


BOOKS = f"{PARTS}, texts AS (SELECT book_id, string_agg(text, chr(10) ORDER BY section, number) AS md FROM parts GROUP BY 1)"
H1 = r"""
    blines AS (SELECT book_id, unnest(list_transform(string_split(md, chr(10)), lambda x, i: {'t': x, 'i': i})) AS u FROM texts),
    secs AS (SELECT book_id, u.i AS i, u.t AS t, starts_with(u.t, '# ') AS h1, sum(starts_with(u.t, '# ')::int) OVER (PARTITION BY book_id ORDER BY u.i) AS section,
                    sum((regexp_matches(u.t, '^\s*:::') AND NOT starts_with(u.t, '# '))::int) OVER (PARTITION BY book_id ORDER BY u.i) % 2 = 1 AS fenced, regexp_matches(u.t, '^\s*:::') AS fence FROM blines)"""


@query("chapter_split", "fx_chapters", rf"""{BOOKS}, {H1},
    heads AS (SELECT book_id, section, trim(regexp_replace(t[3:], '\s*\{{([^{{}}]*)\}}\s*$', '')) AS title, contains(regexp_extract(t, '\s*\{{([^{{}}]*)\}}\s*$', 1), '.front-matter') AS front FROM secs WHERE h1),
    bodies AS (SELECT book_id, section, {D.strip("string_agg(t, chr(10) ORDER BY i)")} AS body FROM secs WHERE NOT h1 AND section > 0 GROUP BY ALL)
    SELECT book_id, title, max_by(coalesce(body, ''), section) AS body FROM heads LEFT JOIN bodies USING (book_id, section) WHERE NOT front AND title NOT IN ('Sources', 'Preface') GROUP BY 1, 2""")
def chapter_split(t):
    return M.split_chapters(book_texts(t))


@query("chapter_split_reader", "fx_chapters", rf"""{BOOKS}, {H1},
    heads AS (SELECT book_id, section, trim(regexp_replace(t[3:], '\s*\{{([^{{}}]*)\}}\s*$', '')) AS title, contains(regexp_extract(t, '\s*\{{([^{{}}]*)\}}\s*$', 1), '.front-matter') AS front FROM secs WHERE h1),
    bodies AS (SELECT book_id, section, {D.strip("string_agg(t, chr(10) ORDER BY i) FILTER (NOT fenced AND NOT fence)")} AS body,
                      min_by(nullif(regexp_extract(t, '\]\((https?://[^)\s]+)\)', 1), ''), i) FILTER (fenced AND NOT fence AND regexp_matches(t, '\]\((https?://[^)\s]+)\)')) AS source FROM secs WHERE NOT h1 AND section > 0 GROUP BY ALL)
    SELECT book_id, section, title, coalesce(body, '') AS body, source FROM heads LEFT JOIN bodies USING (book_id, section) WHERE NOT front""")
def chapter_split_reader(t):
    return M.split_reader_chapters(book_texts(t))


@query("markdown_block_table")
def markdown_block_table(t):
    return M.markdown_blocks(t.fx_md_docs, "doc_id")


DUCK_IMAGE = r"""!\[((?:[^\[\]]|\[[^\[\]]*\])*)\]\(\s*([^\s]+?)(\s+"[^"]*")?\s*\)"""


@query("inline_reference_inventory", "fx_md_images", rf"""
    x AS (SELECT doc_id, regexp_extract_all(md, '{DUCK_IMAGE}', 2) AS imgs, regexp_replace(md, '{DUCK_IMAGE}', '', 'g') AS rest FROM fx_md_images),
    y AS (SELECT *, regexp_extract_all(rest, '\[[^\]^][^\]]*\]\(([^)\s]+)(?:\s+"[^"]*")?\)', 1) AS links FROM x)
    SELECT doc_id, len(imgs) AS images, len(links) AS links, len(regexp_extract_all(rest, '\[\^[^\]\s]+\]')) AS note_calls, len(regexp_extract_all(rest, '`[^`]+`')) AS code,
           len(regexp_extract_all(rest, '\$\$[^$]+\$\$|\$x\^2\$')) AS math, len(regexp_extract_all(rest, '<su[pb]>[^<]*</su[pb]>')) AS raised,
           len(regexp_extract_all(rest, '\*\*[^*]+\*\*')) AS strong, len(regexp_extract_all(rest, ' \*[^*]+\*')) AS emphasis,
           array_to_string(links, ' ') AS link_targets, array_to_string(imgs, ' ') AS image_targets FROM y""")
def inline_reference_inventory(t):
    return M.inline_inventory(t.fx_md_images, "doc_id")


@query("image_manifest_rewrite", "fx_md_images fx_manifest", rf"""
    refs AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(md, '{DUCK_IMAGE}', 2))) AS url FROM fx_md_images),
    a AS (SELECT f.doc_id, f.md, max(r.url) FILTER (r.url LIKE 'https:%') AS u1, max(r.url) FILTER (r.url LIKE 'http:%') AS u2 FROM fx_md_images f LEFT JOIN refs r USING (doc_id) GROUP BY 1, 2),
    b AS (SELECT doc_id, CASE WHEN m1.path IS NULL THEN replace(md, '![a [b] c](' || u1 || ' "t")', '') ELSE replace(md, '(' || u1 || ' "t")', '(' || m1.path || ' "t")') END AS md, u2
          FROM a LEFT JOIN fx_manifest m1 ON m1.url = u1)
    SELECT doc_id, CASE WHEN u2 IS NULL THEN md WHEN m2.path IS NULL THEN replace(md, '![](' || u2 || ')', '') ELSE replace(md, '![](' || u2 || ')', '![](' || m2.path || ')') END AS md FROM b LEFT JOIN fx_manifest m2 ON m2.url = u2""")
def image_manifest_rewrite(t):
    return M.localize_images(t.fx_md_images, t.fx_manifest, "doc_id")


@query("book_corpus_scan", "fx_chapters", f"""{PARTS},
    l AS (SELECT book_id, unnest(string_split(text, chr(10))) AS line FROM parts)
    SELECT book_id, count(*) AS lines, count_if(starts_with(line, '# ')) AS headings FROM l GROUP BY 1""")
def book_corpus_scan(t):
    """Books written by the Markdown sink and read back line by line."""
    path = shared_folder(t.spark, "books")
    B.write_books(B.book_parts(t.fx_chapters, prefaces(t)), path)
    lines = scan_book_lines(t.spark, path)
    return lines.groupBy("book_id").agg(F.count("*").alias("lines"), F.count_if(F.col("line").startswith("# ")).alias("headings"))
