"""Page queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafmill.operators import discovery as E
from leafmill.operators import jobs as J
from leafmill.operators import page_cleanup as C
from leafmill.operators import page_facts as A
from leafmill.operators import page_markdown as M
from leafmill.operators import pages as P
from leafmill.plans import duck as D
from leafmill.plans.books import BEST, WORDS
from leafmill.plans.fixtures import FIXTURES, DuckSql
from leafmill.plans.registry import query
from leafmill.sources import pages as S


def given(t):
    return S.with_nodes(t.pages)


def rich(t, *only):
    return S.with_nodes(t.fx_rich_pages, only=only or None)


@query("page_node_counts", "", """
    t AS (SELECT page_id, unnest(regexp_extract_all(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '<([a-zA-Z][a-zA-Z0-9]*)[\\s/>]', 1)) AS tag FROM pages)
    SELECT page_id, lower(tag) AS tag, count(*) AS n FROM t GROUP BY ALL""")
def page_node_counts(t):
    nodes = S.node_table(t.pages).filter(~F.col("tag").startswith("#"))
    return nodes.groupBy("page_id", "tag").agg(F.count("*").alias("n"))


@query("page_node_table")
def page_node_table(t):
    return S.node_table(t.pages).select("page_id", "no", "last", "parent", "tag", "path", "text")


def decoded(html: str) -> str:
    """The words of markup whose tags are gone, for DuckDB."""
    text = f"regexp_replace({html}, '<[^>]*>', ' ', 'g')"
    for name, char in (("nbsp", " "), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("#x27", "''"), ("copy", "©"), ("middot", "·"), ("amp", "&")):
        text = f"replace({text}, '&{name};', '{char}')"
    return f"array_to_string({D.words(text)}, ' ')"


PLAIN = r"""regexp_replace(html, '(?s)<script>.*?</script>|<style>.*?</style>|<!--.*?-->|<nav>.*?</nav>|<footer>.*?</footer>', ' ', 'g')"""


@query("site_chrome_removal", "", f"SELECT page_id, {decoded(PLAIN)} AS text FROM pages")
def site_chrome_removal(t):
    return A.page_facts(t.pages).select("page_id", P.collapse(F.col("text")).alias("text"))


ARTICLE = r"""regexp_extract(regexp_replace(html, '(?s)<script>.*?</script>|<!--.*?-->', ' ', 'g'), '(?s)<article>(.*)</article>', 1)"""


@query("main_content_pick", "", f"SELECT page_id, {decoded(ARTICLE)} AS text, len({D.words(decoded(ARTICLE))}) AS words, 0 AS link_words FROM pages")
def main_content_pick(t):
    return A.content_measures(A.page_facts(t.pages)).select("page_id", P.collapse(F.col("text")).alias("text"), "words", "link_words")


@query("reads_as_article", "", f"""
    w AS (SELECT page_id, len({D.words(decoded(ARTICLE))}) AS words FROM pages)
    SELECT page_id, words, 0 AS link_words, 0 AS headlines, 0 AS sure_links, words >= 300 AS reads_as_article FROM w""")
def reads_as_article(t):
    return A.reads_as_article(A.page_facts(t.pages))


def rich_lines() -> str:
    d = DuckSql
    return f"""rl AS (SELECT doc_id, cast(s.p - 1 as bigint) AS i, s.w AS line FROM (SELECT doc_id, unnest(list_transform({d.lines('text')}, lambda x, i: {{'w': x, 'p': i}})) AS s FROM documents))"""


@query("reads_as_article_rich", "fx_docs", f"""{rich_lines()},
    x AS (SELECT doc_id, i, line, {D.collapse('line')} AS c, len({D.words('line')}) AS n FROM rl),
    m AS (SELECT doc_id, sum(CASE i % 6 WHEN 0 THEN n WHEN 1 THEN n + 4 WHEN 2 THEN 9 WHEN 3 THEN 2 WHEN 4 THEN 4 ELSE 3 END)::BIGINT AS lines_words,
        sum(CASE i % 6 WHEN 0 THEN n WHEN 1 THEN 3 ELSE 0 END)::BIGINT + sum(CASE WHEN i % 6 = 1 THEN 1 ELSE 0 END)::BIGINT AS linked,
        sum(CASE WHEN i % 6 = 1 THEN 3 ELSE 0 END)::BIGINT AS notes, count_if(i % 6 = 0) AS headlines, count_if(i % 6 = 0 AND (c = '' OR regexp_matches(c, '\\p{{L}}'))) AS sure FROM x GROUP BY 1),
    r AS (SELECT doc_id AS page_id, lines_words + notes + 3 + 1 + 3 + CASE WHEN doc_id % 5 = 0 THEN 2 ELSE 0 END AS words, linked AS link_words, headlines, sure AS sure_links FROM m)
    SELECT page_id, words, link_words, headlines, sure_links, greatest(sure_links, headlines) <= 3 AND words >= 300 AND link_words <= 0.25 * words AS reads_as_article FROM r""")
def reads_as_article_rich(t):
    return A.reads_as_article(A.page_facts(t.fx_rich_pages))


@query("headline_link_count", "fx_docs", f"""{rich_lines()}
    SELECT doc_id AS page_id, count_if(i % 6 = 0) AS headlines FROM rl GROUP BY 1""")
def headline_link_count(t):
    return A.page_facts(t.fx_rich_pages).select("page_id", A.headline_links().alias("headlines"))


@query("article_link_table", "fx_docs", f"""{rich_lines()},
    l AS (SELECT doc_id, 'https://s' || doc_id || '.example/posts/line-number-' || i AS href, {D.collapse('line')} AS text, false AS uncertain, i FROM rl WHERE i % 6 = 0
        UNION ALL SELECT doc_id, 'https://s' || doc_id || '.example/2024/mention-' || i, 'mention here', true, i FROM rl WHERE i % 6 = 1),
    f AS (SELECT * FROM l WHERE text = '' OR regexp_matches(text, '\\p{{L}}'))
    SELECT doc_id AS page_id, href, uncertain, row_number() OVER (PARTITION BY doc_id ORDER BY uncertain, i) AS place FROM f QUALIFY place <= 250""")
def article_link_table(t):
    return A.article_links(A.page_facts(t.fx_rich_pages)).drop("title")


@query("same_site_article_filter", "fx_page_titles", r"""
    a AS (SELECT page_id, url, unnest(list_transform(regexp_extract_all(html, '<a href="([^"]*)"', 1), lambda x, i: {'h': x, 'i': i})) AS u FROM fx_page_titles),
    v AS (SELECT page_id, u.i AS link_no, CASE (page_id + u.i) % 6 WHEN 0 THEN '/2024' || u.h WHEN 1 THEN '/posts' || u.h || '.pdf' WHEN 2 THEN '/blog/x' || u.h WHEN 3 THEN '/tag' || u.h || '-long-slug' WHEN 4 THEN u.h || '-some-slug' ELSE u.h END AS p FROM a)
    SELECT page_id, link_no, p AS path, NOT (contains(url_decode(lower(p)), ':') OR regexp_matches(lower(p), '[.](pdf|png|jpg|jpeg|gif|svg|zip|tar|gz|mp3|mp4|wav)$')
        OR regexp_matches(lower(p), '(/about|/contact|/newsletter|/privacy|/terms|/rss|/feed|/tag/|/category/|/author/|/page/|/search)'))
        AND (regexp_matches(lower(p), '^/[0-9]{4}/') OR regexp_matches(lower(p), '/(post|posts|article|articles)/') OR (contains(lower(p), '/blog/') AND len(p) - len(replace(p, '/', '')) >= 3)
             OR (len(regexp_extract(rtrim(lower(p), '/'), '([^/]*)$', 1)) >= 8 AND contains(regexp_extract(rtrim(lower(p), '/'), '([^/]*)$', 1), '-'))) AS article FROM v""")
def same_site_article_filter(t):
    from leafmill.operators.links import looks_like_article

    anchors = t.fx_page_titles.select("page_id", "url", F.posexplode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), 1)).alias("i", "h"))
    k = (F.col("page_id") + F.col("i") + 1) % 6
    p = (F.when(k == 0, F.concat(F.lit("/2024"), "h")).when(k == 1, F.concat(F.lit("/posts"), "h", F.lit(".pdf"))).when(k == 2, F.concat(F.lit("/blog/x"), "h"))
         .when(k == 3, F.concat(F.lit("/tag"), "h", F.lit("-long-slug"))).when(k == 4, F.concat("h", F.lit("-some-slug"))).otherwise(F.col("h")))
    rows = anchors.select("page_id", (F.col("i") + 1).alias("link_no"), "url", p.alias("path"))
    return rows.select("page_id", "link_no", "path", looks_like_article("path", "url").alias("article"))


@query("page_title_choice", "fx_docs", """
    SELECT doc_id AS page_id, CASE WHEN doc_id % 3 = 2 THEN CASE WHEN doc_id % 5 = 0 THEN 'Stay Connected' ELSE 'Site Name' END
        WHEN doc_id % 5 = 0 THEN 'Stay Connected' ELSE 'Story ' || doc_id || ' part' END AS title FROM fx_docs""")
def page_title_choice(t):
    first_h1 = F.coalesce(S.text_of(S.first(F.filter(S.tagged("h1"), lambda h: h["path"].rlike(P.IN_ARTICLE)))), S.text_of(S.first(S.tagged("h1"))))
    return rich(t, *P.RECORD_TAGS).select("page_id", P.checked_title(first_h1).alias("title"))


@query("site_name", "fx_docs", """
    SELECT doc_id AS page_id, CASE WHEN doc_id % 4 <> 1 THEN 'Site Name' END AS declared, CASE WHEN doc_id % 3 < 2 THEN 'Site Name' END AS from_title FROM fx_docs""")
def site_name(t):
    name = P.site_from_title(P.html_title(), F.concat(F.lit("story "), F.col("page_id"), F.lit(" part")))
    return rich(t, *P.RECORD_TAGS).select("page_id", P.meta("og:site_name").alias("declared"), name.alias("from_title"))


@query("paywall_flag", "fx_docs", "SELECT doc_id AS page_id, doc_id % 8 IN (3, 5) AS paywalled FROM fx_docs")
def paywall_flag(t):
    return t.fx_rich_pages.select("page_id", P.is_paywalled("html").alias("paywalled"))


@query("declared_feeds", "fx_docs", """
    SELECT doc_id AS page_id, k AS rank, 'https://s' || doc_id || '.example/' || CASE WHEN k = 0 THEN 'feed.xml' WHEN doc_id % 2 = 0 THEN 'fr/read/atom/' || doc_id || '.xml' ELSE 'atom/' || doc_id || '.xml' END AS feed_url
    FROM fx_docs, (VALUES (0), (1)) v(k)""")
def declared_feeds(t):
    return P.declared_feeds(rich(t, "link"))


@query("site_icons", "fx_docs", """
    SELECT doc_id AS page_id, k AS rank, CASE k WHEN 2 THEN 'https://c.example/plain.ico' ELSE 'https://s' || doc_id || '.example/' || CASE k WHEN 0 THEN 'i180.png' WHEN 1 THEN 'i32.png' ELSE 'favicon.ico' END END AS icon_url
    FROM fx_docs, (VALUES (0), (1), (2), (3)) v(k)""")
def site_icons(t):
    return P.site_icons(rich(t, "link"))


@query("table_grid_cells", "fx_docs", f"""{rich_lines()},
    ts AS (SELECT doc_id, i, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS table_no FROM rl WHERE i % 6 = 2)
    SELECT doc_id AS page_id, table_no, g.r AS row_no, g.c AS col_no, CASE WHEN g.t = '#' THEN i::varchar ELSE g.t END AS text, g.r = 0 AS is_header
    FROM ts, (VALUES (0, 0, 'a'), (0, 1, 'b'), (0, 2, ''), (1, 0, '#'), (1, 1, 'x|y'), (1, 2, 'z'), (2, 0, ''), (2, 1, 'w'), (2, 2, '')) g(r, c, t)""")
def table_grid_cells(t):
    return M.table_cells(rich(t, "table"))


@query("page_images", "fx_docs", f"""{rich_lines()}
    SELECT doc_id AS page_id, 'https://s' || doc_id || '.example/img/' || i || '.png' AS src, k.alt, CASE WHEN k.n = 0 THEN 'Caption ' || i END AS caption
    FROM rl, (VALUES (0, 'alt'), (1, NULL)) k(n, alt) WHERE i % 6 = 3""")
def page_images(t):
    return M.page_images(rich(t, *M.IMAGE_PARTS)).drop("no")


@query("footnote_call_join", "fx_docs", f"""{rich_lines()}
    SELECT doc_id AS page_id, (i % 1000)::varchar AS mark, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS note_no, 'Note ' || i || '.' AS note_text FROM rl WHERE i % 6 = 1""")
def footnote_call_join(t):
    return M.footnotes(t.fx_rich_pages).select("page_id", "mark", "note_no", "note_text")


@query("encyclopedia_back_matter_cut", "fx_docs", """
    SELECT doc_id AS page_id, false AS has_notes, false AS has_tail, true AS has_story FROM fx_docs""")
def encyclopedia_back_matter_cut(t):
    text = C.encyclopedia_text(t.fx_rich_pages)
    return text.select("page_id", F.col("text").contains("Note 1.").alias("has_notes"), F.col("text").contains("tail text").alias("has_tail"),
                       F.col("text").contains(F.concat(F.lit("Story "), F.col("page_id"), F.lit(" part"))).alias("has_story"))


@query("page_to_markdown")
def page_to_markdown(t):
    return M.to_markdown(t.pages)


RICH_MD = """CASE i % 6 WHEN 0 THEN '## [' || e || '](/posts/line-number-' || i || '#top)'
    WHEN 1 THEN ltrim(e || ' see [mention here](/2024/mention-' || i || ')[^fn' || (i // 6 + 1) || ']')
    WHEN 2 THEN '**T' || i || '**' || chr(10) || chr(10) || '**Over**' || chr(10) || chr(10) || '| a | b |  |' || chr(10) || '| --- | --- | --- |' || chr(10) || '| ' || i || ' | x\\|y | z |' || chr(10) || '|  | w |  |'
    WHEN 3 THEN '![Caption ' || i || '](https://s' || doc_id || '.example/img/' || i || '.png)' || chr(10) || chr(10) || '![](https://s' || doc_id || '.example/img/' || i || '.png)'
    WHEN 4 THEN '- one **bold**' || chr(10) || '- two' || chr(10) || '  - nested'
    ELSE '```' || chr(10) || 'code ' || i || chr(10) || '```' || chr(10) || chr(10) || 'layout' END"""


@query("rich_page_to_markdown", "fx_docs", f"""{rich_lines()},
    l AS (SELECT *, {D.escape_tags("regexp_replace(line, '([*_])', '\\\\\\1', 'g')")} AS e FROM rl),
    b AS (SELECT doc_id, i, {RICH_MD} AS md, CASE WHEN i % 6 = 1 THEN '[^fn' || (i // 6 + 1) || ']: Note ' || i || '.' END AS note FROM l)
    SELECT doc_id AS page_id, CASE WHEN doc_id % 5 = 0 THEN '# Stay Connected' || chr(10) || chr(10) ELSE '' END || '## Story ' || doc_id || ' part' || chr(10) || chr(10)
        || string_agg(md, chr(10) || chr(10) ORDER BY i) || chr(10) || chr(10) || CASE WHEN count(note) = 0 THEN '## Notes' || chr(10) || chr(10) ELSE '' END || '## After' || chr(10) || chr(10) || 'tail text'
        || coalesce(chr(10) || chr(10) || string_agg(note, chr(10) || chr(10) ORDER BY i) FILTER (note IS NOT NULL), '') AS md FROM b GROUP BY doc_id""")
def rich_page_to_markdown(t):
    return M.to_markdown(t.fx_rich_pages)


def records(t):
    pages = S.with_nodes(t.fx_rich_pages, only=P.RECORD_TAGS, html=True)
    return P.article_records(pages, M.to_markdown(t.fx_rich_pages))


@query("article_record", "fx_docs", """
    SELECT doc_id AS page_id, CASE WHEN doc_id % 5 = 0 THEN 'Stay Connected' WHEN doc_id % 3 = 2 THEN 'Site Name' ELSE 'Story ' || doc_id || ' part' END AS title, 'Writer ' || doc_id AS author,
           '2024-02-1' || (doc_id % 10) AS day, lang AS language, doc_id % 8 IN (3, 5) AS paywalled, false AS unreadable FROM fx_docs""")
def article_record(t):
    return records(t).select("page_id", "title", "author", F.date_format("published_at", "yyyy-MM-dd").alias("day"), "language", "paywalled", "unreadable")


@query("html_paragraph_parse")
def html_paragraph_parse(t):
    return paragraphs(S.with_nodes(t.pages, only=("p",)))


def paragraphs(pages):
    """Paragraph elements of a transcript page, without timing."""
    texts = F.transform(S.tagged("p"), lambda n: P.collapse(S.text_of(n)))
    rows = pages.select("page_id", F.posexplode(texts).alias("seq", "text"))
    return rows.filter("text <> ''").withColumns({"start_s": F.lit(0.0), "duration_s": F.lit(0.0)})


@query("html_paragraph_parse_rich", "fx_docs", f"""{rich_lines()},
    p AS (SELECT doc_id, i, {D.collapse("line || ' see mention here ' || (i % 1000)")} AS text FROM rl WHERE i % 6 = 1 UNION ALL SELECT doc_id, 1000000, 'tail text' FROM fx_docs)
    SELECT doc_id AS page_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INTEGER AS seq, text, 0.0::DOUBLE AS start_s, 0.0::DOUBLE AS duration_s FROM p""")
def html_paragraph_parse_rich(t):
    return paragraphs(rich(t, "p"))


@query("discovery_expansion", "fx_docs", f"""{rich_lines()},
    s AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 0 WHEN doc_id % 9 < 3 THEN 3 WHEN doc_id % 9 < 6 THEN 4 ELSE 5 END AS strategy FROM fx_docs),
    links AS (SELECT doc_id, href, row_number() OVER (PARTITION BY doc_id ORDER BY uncertain, i) AS place, uncertain FROM (
        SELECT doc_id, i, 'https://s' || doc_id || '.example/posts/line-number-' || i AS href, false AS uncertain FROM rl WHERE i % 6 = 0 AND ({D.collapse('line')} = '' OR regexp_matches(line, '\\p{{L}}'))
        UNION ALL SELECT doc_id, i, 'https://s' || doc_id || '.example/2024/mention-' || i, true FROM rl WHERE i % 6 = 1) QUALIFY place <= 250)
    SELECT doc_id AS job_id, strategy, 0 AS item_index, 'https://s' || doc_id || '.example/fr/read/page-' || doc_id AS url, false AS uncertain FROM s WHERE strategy = 0
    UNION ALL SELECT doc_id, strategy, k, 'https://e.example/' || doc_id || '/' || k, false FROM s, (VALUES (0), (1)) v(k) WHERE strategy IN (3, 4)
    UNION ALL SELECT doc_id, strategy, place - 1, href, uncertain FROM s JOIN links USING (doc_id) WHERE strategy = 5""")
def discovery_expansion(t):
    nodes = rich(t, "link")
    sources = t.fx_rich_pages.select(F.col("page_id").alias("job_id"), F.lit(0).alias("source_index"), "url", F.lit("how").alias("query"))
    keyed = t.fx_rich_pages.select("page_id", "url")
    pages = keyed.select("url", F.concat(F.lit("Story "), "page_id").alias("title"), F.lit(False).alias("reads_as_article"))
    declared = P.declared_feeds(nodes).join(keyed, "page_id").select("url", "rank", "feed_url")
    links = A.article_links(A.page_facts(t.fx_rich_pages)).join(keyed, "page_id").select("url", "place", "href", "title", "uncertain")
    k = F.col("page_id") % 9
    feed = F.when(k < 3, F.concat(F.lit("https://s"), "page_id", F.lit(".example/feed.xml"))).when(k < 6, F.concat(F.lit("https://s"), "page_id", F.lit(".example/rss")))
    entries = t.fx_rich_pages.select(feed.alias("feed_url"), "page_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("pos")).filter("feed_url IS NOT NULL").select(
        "feed_url", "pos", F.lit("Entry").alias("title"), F.concat(F.lit("https://e.example/"), "page_id", F.lit("/"), "pos").alias("item_url"), F.lit(None).cast("string").alias("audio_url"))
    return E.expand_sources(sources, pages, declared, entries, links).select("job_id", "strategy", "item_index", "url", "uncertain")


@query("chapter_drafts")
def chapter_drafts(t):
    items = t.fx_items.select("id", "title", "doc_id", "url", "item_type", F.lit(None).cast("string").alias("title_suffix"),
                              F.when(F.col("doc_id") % 2 == 0, F.lit("# Summary\n\nOnly this.")).alias("preview_md"))
    texts = t.fx_items.join(t.fx_docs, "doc_id").filter("item_type <> 'blog' AND has_transcript").select(
        "url", F.col("text").alias("md"), "lang", F.lit("Uploader").alias("uploader"), F.lit(None).cast("string").alias("channel_url")).withColumnRenamed("lang", "language")
    md = t.fx_items.join(t.fx_md_docs.select("doc_id", "md"), "doc_id").filter("item_type = 'blog' AND doc_id % 4 <> 1").select(
        "url", "md", F.lit(None).cast("string").alias("language"), F.lit("Writer").alias("author"), "paywalled")
    return E.draft_chapters(items.drop("doc_id"), texts, md)


D_SUMMARY = E.SUMMARY_ONLY.replace("'", "''")


@query("chapter_draft_records", "fx_items fx_docs", f"""
    j AS (SELECT i.id, i.item_type, i.url, i.doc_id, i.paywalled, d.text, d.lang, i.item_type <> 'blog' AND i.has_transcript IS NOT DISTINCT FROM true AS heard,
        i.item_type = 'blog' AND i.doc_id % 4 <> 1 AS loaded, {WORDS.replace('text', 'd.text')} AS ws FROM fx_items i JOIN fx_docs d USING (doc_id)),
    c AS (SELECT *, {BEST} AS best, CASE WHEN heard OR loaded THEN text WHEN item_type = 'blog' AND doc_id % 2 = 0 THEN '## Summary' || chr(10) || chr(10) || 'Only this.' ELSE '' END AS content FROM j),
    r AS (SELECT *, CASE WHEN loaded AND paywalled THEN '{J.PAYWALLED}' WHEN item_type = 'youtube' AND NOT heard THEN '{J.NO_SUBTITLES}'
        WHEN item_type = 'podcast' AND NOT heard THEN '{J.NO_TRANSCRIPTION}' WHEN {D.blank('content')} THEN '{J.NO_CONTENT}' END AS reason FROM c)
    SELECT id, item_type, 'Story of things' AS title, url AS source_url, CASE WHEN item_type = 'youtube' AND heard THEN 'Uploader' WHEN loaded THEN 'Writer' END AS author, NULL::VARCHAR AS channel_url,
        CASE WHEN reason IS NULL THEN content END AS content_md, CASE WHEN reason IS NULL THEN CASE WHEN heard THEN lang WHEN loaded AND best.hits >= 20 THEN best.lang END END AS language,
        CASE WHEN reason IS NULL AND item_type = 'blog' AND NOT loaded THEN '{D_SUMMARY}' END AS note, reason AS skip_reason FROM r""")
def chapter_draft_records(t):
    """Drafts whose texts hold no headings, so that every column is known."""
    none = F.lit(None).cast("string")
    items = t.fx_items.select("id", F.lit("Story of things").alias("title"), "doc_id", "url", "item_type", none.alias("title_suffix"),
                              F.when(F.col("doc_id") % 2 == 0, F.lit("# Summary\n\nOnly this.")).alias("preview_md"))
    both = t.fx_items.join(t.fx_docs, "doc_id")
    texts = both.filter("item_type <> 'blog' AND has_transcript").select(
        "url", F.col("text").alias("md"), F.col("lang").alias("language"), F.lit("Uploader").alias("uploader"), none.alias("channel_url"))
    md = both.filter("item_type = 'blog' AND doc_id % 4 <> 1").select("url", F.col("text").alias("md"), none.alias("language"), F.lit("Writer").alias("author"), "paywalled")
    return E.draft_chapters(items.drop("doc_id"), texts, md)
