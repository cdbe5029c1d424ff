"""Input tables derived from the given Parquet tables.

Every fixture is one SQL text that both Spark and DuckDB run, so a query and its oracle read the
same rows. Only integer arithmetic on keys: no clock, no random numbers. Grouping keys grow with
the data (a query, a book or a feed is a slice of a source, never a whole one).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from leafmill.sources.tables import read_table

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


class SparkSql:
    name = "spark"

    @staticmethod
    def micros(c: str) -> str:
        return f"unix_micros(cast({c} as timestamp))"

    @staticmethod
    def moment(seconds: str) -> str:
        """A timestamp so many seconds after 1970."""
        return f"timestamp_seconds({seconds})"

    @staticmethod
    def repeated(condition: str) -> str:
        """A join that gives rows with ``condition`` twice."""
        return f"LATERAL VIEW explode(sequence(1, CASE WHEN {condition} THEN 2 ELSE 1 END)) AS again"

    @staticmethod
    def words(table: str, key: str, text: str) -> str:
        return (
            f"SELECT {key}, cast(p as bigint) AS pos, w AS word FROM {table} "
            f"LATERAL VIEW posexplode(filter(split({text}, '[ \\n]'), x -> x <> '')) AS p, w"
        )

    @staticmethod
    def lines(text: str) -> str:
        return f"split({text}, '\\n')"

    @staticmethod
    def split_words(text: str) -> str:
        return f"filter(split({text}, '[ \\n]'), x -> x <> '')"

    @staticmethod
    def map_lines(items: str, body: str) -> str:
        return f"transform({items}, (x, i) -> {body.format(x='x', i='i')})"

    @staticmethod
    def join_lines(items: str, sep: str) -> str:
        return f"array_join({items}, {sep})"

    @staticmethod
    def first_words(text: str, n: int) -> str:
        return f"array_join(slice(filter(split({text}, '[ \\n]'), x -> x <> ''), 1, {n}), ' ')"

    @staticmethod
    def numbers(upto: str) -> str:
        return f"explode(sequence(cast(0 as bigint), cast({upto} as bigint)))"

    @staticmethod
    def agg(value: str, order: str, sep: str) -> str:
        return (
            f"array_join(transform(array_sort(collect_list(struct({order} AS o, {value} AS v))), x -> x.v), {sep})"
        )

    nl = "'\\n'"
    bs = "'\\\\'"

    @staticmethod
    def drop_digits(c: str) -> str:
        return f"regexp_replace({c}, '[0-9]', '')"

    @staticmethod
    def drop_every(c: str, n: int) -> str:
        return f"array_join(filter(split({c}, ' '), (x, i) -> i % {n} <> {n - 1}), ' ')"

    @staticmethod
    def js(c: str) -> str:
        """A string as a JSON string literal."""
        return f"substr(to_json(named_struct('v', {c})), 6, length(to_json(named_struct('v', {c}))) - 6)"


class DuckSql:
    name = "duckdb"

    @staticmethod
    def micros(c: str) -> str:
        return f"epoch_us({c})"

    @staticmethod
    def moment(seconds: str) -> str:
        return f"make_timestamp(cast(({seconds}) * 1000000 as bigint))"

    @staticmethod
    def repeated(condition: str) -> str:
        return f", unnest(generate_series(1, CASE WHEN {condition} THEN 2 ELSE 1 END)) AS r(again)"

    @staticmethod
    def words(table: str, key: str, text: str) -> str:
        return (
            f"SELECT {key}, cast(s.p - 1 as bigint) AS pos, s.w AS word FROM (SELECT {key}, "
            f"unnest(list_transform(list_filter(regexp_split_to_array({text}, '[ \\n]'), lambda x: x <> ''), "
            f"lambda x, i: {{'w': x, 'p': i}})) AS s FROM {table})"
        )

    @staticmethod
    def lines(text: str) -> str:
        return f"string_split({text}, chr(10))"

    @staticmethod
    def split_words(text: str) -> str:
        return f"list_filter(regexp_split_to_array({text}, '[ \\n]'), lambda x: x <> '')"

    @staticmethod
    def map_lines(items: str, body: str) -> str:
        return f"list_transform({items}, lambda x, i: {body.format(x='x', i='(i-1)')})"

    @staticmethod
    def join_lines(items: str, sep: str) -> str:
        return f"array_to_string({items}, {sep})"

    @staticmethod
    def first_words(text: str, n: int) -> str:
        return f"array_to_string((list_filter(regexp_split_to_array({text}, '[ \\n]'), lambda x: x <> ''))[1:{n}], ' ')"

    @staticmethod
    def numbers(upto: str) -> str:
        return f"unnest(generate_series(0, {upto}))"

    @staticmethod
    def agg(value: str, order: str, sep: str) -> str:
        return f"string_agg({value}, {sep} ORDER BY {order})"

    nl = "chr(10)"
    bs = "chr(92)"

    @staticmethod
    def drop_digits(c: str) -> str:
        return f"regexp_replace({c}, '[0-9]', '', 'g')"

    @staticmethod
    def drop_every(c: str, n: int) -> str:
        return f"array_to_string(list_filter(string_split({c}, ' '), lambda x, i: (i-1) % {n} <> {n - 1}), ' ')"

    @staticmethod
    def js(c: str) -> str:
        return f"cast(to_json({c}) as varchar)"


FIXTURES: dict[str, tuple[tuple[str, ...], object]] = {}


def fixture(name: str, *needs: str):
    def register(build):
        FIXTURES[name] = (needs, build)
        return build

    return register


@fixture("fx_page_titles")
def _page_titles(d):
    return """
    SELECT page_id, url, html, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title,
           regexp_extract(url, '//([^/]*)', 1) AS netloc
    FROM pages"""


@fixture("fx_hits", "fx_page_titles")
def _hits(d):
    return """
    SELECT cast(floor(page_id / 50) as bigint) AS query_id,
           CASE page_id % 3 WHEN 0 THEN 'video' WHEN 1 THEN 'web' ELSE 'podcast' END AS provider,
           cast(CASE page_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 0 ELSE 2 END as int) AS arrival,
           cast(page_id % 50 as bigint) AS pos,
           concat('hit:', cast(page_id as string)) AS id,
           CASE page_id % 3 WHEN 0 THEN 'video' WHEN 1 THEN 'web' ELSE 'episode' END AS type,
           title,
           CASE WHEN page_id % 10 = 3 THEN concat('https://', netloc, '/shop/', cast(page_id as string))
                WHEN page_id % 40 = 5 THEN concat('https://jobs.', netloc, '/en/posting')
                WHEN page_id % 20 = 9 THEN concat('https://', netloc, '/files/Report-', cast(page_id as string), '.Pdf?x=1')
                WHEN page_id % 20 = 15 THEN concat('https://', netloc, '/?s=', cast(page_id as string))
                WHEN page_id % 60 = 11 THEN 'https://m.youtube.com/watch?v=abcdef'
                WHEN page_id % 20 = 1 THEN concat('https://', netloc, '/fr/10-best-products')
                WHEN page_id % 7 = 0 THEN concat('https://www.', netloc, '/en-us/')
                ELSE url END AS url,
           CASE WHEN page_id % 4 = 0 THEN NULL ELSE netloc END AS author,
           cast(CASE WHEN page_id % 3 = 1 THEN NULL ELSE 60 + page_id * 37 % 7200 END as int) AS duration_s,
           CASE WHEN page_id % 6 = 5 THEN NULL ELSE (page_id * 17 % 301) / cast(100 as double) END AS relevance,
           CASE WHEN page_id % 5 = 0 THEN NULL
                WHEN page_id % 5 = 1 THEN concat('2024-0', cast(1 + page_id % 9 as string), '-1', cast(page_id % 10 as string), 'T08:00:00Z')
                WHEN page_id % 5 = 2 THEN concat('2024-0', cast(1 + page_id % 9 as string), '-2', cast(page_id % 9 as string), 'T10:30:00+02:00')
                WHEN page_id % 5 = 3 THEN concat('2023-1', cast(page_id % 3 as string), '-0', cast(1 + page_id % 9 as string))
                ELSE 'yesterday' END AS published_at,
           CASE WHEN page_id % 2 = 0 THEN concat('  Snippet of ', title, chr(10), repeat('more text ', cast(page_id % 40 as int))) ELSE NULL END AS snippet,
           CASE WHEN page_id % 9 = 2 THEN 'Science' ELSE NULL END AS genre
    FROM fx_page_titles"""


@fixture("fx_queries", "fx_page_titles")
def _queries(d):
    return f"""
    SELECT cast(floor(page_id / 50) as bigint) AS query_id,
           CASE WHEN cast(floor(page_id / 50) as bigint) % 2 = 0 THEN {d.first_words('title', 2)}
                ELSE regexp_extract(netloc, '([^.]*)[.][a-z]*$', 1) END AS query
    FROM fx_page_titles WHERE page_id % 50 = 0"""


@fixture("fx_links", "fx_page_titles")
def _links(d):
    p = "cast(page_id as string)"
    return f"""
    SELECT page_id AS link_id, CASE page_id % 25
        WHEN 0 THEN concat('https://www.youtube.com/watch?v=abc123X', {p})
        WHEN 1 THEN concat('https://www.youtube.com/watch?v=abc123X', {p}, '&list=PL1')
        WHEN 2 THEN concat('https://youtu.be/abc123XYZ', {p}, '?t=30')
        WHEN 3 THEN concat('https://www.youtube.com/shorts/abc123XYZ', {p})
        WHEN 4 THEN concat('https://youtube.com/live/abc123XYZ', {p}, '?si=x')
        WHEN 5 THEN concat('https://www.youtube.com/playlist?list=PL', {p})
        WHEN 6 THEN concat('https://www.youtube.com/@name', {p}, '/streams')
        WHEN 7 THEN concat('https://www.youtube.com/channel/UC', {p})
        WHEN 8 THEN concat('https://cdn.example/show/my_ep-', {p}, '.mp3')
        WHEN 9 THEN concat('https://cdn.example/show/Episode', {p}, '.m4a?token=x')
        WHEN 10 THEN concat('https://en.wikipedia.org/wiki/Stoic_', {p}, '_%C3%A9t%C3%A9')
        WHEN 11 THEN concat('https://fr.m.wikipedia.org/wiki/Sp%C3%A9cial:Page', {p})
        WHEN 12 THEN concat('http://', cast(page_id % 256 as string), '.', cast(page_id * 7 % 256 as string), '.0.', cast(page_id % 200 as string), ':8080/x')
        WHEN 13 THEN concat('http://192.168.', cast(page_id % 256 as string), '.1/admin')
        WHEN 14 THEN concat('https://docs.', netloc, '/')
        WHEN 15 THEN concat('https://', netloc, '/en/')
        WHEN 16 THEN concat('ftp://', netloc, '/file-', {p})
        WHEN 17 THEN concat('https://', netloc, '/posts/hello-world_', {p}, '-1706096.html')
        WHEN 18 THEN concat('http://[fd00::', {p}, ']/x')
        WHEN 19 THEN concat('http://172.', cast(page_id % 64 as string), '.3.4/')
        ELSE url END AS url,
        CASE WHEN page_id % 4 = 0 THEN concat(' ', title) WHEN page_id % 4 = 1 THEN '  ' ELSE NULL END AS name,
        CASE WHEN page_id % 3 = 0 THEN title ELSE NULL END AS title
    FROM fx_page_titles"""


@fixture("fx_verdicts", "fx_hits")
def _verdicts(d):
    base = """SELECT cast(floor(l.doc_id / 50) as bigint) AS query_id, cast(l.doc_id % 50 as bigint) AS pos,
           cast(0 as bigint) AS verdict_no, l.quality = 1 AS compilable, (l.doc_id % 31) / cast(10 as double) AS relevance,
           CASE l.doc_id % 4 WHEN 0 THEN 'intro' WHEN 1 THEN 'intermediate' WHEN 2 THEN 'expert' ELSE 'any' END AS level
        FROM labels l"""
    return f"""
    {base}
    UNION ALL
    SELECT cast(floor(l.doc_id / 50) as bigint), cast(l.doc_id % 50 as bigint), cast(1 as bigint),
           l.quality <> 1, cast(3 as double), 'intro' FROM labels l WHERE l.doc_id % 6 = 0
    UNION ALL
    SELECT cast(floor(l.doc_id / 50) as bigint), cast(1000 + l.doc_id % 50 as bigint), cast(2 as bigint),
           true, cast(3 as double), 'intro' FROM labels l WHERE l.doc_id % 17 = 0"""


@fixture("fx_query_verdicts", "fx_queries")
def _query_verdicts(d):
    return """
    SELECT query_id, CASE WHEN query_id % 2 = 0 THEN 'recent' ELSE 'any' END AS freshness,
           CASE query_id % 3 WHEN 0 THEN 'intermediate' WHEN 1 THEN 'any' ELSE 'intro' END AS level
    FROM fx_queries"""


@fixture("fx_segments")
def _segments(d):
    return """
    SELECT conv_id AS transcript_id, turn AS seq, text,
           cast(turn * 10 + (conv_id * 7 + turn * 3) % 5 as double) AS start_s,
           cast(8 + turn % 3 as double) AS duration_s,
           CASE WHEN conv_id % 4 = 0 THEN NULL WHEN conv_id % 5 = 1 THEN concat('speaker_', cast(floor(turn / 3) as bigint) % 2) ELSE role END AS speaker
    FROM conversations"""


@fixture("fx_lines", "fx_segments")
def _caption_lines(d):
    """Segments cut to single lines: many short rows per transcript."""
    if d.name == "spark":
        rows = f"SELECT transcript_id, seq, speaker, cast(p as bigint) AS line, w FROM fx_segments LATERAL VIEW posexplode({d.lines('text')}) AS p, w"
    else:
        rows = (
            "SELECT transcript_id, seq, speaker, cast(s.p - 1 as bigint) AS line, s.w AS w FROM (SELECT transcript_id, seq, speaker, "
            f"unnest(list_transform({d.lines('text')}, lambda x, i: {{'w': x, 'p': i}})) AS s FROM fx_segments)"
        )
    return f"""
    SELECT transcript_id, seq * 1000 + line AS seq, w AS text, speaker,
           cast(seq * 400 + line * 4 + (transcript_id + line) % 3 * 0.5 as double) AS start_s, cast(4 as double) AS duration_s
    FROM ({rows}) AS cut"""


@fixture("fx_chapter_marks", "fx_segments")
def _chapter_marks(d):
    return f"""
    SELECT transcript_id, mark_no, CASE WHEN transcript_id % 11 = 0 AND mark_no = 1 THEN NULL
             ELSE concat('Part <', cast(mark_no as string), '>') END AS title,
           cast(CASE mark_no WHEN 0 THEN 5 WHEN 1 THEN 25 WHEN 2 THEN CASE WHEN transcript_id % 2 = 0 THEN 25 ELSE 30 END ELSE 45 END as double) AS start_s,
           cast(90 as double) AS total_s
    FROM (SELECT transcript_id, {d.numbers('3')} AS mark_no FROM (SELECT DISTINCT transcript_id FROM fx_segments) AS t WHERE transcript_id % 3 <> 0) AS m"""


@fixture("fx_docs")
def _docs(d):
    return "SELECT doc_id, text, lang, source FROM documents"


@fixture("fx_md_docs")
def _md_docs(d):
    body = d.map_lines(
        d.lines("text"),
        "CASE WHEN ({i} + doc_id) % 5 = 0 AND doc_id % 7 <> 0 THEN concat(repeat('#', cast(1 + (doc_id + {i}) % 4 as int)), ' ', {x}) "
        "WHEN {i} % 9 = 3 THEN '```' WHEN {i} % 9 = 4 THEN concat('# not a heading ', {x}) WHEN {i} % 9 = 6 THEN '```' "
        "WHEN {i} % 9 = 7 THEN concat('- ', {x}) WHEN {i} % 13 = 8 THEN concat('> ', {x}) "
        "WHEN {i} % 11 = 2 THEN concat({x}, '[^fn', cast({i} % 4 + 1 as string), ']') ELSE {x} END",
    )
    return f"""
    SELECT doc_id, {d.first_words('text', 6)} AS title,
           CASE WHEN doc_id % 3 = 0 THEN concat('[Home](https://x.example/)', {d.nl}, {d.nl}, {d.nl}, '# ', {d.first_words('text', 6)}, {d.nl}, {d.nl}, {d.join_lines(body, d.nl)})
                WHEN doc_id % 3 = 1 THEN concat('## [', {d.first_words('text', 6)}, '](https://x.example/a)', {d.nl}, {d.join_lines(body, f'concat({d.nl}, {d.nl})')}, {d.nl}, {d.nl}, '[^fn1]: a note', {d.nl}, '    more of it', {d.nl}, {d.nl}, '[^fn2]: two')
                ELSE {d.join_lines(body, f'concat({d.nl}, {d.nl})')} END AS md
    FROM documents"""


@fixture("fx_md_images")
def _md_images(d):
    p = "cast(doc_id as string)"
    return f"""
    SELECT doc_id, concat(translate(text, '$*#[', ''), ' ![a [b] c](https://img.example/', cast(doc_id % 97 as string), '.png "t") and [link](https://x.example/', {p},
        ') ![local](media/x.png) ', CASE WHEN doc_id % 2 = 1 THEN '$$E = mc$$ ' ELSE '' END, '`code` $x^2$ costs $10 and $20 [^c1fn', cast(doc_id % 3 as string), '] H<sub>2</sub>O x<sup>2</sup> ',
        CASE WHEN doc_id % 2 = 0 THEN concat('![](http://img.example/', cast(doc_id % 89 as string), '.jpg) **bold** *it*') ELSE '' END,
        {d.nl}, translate(text, '$*#[', '')) AS md
    FROM documents"""


@fixture("fx_manifest", "fx_md_images")
def _manifest(d):
    return """
    SELECT DISTINCT concat('https://img.example/', cast(doc_id % 97 as string), '.png') AS url, concat('media/', cast(doc_id % 97 as string), '.png') AS path
    FROM documents WHERE doc_id % 97 % 3 <> 0
    UNION ALL
    SELECT DISTINCT concat('http://img.example/', cast(doc_id % 89 as string), '.jpg'), concat('media/', cast(doc_id % 89 as string), '.jpg')
    FROM documents WHERE doc_id % 89 % 3 <> 0"""


@fixture("fx_chapters")
def _chapters(d):
    return f"""
    SELECT concat(source, '-', cast(cast(floor(doc_id / 200) as bigint) as string)) AS book_id, doc_id AS chapter_no,
           {d.first_words('text', 5)} AS title,
           CASE WHEN length(source) = 4 THEN CASE doc_id % 4 WHEN 1 THEN 'youtube' WHEN 2 THEN 'podcast' ELSE 'blog' END
                WHEN source IN ('src10', 'src11', 'src12') THEN 'youtube' ELSE 'blog' END AS source_type,
           concat('https://', CASE WHEN source = 'src15' THEN concat('h', cast(doc_id % 3 as string)) ELSE source END, '.example/', cast(doc_id as string)) AS source_url,
           CASE WHEN doc_id % 6 = 0 THEN NULL WHEN doc_id % 6 = 1 THEN ' ' ELSE concat(' Author <', cast(cast(floor(doc_id / 40) as bigint) % 4 as string), '> ') END AS author,
           CASE WHEN doc_id % 3 = 0 THEN NULL ELSE concat('2024-01-', cast(10 + doc_id % 19 as string)) END AS published,
           CASE WHEN doc_id % 50 = 0 THEN concat(' ', {d.nl}) ELSE concat('See note[^fn1] and[^fn2].', {d.nl}, {d.nl}, text) END AS content_md,
           CASE WHEN doc_id % 9 = 0 THEN NULL ELSE lang END AS language,
           CASE WHEN source = 'src11' THEN 'https://yt.example/c1' WHEN source = 'src12' THEN concat('https://yt.example/c', cast(doc_id % 2 as string)) ELSE NULL END AS channel_url
    FROM documents"""


@fixture("fx_pairs")
def _pairs(d):
    src = f"replace(text, {d.nl}, concat({d.nl}, {d.nl}))"
    return f"""
    SELECT doc_id AS pair_id, concat(title, ' ', cast(doc_id as string)) AS title, src_md,
           CASE doc_id % 5 WHEN 0 THEN src_md WHEN 1 THEN {d.drop_every('src_md', 8)}
                WHEN 2 THEN concat('Here is the corrected text. ', src_md)
                WHEN 3 THEN concat(src_md, {d.nl}, {d.nl}, '[Applause] Link in the description. This video is sponsored by a promo code.')
                ELSE {d.drop_digits('src_md')} END AS out_md
    FROM (SELECT doc_id, {d.first_words('text', 3)} AS title,
                 concat({src}, CASE WHEN doc_id % 3 = 0 THEN concat({d.nl}, {d.nl}, 'In 19', cast(10 + doc_id % 90 as string), ' it was 1,', cast(100 + doc_id % 900 as string), ' of 12.5 or so.') ELSE '' END) AS src_md
          FROM documents) AS t"""


@fixture("fx_titles")
def _titles(d):
    wrap = """CASE {k} % 8 WHEN 0 THEN concat('#', cast({k} as string), ' - ', t) WHEN 1 THEN concat(t, ' | Some Show')
        WHEN 2 THEN upper(replace(t, 'ß', 'ss')) WHEN 3 THEN concat(upper(replace(t, 'ß', 'ss')), ' - Motivational speech') WHEN 4 THEN concat('Episode ', cast({k} % 50 as string), ': ', t, ' - YouTube')
        WHEN 5 THEN concat('  ', t, '  (', cast({k} as string), ') ') WHEN 6 THEN concat('NASA ', t) ELSE t END"""
    return f"""
    SELECT doc_id AS item_id, {wrap.format(k='doc_id')} AS title, cast(600 + doc_id % 400 as bigint) AS duration_s
    FROM (SELECT doc_id, {d.first_words('text', 8)} AS t FROM documents) AS x"""


@fixture("fx_items")
def _items(d):
    return f"""
    SELECT cast(floor(doc_id / 100) as bigint) AS job_id, cast(floor(doc_id / 20) as bigint) % 5 AS source_index, doc_id % 20 AS item_index,
           concat(cast(cast(floor(doc_id / 100) as bigint) as string), '-', cast(cast(floor(doc_id / 20) as bigint) % 5 as string), '-', cast(doc_id % 20 as string)) AS id,
           CASE WHEN doc_id % 10 < 3 THEN concat('Shared Title! ', cast(doc_id % 3 as string)) ELSE {d.first_words('text', 6)} END AS title,
           CASE WHEN doc_id % 13 = 0 THEN concat('https://en.wikipedia.org/wiki/T', cast(doc_id as string)) ELSE concat('https://www.', source, '.example/p/', cast(doc_id as string)) END AS url,
           CASE doc_id % 3 WHEN 0 THEN 'youtube' WHEN 1 THEN 'podcast' ELSE 'blog' END AS item_type,
           CASE doc_id % 5 WHEN 0 THEN NULL WHEN 1 THEN false ELSE true END AS has_transcript,
           CASE doc_id % 7 WHEN 0 THEN NULL WHEN 1 THEN false WHEN 2 THEN false ELSE true END AS is_punctuated,
           CASE WHEN doc_id % 6 = 0 THEN NULL ELSE cast(floor(n_chars / 6) as bigint) END AS word_count,
           CASE WHEN doc_id % 8 = 0 THEN NULL ELSE 600 + doc_id % 400 END AS duration_s,
           n_chars AS size_chars, doc_id % 11 = 0 AS uncertain,
           CASE WHEN doc_id % 17 = 0 THEN 'Likely off-topic' ELSE NULL END AS set_aside,
           doc_id % 19 = 0 AS paywalled, doc_id % 23 = 0 AS unreadable, doc_id % 4 <> 3 AS selected,
           CASE WHEN doc_id % 12 = 5 THEN 'Declared Site' ELSE NULL END AS site_name, doc_id
    FROM documents"""


@fixture("fx_sources")
def _sources(d):
    return """
    SELECT DISTINCT cast(floor(doc_id / 100) as bigint) AS job_id, cast(floor(doc_id / 20) as bigint) % 5 AS source_index,
           concat('https://s', cast(cast(floor(doc_id / 20) as bigint) as string), '.example/feed') AS url,
           CASE cast(floor(doc_id / 20) as bigint) % 4 WHEN 0 THEN NULL WHEN 1 THEN ' ' ELSE concat('Source ', cast(cast(floor(doc_id / 20) as bigint) % 7 as string)) END AS name,
           CASE WHEN cast(floor(doc_id / 20) as bigint) % 3 = 0 THEN 'A title' ELSE NULL END AS title,
           CASE WHEN cast(floor(doc_id / 20) as bigint) % 2 = 0 THEN 'how it works' ELSE NULL END AS query,
           CASE WHEN cast(floor(doc_id / 100) as bigint) % 4 = 3 THEN 'unreadable' WHEN cast(floor(doc_id / 100) as bigint) % 8 = 6 THEN 'refused'
                WHEN cast(floor(doc_id / 20) as bigint) % 6 = 5 THEN 'refused' ELSE NULL END AS problem
    FROM documents"""


@fixture("fx_item_verdicts", "fx_items")
def _item_verdicts(d):
    return """
    SELECT cast(floor(l.doc_id / 100) as bigint) AS job_id, cast(floor(l.doc_id / 20) as bigint) % 5 AS source_index, l.doc_id % 20 AS item_index,
           cast(0 as bigint) AS verdict_no, l.quality = 1 AS compilable, (l.doc_id % 31) / cast(10 as double) AS relevance FROM labels l
    UNION ALL
    SELECT cast(floor(l.doc_id / 100) as bigint), cast(floor(l.doc_id / 20) as bigint) % 5, l.doc_id % 20, cast(1 as bigint), l.quality <> 1, cast(0.1 as double)
    FROM labels l WHERE l.doc_id % 4 = 0"""


@fixture("fx_transcripts")
def _transcripts(d):
    return """
    SELECT CASE WHEN conv_id % 3 = 0 THEN concat('https://audio.example/', cast(conv_id as string), '.mp3') ELSE concat('vid', cast(conv_id as string)) END AS key,
           CASE conv_id % 5 WHEN 0 THEN 'en' WHEN 1 THEN 'en-US' WHEN 2 THEN 'fr' WHEN 3 THEN 'eng' ELSE 'de-DE' END AS language,
           role AS uploader, turn AS stored_at, text FROM conversations"""


@fixture("fx_tracks")
def _tracks(d):
    return f"""
    SELECT conv_id AS video_id, track_no,
           CASE (conv_id + track_no) % 6 WHEN 0 THEN 'en' WHEN 1 THEN 'fr-FR' WHEN 2 THEN 'de' WHEN 3 THEN 'en-US' WHEN 4 THEN 'es' ELSE 'xx1' END AS language_code,
           CASE WHEN (conv_id + track_no * 3) % 4 < 2 THEN 'asr' ELSE 'manual' END AS kind,
           CASE WHEN conv_id % 7 = 0 THEN 'fr' WHEN conv_id % 7 = 1 THEN 'de-DE' ELSE NULL END AS wanted,
           CASE WHEN conv_id % 3 = 0 THEN 'fr' WHEN conv_id % 3 = 1 THEN 'de-DE' ELSE NULL END AS original
    FROM (SELECT conv_id, {d.numbers('4')} AS track_no FROM (SELECT DISTINCT conv_id FROM conversations) AS c) AS t
    WHERE (conv_id * 3 + track_no) % 4 <> 1"""


@fixture("fx_audio_tracks")
def _audio_tracks(d):
    return f"""
    SELECT conv_id AS video_id, track_no,
           concat(CASE (conv_id + track_no) % 4 WHEN 0 THEN 'en-US' WHEN 1 THEN 'fr-FR' WHEN 2 THEN 'de' ELSE 'es' END, '.', cast(track_no as string)) AS id,
           (conv_id + track_no) % 3 = 0 AS is_dubbed, conv_id % 5 = track_no AS is_default,
           CASE WHEN (conv_id + track_no) % 5 = 2 THEN 'Voice ORIGINAL' ELSE 'Voice' END AS display_name
    FROM (SELECT conv_id, {d.numbers('2')} AS track_no FROM (SELECT DISTINCT conv_id FROM conversations) AS c) AS t WHERE conv_id % 4 <> 3"""


@fixture("fx_state_events")
def _state_events(d):
    return f"""
    SELECT user_id % 30 + 30 * cast(floor(event_id / 2000) as bigint) AS job_id, user_id AS item_id, {d.micros('ts')} AS ts_us, event_id,
           CASE event_type WHEN 'view' THEN 'pending' WHEN 'click' THEN 'compiling' WHEN 'purchase' THEN 'done' WHEN 'signup' THEN 'skipped' ELSE 'failed' END AS state,
           CASE WHEN event_type = 'error' THEN CASE WHEN event_id % 3 = 0 THEN 'rate limited' ELSE 'crashed' END WHEN event_type = 'signup' THEN 'no text' ELSE NULL END AS note
    FROM events"""


@fixture("fx_calls")
def _calls(d):
    return f"""
    SELECT event_id, concat(cast(user_id as string), '/', cast(event_id % 5 as string)) AS key, {d.micros('ts')} AS ts_us,
           cast(CASE WHEN event_type = 'error' THEN 502 WHEN event_id % 9 = 0 THEN 404 ELSE 200 END as int) AS status,
           cast(round(value * 100) as bigint) AS cost, event_type AS provider, concat('/e', cast(event_id % 3 as string)) AS endpoint
    FROM events"""


@fixture("fx_durations")
def _durations(d):
    return """
    SELECT doc_id AS id, CASE doc_id % 9 WHEN 0 THEN cast(doc_id * 7 as string)
        WHEN 1 THEN concat(cast(doc_id % 90 as string), ':', cast(doc_id % 60 as string)) WHEN 2 THEN concat(cast(doc_id % 5 as string), ':0', cast(doc_id % 10 as string), ':30')
        WHEN 3 THEN '' WHEN 4 THEN 'soon' WHEN 5 THEN NULL WHEN 6 THEN concat(cast(doc_id as string), '.7') WHEN 7 THEN ' 12:5.9 ' ELSE '0:00' END AS raw,
        CASE doc_id % 5 WHEN 0 THEN concat('2024-02-', cast(10 + doc_id % 19 as string)) WHEN 1 THEN concat('2024-03-01T0', cast(doc_id % 10 as string), ':05:06')
        WHEN 2 THEN concat('2023-12-31 2', cast(doc_id % 4 as string), ':59:59') WHEN 3 THEN '31/12/2023' ELSE NULL END AS day_text
    FROM documents"""


@fixture("fx_payloads", "fx_segments")
def _payloads(d):
    lines = d.lines("text")
    events = d.map_lines(lines, "CASE WHEN {i} % 5 = 3 THEN '{{\"tStartMs\":5}}' ELSE concat('{{\"tStartMs\":', cast({i} * 4500 as string), ',\"dDurationMs\":', cast(3000 + {i} * 250 as string), ',\"segs\":[{{\"utf8\":\" \"}},{{\"utf8\":', JS({x}), '}},{{\"acAsrConf\":1}}]}}') END")
    rows = d.map_lines(lines, "concat('{{\"text\":', JS({x}), ',\"startMs\":', cast({i} * 4500 as string), CASE WHEN {i} % 4 = 2 THEN '' WHEN {i} % 4 = 3 THEN ',\"endMs\":\"7\"' ELSE concat(',\"endMs\":', cast({i} * 4500 + 1250 as string)) END, '}}')")
    talk = d.map_lines(lines, "concat('{{\"body\":', JS({x}), ',\"startTime\":', cast({i} * 4 as string), '.5', CASE WHEN {i} % 3 = 1 THEN '' ELSE concat(',\"endTime\":', cast({i} * 4 + 3 as string)) END, ',\"speaker\":', CASE WHEN {i} % 2 = 0 THEN '\"\"' ELSE '\"Ann\"' END, '}}')")
    speech = d.map_lines(lines, "concat('{{\"text\":', JS({x}), ',\"start\":', CASE WHEN {i} % 6 = 4 THEN 'null' ELSE cast({i} * 4 as string) END, ',\"end\":', cast({i} * 4 + 3 as string), ',\"speaker_id\":\"s', cast({i} % 2 as string), '\"}}')")
    spoken = d.map_lines(d.split_words("text"), "concat(CASE WHEN {i} % 40 = 39 THEN '{{\"text\":\"(laughter)\",\"type\":\"audio_event\"}},' ELSE '' END, '{{\"text\":', JS({x}), ',\"type\":\"word\",\"start\":', cast({i} as string), ',\"end\":', cast({i} as string), '.5,\"speaker_id\":\"s', cast(cast(floor({i} / 25) as bigint) % 2 as string), '\"}},{{\"text\":\" \",\"type\":\"spacing\"}}')")
    js = lambda text: _inline_js(d, text)
    return f"""
    SELECT transcript_id * 1000 + seq AS payload_id,
           CASE WHEN seq % 5 = 4 THEN '{{broken' ELSE concat('{{"events":[', {d.join_lines(js(events), "','")}, ']}}') END AS events_json,
           concat('{{"rows":[', {d.join_lines(js(rows), "','")}, ']}}') AS rows_json,
           concat('{{"segments":[', {d.join_lines(js(talk), "','")}, ']}}') AS episode_json,
           CASE WHEN seq % 2 = 0 THEN concat('{{"text":', {d.js('text')}, ',"segments":[', {d.join_lines(js(speech), "','")}, ']}}')
                ELSE concat('{{"text":"","words":[', {d.join_lines(js(spoken), "','")}, ']}}') END AS speech_json
    FROM fx_segments"""


@fixture("fx_feed_lines")
def _feed_lines(d):
    if d.name == "spark":
        return f"SELECT doc_id, cast(p as bigint) AS pos, w AS line FROM documents LATERAL VIEW posexplode({d.lines('text')}) AS p, w"
    return f"SELECT doc_id, cast(s.p - 1 as bigint) AS pos, s.w AS line FROM (SELECT doc_id, unnest(list_transform({d.lines('text')}, lambda x, i: {{'w': x, 'p': i}})) AS s FROM documents)"


@fixture("fx_feeds")
def _feeds(d):
    item = d.map_lines(
        d.lines("text"),
        "concat('<item><title>Episode ', cast({i} as string), ': part ', cast(doc_id as string), '</title><link> https://f.example/', cast(doc_id as string), '/', cast({i} as string), ' </link>', "
        "CASE WHEN {i} % 3 = 0 THEN '' ELSE concat('<enclosure url=\"https://track.example/r/cdn.example/Ep-', cast(doc_id as string), '-', cast({i} as string), '.mp3?u=1\" length=\"1\" type=\"', CASE WHEN {i} % 3 = 1 THEN 'audio/mpeg' ELSE 'video/mp4' END, '\"/>') END, "
        "'<pubDate>Tue, 0', cast(1 + {i} % 9 as string), ' Jan 2024 10:00:0', cast({i} % 10 as string), CASE WHEN {i} % 2 = 0 THEN ' GMT' ELSE ' +0200' END, '</pubDate><itunes:duration>', cast({i} % 50 as string), ':30</itunes:duration><description>', "
        "XML({x}), CASE WHEN {i} % 4 = 1 THEN concat('&lt;p&gt;&lt;a href=\"https://f.example/', cast(doc_id as string), '/', cast({i} as string), '/\"&gt;Read more&lt;/a&gt;&lt;/p&gt;') ELSE '' END, '</description>', "
        "'<podcast:transcript url=\"https://t.example/', cast({i} as string), '.srt\" type=\"application/srt\"/><podcast:transcript url=\"https://t.example/', cast({i} as string), '.json\" type=\"application/json\" language=\"fr-FR\"/><podcast:transcript url=\"https://t.example/x\" type=\"text/odd\"/></item>')",
    )
    item = item.replace("XML(x)", "replace(replace(replace(x, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')")
    return f"""
    SELECT doc_id AS feed_id, concat('<rss xmlns:itunes="i" xmlns:podcast="p"><channel><title>Feed ', cast(doc_id as string), '</title><language>en-GB</language><generator>',
        CASE WHEN doc_id % 2 = 0 THEN 'Substack' ELSE 'Other' END, '</generator>', {d.join_lines(item, "''")}, '</channel></rss>') AS xml
    FROM documents"""


@fixture("fx_wanted", "fx_feed_lines")
def _wanted(d):
    return """
    SELECT doc_id AS feed_id, pos AS wanted_id, CASE WHEN pos % 3 = 0 THEN concat('https://other.example/none-', cast(pos as string), '.mp3')
             ELSE concat('https://CDN.example/ep-', cast(doc_id as string), '-', cast(pos as string), '.mp3') END AS audio_url,
           CASE WHEN pos % 6 = 0 THEN 'No such title' ELSE concat('episode ', cast(pos as string), ' - Part ', cast(doc_id as string), '!') END AS title
    FROM fx_feed_lines"""


@fixture("fx_rich_pages")
def _rich_pages(d):
    """Pages with everything the given ones lack: headline and prose links, tables, figures, notes, icons, feeds."""
    p = "cast(doc_id as string)"
    x = "replace(replace(replace(x, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
    line = d.map_lines(
        d.lines("text"),
        "CASE {i} % 6 WHEN 0 THEN concat('<h2><a href=\"/posts/line-number-', cast({i} as string), '#top\">', " + x.replace("x,", "{x},", 1) + ", '</a></h2>') "
        "WHEN 1 THEN concat('<p>', " + x.replace("x,", "{x},", 1) + ", ' see <a href=\"/2024/mention-', cast({i} as string), '\">mention here</a><sup><a href=\"#n', cast({i} as string), '\">', cast({i} % 1000 as string), '</a></sup></p>') "
        "WHEN 2 THEN concat('<table><caption>T', cast({i} as string), '</caption><tr><th colspan=\"3\">Over</th></tr><tr><th>a</th><th colspan=\"2\">b</th></tr><tr><td rowspan=\"2\">', cast({i} as string), '</td><td>x|y</td><td>z<sup>[1]</sup></td></tr><tr><td>w</td></tr></table>') "
        "WHEN 3 THEN concat('<figure><a href=\"/img/', cast({i} as string), '.png\"><img src=\"/img/', cast({i} as string), '.png\" alt=\"alt\"></a><figcaption>Caption ', cast({i} as string), '</figcaption></figure><img src=\"https://s', " + p + ", '.example/img/', cast({i} as string), '.png\"><img src=\"dot.gif\" width=\"1\">') "
        "WHEN 4 THEN '<ul><li>one <b>bold</b></li><li>two<ul><li>nested</li></ul></li></ul>' "
        "ELSE concat('<pre><code>code ', cast({i} as string), '</code></pre><table><tr><td>layout</td></tr></table>') END",
    )
    note = d.map_lines(d.lines("text"), "CASE WHEN {i} % 6 = 1 THEN concat('<li id=\"n', cast({i} as string), '\">Note ', cast({i} as string), '. <a href=\"#back\" class=\"backref\">back</a></li>') ELSE '' END")
    return f"""
    SELECT doc_id AS page_id, concat('https://s', {p}, '.example/', CASE WHEN doc_id % 2 = 0 THEN 'fr/read/page-' ELSE 'start' END, CASE WHEN doc_id % 2 = 0 THEN {p} ELSE '' END) AS url,
        concat('<!DOCTYPE html><html lang="', lang, '-XX"><head><title>Story ', {p}, ' part', CASE doc_id % 3 WHEN 0 THEN ' | Site Name' WHEN 1 THEN ' (Site Name)' ELSE '' END, '</title>',
        CASE WHEN doc_id % 4 = 1 THEN '' ELSE '<meta property="og:site_name" content=" Site Name ">' END, '<meta name="author" content="Writer ', {p}, '"><meta property="article:published_time" content="2024-02-1', cast(doc_id % 10 as string), '">',
        '<link rel="alternate" type="application/rss+xml" href="/feed.xml"><link rel="alternate home" type="application/atom+xml" href="atom/', {p}, '.xml"><link rel="alternate" type="application/rss+xml" href="/Comments/feed"><link rel="alternate" hreflang="de" href="/de">',
        '<link rel="icon" sizes="16x16 32x32" href="/i32.png"><link rel="apple-touch-icon" sizes="180x180" href="i180.png"><link rel="shortcut icon" href="https://c.example/plain.ico"></head>',
        '<body><header><h1>Site Name</h1><a href="/posts/menu-entry-x">menu</a></header><nav><a href="/posts/nav-entry-y">nav</a></nav><main><section>', CASE WHEN doc_id % 5 = 0 THEN '<h1>Stay Connected</h1>' ELSE '' END, '<h2>Story ', {p}, ' part</h2>', {d.join_lines(line, "''")},
        '</section><section><h2>Notes</h2><ol>', {d.join_lines(note, "''")}, '</ol></section><section><h2>After</h2><p>tail text</p></section></main>', CASE WHEN doc_id % 8 = 3 THEN '<div class="paywall" id="x">pay</div>' WHEN doc_id % 8 = 5 THEN '<script type="application/ld+json">{{"isAccessibleForFree": "False"}}</script>' ELSE '' END,
        '<footer><a href="/posts/foot-entry-z">foot</a></footer></body></html>') AS html
    FROM documents"""


@fixture("fx_provider_payloads", "fx_hits")
def _provider_payloads(d):
    j = d.js
    p = "cast(pos as string)"
    return f"""
    SELECT query_id, pos AS payload_id, CASE pos % 6 WHEN 0 THEN 'exa' WHEN 1 THEN 'tinyfish' WHEN 2 THEN 'marginalia' WHEN 3 THEN 'podcast' WHEN 4 THEN 'youtube_flat' ELSE 'youtube_paid' END AS vendor,
        CASE pos % 6
        WHEN 0 THEN concat('{{"results":[{{"url":', {j('url')}, ',"title":" ","highlights":[" one ","",null,', {j('title')}, '],"publishedDate":"2024-01-02"}},{{"title":"no url"}}]}}')
        WHEN 1 THEN concat('{{"results":[{{"title":"no url","url":""}},{{"url":', {j('url')}, ',"title":', {j('title')}, ',"snippet":" s ","date":null}}]}}')
        WHEN 2 THEN concat('{{"results":[{{"url":', {j('url')}, ',"title":', {j('title')}, ',"description":', {j('title')}, '}}]}}')
        WHEN 3 THEN concat('{{"results":[{{"episodeUrl":', {j('url')}, ',"trackId":', {p}, ',"trackName":', {j('title')}, ',"trackTimeMillis":61999,"artworkUrl100":"a100","artworkUrl60":"a60","collectionName":"Show","feedUrl":"f","releaseDate":"2024-05-01T00:00:00Z","description":', {j('title')}, ',"genres":[{{"name":"Arts"}}]}},{{"trackId":5}}]}}')
        WHEN 4 THEN concat('{{"entries":[{{"id":"v', {p}, '","title":', {j('title')}, ',"duration":12.9,"uploader":"Up","thumbnails":[{{"url":"small"}},{{"url":"big"}}]}},{{"id":"w', {p}, '"}}]}}')
        ELSE concat('{{"videos":[{{"id":"v', {p}, '","title":', {j('title')}, ',"lengthSeconds":77,"channel":{{"title":"Ch"}},"description":"","publishedTime":"2024-06-01"}},{{"title":"no id"}}]}}') END AS body,
        title, url, CASE WHEN query_id % 3 = 2 AND pos % 6 = 3 THEN 'timed out' ELSE NULL END AS error
    FROM fx_hits"""


def _inline_js(d, text: str) -> str:
    out, at = "", 0
    while (start := text.find("JS(", at)) >= 0:
        end = text.index(")", start)
        out += text[at:start] + d.js(text[start + 3:end])
        at = end + 1
    return out + text[at:]


@fixture("fx_cue_files", "fx_segments")
def _cue_files(d):
    cues = d.map_lines(d.lines("text"), "concat(cast({i} + 1 as string), NL, CASE WHEN {i} % 7 = 5 THEN 'no times here' WHEN {i} % 2 = 0 THEN concat('00:0', cast({i} % 10 as string), ':1', cast({i} % 7 as string), ',5 --> 00:0', cast({i} % 10 as string), ':2', cast({i} % 10 as string), '.250') ELSE concat('1', cast({i} % 10 as string), ':05.000 --> 1', cast({i} % 10 as string), ':09.125 align:start') END, NL, CASE WHEN {i} % 3 = 0 THEN '<v.loud Ann Lee>' ELSE '<i>' END, {x}, '</i>', NL, '  second <b>line</b> ')").replace("NL", d.nl)
    return f"""
    SELECT transcript_id * 1000 + seq AS file_id, concat('WEBVTT', {d.nl}, {d.nl}, {d.join_lines(cues, f'concat({d.nl}, {d.nl})')}, {d.nl}) AS body FROM fx_segments"""


@fixture("fx_turn_pages", "fx_segments")
def _turn_pages(d):
    turns = d.map_lines(d.lines("text"), "concat('**', CASE WHEN {i} % 2 = 0 THEN 'Ann' ELSE 'Bo Lee' END, ' · ', CASE WHEN {i} % 5 = 2 OR {i} % 5 = 3 THEN '1.2.3' ELSE concat(cast({i} as string), ':10.5') END, '–', CASE WHEN {i} % 7 = 3 THEN ':.' ELSE concat('0:', cast({i} as string), ':40') END, '**', NL, '  ', {x}, ' ', NL, NL, CASE WHEN {i} % 4 = 1 THEN 'and more' ELSE '' END)").replace("NL", d.nl)
    return f"""
    SELECT transcript_id * 1000 + seq AS page_id, concat('# Show', {d.nl}, '- **Language:** en-US', {d.nl}, '- **Duration:** ', cast(seq as string), ':04:37.5', {d.nl}, {d.nl}, '## Transcript', {d.nl}, 'lead-in', {d.nl},
           {d.join_lines(turns, d.nl)}, {d.nl}, '## Related', {d.nl}, '**Ann · 0:01–0:02**', {d.nl}, 'tail') AS text FROM fx_segments"""


@fixture("fx_words")
def _words(d):
    return f"""
    SELECT doc_id, pos, concat(word, ' ') AS text, CASE WHEN pos % 40 = 39 THEN 'audio_event' ELSE 'word' END AS kind,
           cast(pos as double) AS start_s, cast(pos as double) + 0.5 AS end_s, concat('s', cast(cast(floor(pos / 25) as bigint) % 2 as string)) AS speaker_id
    FROM ({d.words('documents', 'doc_id', 'text')}) AS w"""


@fixture("fx_chunk_segments", "fx_segments")
def _chunk_segments(d):
    return """
    SELECT transcript_id AS episode_id, cast(floor(seq / 3) as bigint) AS chunk_no, seq, text, start_s - 30 * cast(floor(seq / 3) as bigint) AS start_s,
           start_s - 30 * cast(floor(seq / 3) as bigint) + duration_s AS end_s, speaker
    FROM fx_segments WHERE NOT (transcript_id % 5 = 2 AND cast(floor(seq / 3) as bigint) = 1)"""


@fixture("fx_chunks", "fx_segments")
def _chunks(d):
    return """
    SELECT transcript_id AS episode_id, cast(floor(seq / 3) as bigint) AS chunk_no, min(text) AS text, cast(31 as double) AS probed_s
    FROM fx_segments GROUP BY transcript_id, cast(floor(seq / 3) as bigint)"""


def _needed(names: tuple[str, ...]) -> list[str]:
    seen: list[str] = []

    def visit(name: str) -> None:
        for need in FIXTURES[name][0]:
            visit(need)
        if name not in seen:
            seen.append(name)

    for name in names:
        visit(name)
    return seen


class Inputs:
    """The given tables and the fixtures of one scale-factor folder, as DataFrames."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder
        self._built: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._built:
            if name in TABLES:
                self._built[name] = read_table(self.spark, self.folder, name)
            else:
                needs, build = FIXTURES[name]
                for source in (*TABLES, *needs):
                    if source in needs or f"{source}" in build(SparkSql):
                        getattr(self, source).createOrReplaceTempView(source)
                self._built[name] = self.spark.sql(build(SparkSql))
        return self._built[name]


def oracle(fixtures: str, body: str) -> str:
    """DuckDB SQL: the named fixtures as CTEs, then ``body`` (a select, or more CTEs and a select)."""
    ctes = [f"{n} AS ({FIXTURES[n][1](DuckSql)})" for n in _needed(tuple(fixtures.split()))]
    body = body.strip()
    if body.upper().startswith(("SELECT", "(")):
        return (f"WITH {', '.join(ctes)} {body}" if ctes else body)
    return "WITH RECURSIVE " + ", ".join([*ctes, body])

