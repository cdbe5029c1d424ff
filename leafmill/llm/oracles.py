"""The same queries for DuckDB, where SQL can say them."""

from __future__ import annotations

#: White space as the contracts have it, as a character class of DuckDB's regular expressions.
_GAP = "[ \\t\\n\\v\\f\\r]+"
_WORDS = f"list_filter(regexp_split_to_array(coalesce(text, ''), '{_GAP}'), lambda x: x <> '')"

MIXING_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, source, CASE WHEN source IS NULL THEN '' ELSE '=' || source END AS s, len({_WORDS})::BIGINT AS n FROM documents),
sums AS (SELECT s, sum(n)::BIGINT AS tokens, count(*) AS rows_ FROM d GROUP BY s HAVING sum(n) > 0),
shares AS (SELECT *, tokens / (SELECT sum(tokens) FROM sums)::DOUBLE AS share FROM sums),
one AS (SELECT list(share) AS l, count(*) AS k, min(share) AS least, max(share) AS most FROM shares),
steps AS (SELECT 0 AS i, 0.0::DOUBLE AS low, 1.0::DOUBLE AS high UNION ALL SELECT i + 1, CASE WHEN ok THEN low ELSE mid END, CASE WHEN ok THEN mid ELSE high END FROM (
    SELECT i, low, high, mid, ln(z) - mid * e / z <= 0.97 * ln(k) AND pow(least / most, mid - 1) <= 2.0 AS ok FROM (
        SELECT i, low, high, mid, k, least, most, list_sum(list_transform(l, lambda x: pow(x, mid))) AS z, list_sum(list_transform(l, lambda x: pow(x, mid) * ln(x))) AS e
        FROM (SELECT steps.*, one.*, (low + high) / 2 AS mid FROM steps, one WHERE i < 32) AS a) AS b) AS c),
power AS (SELECT CASE WHEN k < 2 THEN 1.0 ELSE high END AS a FROM steps, one WHERE i = 32),
w AS (SELECT *, greatest(round(pow(share, a) / (SELECT sum(pow(share, a)) FROM shares, power), 6), 1e-6) AS weight FROM shares, power),
budgets AS (SELECT *, floor((SELECT max(tokens / weight) FROM w) * weight + 1e-6)::BIGINT AS budget FROM w),
plan AS (SELECT s, weight, budget // tokens AS passes, budget % tokens AS rest, ceil(rows_ / 4096.0)::BIGINT AS blocks FROM budgets),
dealt AS (SELECT d.*, weight, passes, rest, ('0x' || substr(md5('mix-1|block|' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT % blocks AS block FROM d JOIN plan USING (s)),
used AS (SELECT *, md5('mix-1|row|' || pass || '|' || coalesce(doc_id::VARCHAR, '')) AS o FROM (SELECT *, unnest(range(passes + CASE WHEN rest > 0 THEN 1 ELSE 0 END)) AS pass FROM dealt) AS x),
placed AS (SELECT *, sum(n) OVER (PARTITION BY s, pass ORDER BY md5('mix-1|pass|' || pass || '|' || s || '|' || block), block, o, doc_id, n ROWS UNBOUNDED PRECEDING) - n AS token_start FROM used)
SELECT doc_id, source, weight, pass::INTEGER AS pass, block, token_start::BIGINT AS token_start, n AS n_tokens FROM placed WHERE pass < passes OR token_start + n <= rest"""

WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS h FROM pages),
g AS (SELECT h, max(page_id) AS response FROM p WHERE strlen(h) >= 1000 GROUP BY h)
SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha1(h) AS payload_digest, CASE WHEN response <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN response <> page_id THEN response END AS refers_to, url, NULL::VARCHAR AS error
FROM p LEFT JOIN g USING (h)"""

GROUPS_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_GAP}'), lambda x: x <> '') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE []::VARCHAR[] END) AS s FROM d),
size AS (SELECT d.doc_id, count(s) AS n FROM d LEFT JOIN sh USING (doc_id) GROUP BY 1),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM sh AS a JOIN sh AS b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN size AS x ON x.doc_id = a JOIN size AS y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
ends AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.x, e.b FROM reach AS r JOIN ends AS e ON r.y = e.a)
SELECT size.doc_id, n::BIGINT AS n_shingles, c AS component_id, size.doc_id = c AS kept FROM size JOIN (SELECT x, min(y) AS c FROM reach GROUP BY 1) AS g ON g.x = size.doc_id"""

REMOVALS_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
windows AS (SELECT doc_id, p, array_to_string(w[p:p + 19], ' ') AS b FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS p FROM d) AS x),
later AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY b ORDER BY doc_id, p) AS k FROM windows) AS y WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 20)) AS i FROM later),
each_word AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM d),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS t, count(*) AS n FROM (SELECT * FROM each_word ANTI JOIN gone USING (doc_id, i)) AS z GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)"""

TOP_SQL = """
WITH fit AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, coalesce(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])), 0)::BIGINT AS score
    FROM fit AS q JOIN fit AS c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) AS r WHERE rank <= 5"""

#: The given pages have one article each, with headings and paragraphs as its blocks.
MAIN_TEXT_SQL = """
WITH a AS (SELECT page_id, url, regexp_split_to_array(regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1), '</?(?:p|h1)>') AS parts FROM pages),
b AS (SELECT page_id, url, list_transform(parts, lambda x: replace(replace(replace(replace(regexp_replace(x, '<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&')) AS parts FROM a),
c AS (SELECT page_id, url, array_to_string(list_filter(list_transform(parts, lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x <> ''), chr(10)) AS text FROM b)
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM c"""

COLLOCATIONS_SQL = """
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\n\\v\\f\\r]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \\t]+'), lambda x: x <> '') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
grams AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM w, (SELECT unnest([1, 2, 3, 4]) AS k) AS ks),
f AS (SELECT lang, k, phrase, count(*) AS f, string_split(phrase, ' ') AS w FROM grams GROUP BY ALL HAVING count(*) >= 30),
cuts AS (SELECT *, unnest(range(1, k)) AS head FROM f WHERE k > 1),
scored AS (SELECT cuts.*, x.f AS l, y.f AS r, (2000000::HUGEINT * cuts.f // (x.f + y.f))::BIGINT AS score FROM cuts
    JOIN f AS x ON x.lang = cuts.lang AND x.phrase = array_to_string(cuts.w[1:head], ' ') JOIN f AS y ON y.lang = cuts.lang AND y.phrase = array_to_string(cuts.w[head + 1:], ' ')),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, head) = 1),
inside AS (SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(f) AS longer FROM (SELECT *, unnest(range(1, k - m + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS m FROM f WHERE k > 2) AS a) AS b GROUP BY 1, 2),
kept AS (SELECT best.* FROM best LEFT JOIN inside USING (lang, phrase) WHERE longer IS NULL OR 100::HUGEINT * longer < 80::HUGEINT * f)
SELECT lang, rank, phrase, f AS a, l, r, n, score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, f DESC, phrase) AS rank FROM kept) AS z JOIN totals USING (lang) WHERE rank <= 2000"""
