"""Pages with everything that the clean-up of articles is for, and the Markdown that must come of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafmill.operators import page_markdown as M
from leafmill.operators.page_cleanup import cleaned_pages
from leafmill.plans import duck as D
from leafmill.plans.fixtures import DuckSql, fixture
from leafmill.plans.registry import query

X = "replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
I = "cast({i} as string)"  # noqa: E741
NL = "chr(10)"


def _kinds(*bodies: str, of: str = "{i}") -> str:
    """SQL for a line's HTML by its number: in each body ``@i`` is the number and ``@x`` the line, escaped."""
    def text(body: str) -> str:
        parts = [p for p in body.replace("@i", "\0i\0").replace("@x", "\0x\0").replace("\n", "\0n\0").split("\0") if p]
        quoted = {"i": I, "x": X, "n": NL}
        return "concat('', " + ", ".join(quoted.get(p) or "'" + p.replace("{", "{{").replace("}", "}}").replace("'", "''") + "'" for p in parts or [""]) + ")"

    cases = " ".join(f"WHEN {k} THEN {text(b)}" for k, b in enumerate(bodies))
    return f"CASE {of} % {len(bodies)} {cases} END"


CLUTTER = _kinds(
    '<p>@x<sup id="r@i"><a href="#n@i">@i</a></sup></p>',
    '<p><a href="/big/@i.png"><img src="img/./@i.png" alt="Picture @i"></a></p>',
    '<figure><a href="/f/@i"><img src="//cdn.example/@i.png" alt="no"></a><figcaption>Caption <b>@i</b></figcaption></figure>',
    '<div class="wp-caption"><img src="https://cdn.example/w@i.png" title="t"><p class="wp-caption-text">Beside @i</p></div><img src="http://cdn.example/w@i.png"><img src="/dot.gif" width="1" height="1"><pre><code> </code></pre>',
    "<table><tr><td>&nbsp;</td></tr></table><table><tr><td><p>@x</p><p>Second @i</p></td></tr></table>",
    '<table><tr><td class="ln"><pre>1\n2</pre></td><td><pre>def f@i():\n    return @i\n</pre></td></tr></table>',
    "<table><caption>Set @i</caption><tr><th>Key</th><th>Value</th></tr><tr><td>@i<sup>[b]</sup></td><td>a|b <b>c</b></td></tr></table>",
    '<p>See <a href="/more/@i">more <em>of it</em></a> and <a href="#n@i">@i</a>.</p>',
)
CLUTTER_NOTE = _kinds(
    '<li id="n@i"><p>See <a href="/ref/@i">the <em>source</em></a>. <a href="#r@i">↩</a></p><p>More <strong>@i</strong>.</p></li>', *[""] * 7,
)


@fixture("fx_cluttered_pages")
def _cluttered(d):
    p = "cast(doc_id as string)"
    join = lambda body: d.join_lines(d.map_lines(d.lines("text"), body), "''")
    return f"""
    SELECT doc_id AS page_id, concat('https://c', {p}, '.example/read/page.html') AS url,
        concat('<html><head><title>T</title><style>p {{ margin: 0 }}</style></head><body><header><h2>Site</h2><nav>menu</nav></header><main><h1>Title ', {p}, '</h1>', {join(CLUTTER)},
        '<div class="footnotes"><hr><h2>Notes</h2><ol>', {join(CLUTTER_NOTE)}, '</ol></div></main><footer>foot</footer></body></html>') AS html
    FROM documents"""


WIKI = _kinds(
    '<section><h2>Part @i</h2><p>@x<sup class="mw-ref reference" id="cite_ref-@i"><a href="./T#cite_note-@i"><span>[</span>@i<span>]</span></a></sup><sup class="reference">,</sup><sup class="mw-ref reference"><a href="./T#cite_note-@i">[@i]</a></sup></p></section>',
    """<section><div class="mw-heading"><h2>Part @i</h2></div><p>Formula <math display="block" data-mw='{"body":{"extsrc":"x_{@i}^2"}}'><mi>x</mi></math> here, <math alttext="z_@i"><mi>z</mi></math></p><p>and <span><math alttext="y"><mi>y</mi></math><img src="//m.example/@i.svg"></span></p></section>""",
    '<section><h2>Part @i</h2><figure><a href="./File:@i.jpg"><img src="//u.example/@i.jpg"></a><figcaption>Fig @i</figcaption></figure><p>On <a href="./Other_@i">other</a> things</p><section><h3>Notes</h3><p>kept @i</p></section></section>',
    '<section><h2>Part @i</h2><div class="navbox">box</div><ul><li>one @i<span class="noprint">!</span></li><li>two</li></ul><table class="collapsed"><tr><td>tree</td><td>t</td></tr></table></section>',
)
WIKI_NOTE = _kinds(
    '<li id="cite_note-@i"><span class="mw-cite-backlink"><a href="./T#cite_ref-@i">↑</a></span> <span class="mw-reference-text">Work <i>@i</i>, <a href="./Book_@i">book</a>.</span></li>', *[""] * 3,
)


@fixture("fx_encyclopedia_pages")
def _encyclopedia(d):
    p = "cast(doc_id as string)"
    join = lambda body: d.join_lines(d.map_lines(d.lines("text"), body), "''")
    return f"""
    SELECT doc_id AS page_id, concat('https://en.wikipedia.org/wiki/Topic_', {p}) AS url,
        concat('<html><head><title>T</title></head><body><section><div class="hatnote">For other uses</div><table class="infobox"><tr><td>a</td><td>b</td></tr></table><p><b>Topic ', {p}, '</b> opens.</p></section>', {join(WIKI)},
        '<section><h2>', CASE doc_id % 3 WHEN 0 THEN 'References' WHEN 1 THEN 'See also' ELSE 'Einzelnachweise' END, '</h2><p>list</p><div class="mw-references-wrap"><ol>', {join(WIKI_NOTE)},
        '</ol></div></section><section><h2>Last</h2><p>tail</p></section><div class="navbox">nav</div></body></html>') AS html
    FROM documents"""


def _lines() -> str:
    d = DuckSql
    return f"""rl AS (SELECT doc_id, cast(s.p - 1 as bigint) AS i, s.w AS line FROM (SELECT doc_id, unnest(list_transform({d.lines('text')}, lambda x, i: {{'w': x, 'p': i}})) AS s FROM documents)),
    l AS (SELECT *, {D.escape_tags("regexp_replace(line, '([*_])', '\\\\\\1', 'g')")} AS e FROM rl)"""


def _whole(first: str, block: str, note: str) -> str:
    return f"""
    b AS (SELECT doc_id, i, {block} AS md, {note} AS note FROM l)
    SELECT doc_id AS page_id, {first} || coalesce(chr(10) || chr(10) || string_agg(md, chr(10) || chr(10) ORDER BY i) FILTER (md <> ''), '')
        || coalesce(chr(10) || chr(10) || string_agg(note, chr(10) || chr(10) ORDER BY i) FILTER (note IS NOT NULL), '') AS md FROM b GROUP BY doc_id"""


CLUTTER_NOTE_MD = "CASE WHEN i % 8 = 0 THEN '[^fn' || (i // 8 + 1) || ']: See [the *source*](/ref/' || i || ').' || chr(10) || chr(10) || '    More **' || i || '**.' END"
CLUTTER_MD = """CASE i % 8 WHEN 0 THEN e || '[^fn' || (i // 8 + 1) || ']'
    WHEN 1 THEN '![Picture ' || i || '](https://c' || doc_id || '.example/read/img/' || i || '.png)'
    WHEN 2 THEN '![Caption ' || i || '](https://cdn.example/' || i || '.png)'
    WHEN 3 THEN '![Beside ' || i || '](https://cdn.example/w' || i || '.png)'
    WHEN 4 THEN CASE WHEN e = '' THEN '' ELSE e || chr(10) || chr(10) END || 'Second ' || i
    WHEN 5 THEN '```' || chr(10) || 'def f' || i || '():' || chr(10) || '    return ' || i || chr(10) || '```'
    WHEN 6 THEN '**Set ' || i || '**' || chr(10) || chr(10) || '| Key | Value |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || i || ' | a\\|b c |'
    ELSE 'See [more *of it*](/more/' || i || ') and [' || i || '](#n' || i || ').' END"""


@query("cleaned_page_markdown", "", f"{_lines()}, {_whole("'# Title ' || doc_id", CLUTTER_MD, CLUTTER_NOTE_MD)}")
def cleaned_page_markdown(t):
    return M.to_markdown(t.fx_cluttered_pages)


WIKI_NOTE_MD = "CASE WHEN i % 4 = 0 THEN '[^fn' || (i // 4 + 1) || ']: Work *' || i || '*, [book](https://en.wikipedia.org/wiki/Book_' || i || ').' END"
WIKI_MD = """'## Part ' || i || chr(10) || chr(10) || CASE i % 4 WHEN 0 THEN e || '[^fn' || (i // 4 + 1) || '][^fn' || (i // 4 + 1) || ']'
    WHEN 1 THEN 'Formula $$x_{' || i || '}^2$$ here, $z_' || i || '$' || chr(10) || chr(10) || 'and ![](https://m.example/' || i || '.svg)'
    WHEN 2 THEN '![Fig ' || i || '](https://u.example/' || i || '.jpg)' || chr(10) || chr(10) || 'On [other](https://en.wikipedia.org/wiki/Other_' || i || ') things' || chr(10) || chr(10) || '### Notes' || chr(10) || chr(10) || 'kept ' || i
    ELSE '- one ' || i || chr(10) || '- two' END"""


@query("encyclopedia_markdown", "", f"{_lines()}, {_whole("'**Topic ' || doc_id || '** opens.'", WIKI_MD, WIKI_NOTE_MD)}")
def encyclopedia_markdown(t):
    return M.to_markdown(t.fx_encyclopedia_pages, encyclopedia=True)


@query("formatted_footnotes", "", f"""{_lines()}
    SELECT doc_id AS page_id, (i // 8 + 1)::INTEGER AS note_no, 'See [the *source*](/ref/' || i || ').' || chr(10) || chr(10) || 'More **' || i || '**.' AS md FROM l WHERE i % 8 = 0
    UNION ALL SELECT doc_id + 1000000000, (i // 4 + 1)::INTEGER, 'Work *' || i || '*, [book](https://en.wikipedia.org/wiki/Book_' || i || ').' FROM l WHERE i % 4 = 0""")
def formatted_footnotes(t):
    """The notes of both kinds of pages, each as Markdown."""
    def notes(pages, encyclopedia):
        rows = cleaned_pages(pages, encyclopedia=encyclopedia, notes_only=True).select("page_id", F.explode("notes").alias("n"))
        return rows.select("page_id", F.col("n.n").alias("note_no"), M.markdown_of(F.col("n.draft")).alias("md"))

    return notes(t.fx_cluttered_pages, False).unionAll(notes(t.fx_encyclopedia_pages, True).withColumn("page_id", F.col("page_id") + 1000000000))
