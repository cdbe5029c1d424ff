"""Small tables with known answers for what the generated data cannot show."""

import random

from pyspark.sql import functions as F

from leafmill.functions import urls
from leafmill.functions.media import clock_to_seconds
from leafmill.operators import audit, books, hits, linkage, links, markdown, page_markdown, pages, polish, segments, titles
from leafmill.operators.language import accepted_language, detect_language
from leafmill.sources import captions, feeds
from leafmill.sources import pages as nodes


def values(df, column, *rest):
    return [r[0] for r in df.select(column, *rest).collect()]


def test_url_kinds(table):
    cases = {
        "https://www.youtube.com/watch?v=abc123XYZ&list=PL1": "youtube_video", "https://youtu.be/abc123XYZ?t=30": "youtube_video",
        "https://www.youtube.com/embed/abc123XYZ": "youtube_video", "https://www.youtube.com/playlist?list=PLabc": "youtube_playlist",
        "https://www.youtube.com/@someone": "youtube_channel", "https://cdn.example/show/ep1.m4a?token=x": "podcast",
        "https://blog.example.com/posts/hello": "blog", "https://en.wikipedia.org/wiki/Stoicism": "blog",
    }
    df = table("url string", *[(u,) for u in cases])
    assert values(df, links.url_kind("url")) == list(cases.values())


def test_article_filter_and_keys(table):
    kept = ["https://a.example/10-best-products", "https://a.example/", "https://a.example/releases/v2.5", "https://a.example/x?s=", "https://notx.com/a"]
    dropped = ["https://m.reddit.com/r/a", "https://jobs.a.example/1", "https://a.example/Shop/1", "https://a.example/f/Report.Pdf", "https://a.example/?page=1&q=x", "https://x.com/a"]
    df = table("url string", *[(u,) for u in kept + dropped])
    assert values(df, links.is_article_like("url")) == [True] * len(kept) + [False] * len(dropped)
    keys = table("url string", ("http://www.Site.com:80/fr/post/?a=1#t",), ("https://site.com//post",), ("https://site.com/en-us",), ("https://site.com/french/post",))
    assert values(keys, urls.canonical_key("url")) == ["site.com/post", "site.com/post", "site.com/", "site.com/french/post"]


def test_public_addresses(table):
    cases = {
        "http://10.0.0.1/": False, "http://127.0.0.1:80/x": False, "https://8.8.8.8/": True, "http://[::1]/": False, "http://[::ffff:127.0.0.1]/": False,
        "http://[2606:4700::1]/": True, "http://[fe80::1]/": False, "ftp://a.example/": False, "https://a.example/": True, "http://172.31.0.1/": False, "http://172.32.0.1/": True,
    }
    assert values(table("url string", *[(u,) for u in cases]), links.is_public("url")) == list(cases.values())


def test_absolute_urls(table):
    df = table("base string, href string", ("https://s.example/a/b?q=1#f", "c"), ("https://s.example/a/b", "../d/./e"), ("https://s.example", "x"),
               ("https://s.example/a/", "//c.example/y"), ("https://s.example/a/b", "/z"), ("https://s.example/a/b?q", "?r=1"), ("https://s.example/a", "mailto:x@y"))
    assert values(df, urls.absolute("base", "href")) == [
        "https://s.example/a/c", "https://s.example/d/e", "https://s.example/x", "https://c.example/y", "https://s.example/z", "https://s.example/a/b?r=1", "mailto:x@y"]


def test_absolute_urls_climb_any_number_of_folders(table):
    from urllib.parse import urljoin

    base = "https://a.example/p/q/r/s/t/u/v/page"
    hrefs = ["../../../../../../x", "../" * 12 + "x", "/z/../w", "/../w", "a//b/./c/..", "..", ".", "/a/b/../", "x/../../y?q=../z#../f"]
    df = table("base string, href string", *[(base, h) for h in hrefs])
    assert values(df, urls.absolute("base", "href")) == [urljoin(base, h) for h in hrefs]


def test_merge_equals_head_to_head(spark):
    chance = random.Random(2)
    rows, expected = [], {}
    for q in range(40):
        shown, seen = [], set()
        for arrival in range(3):
            batch = [(q, arrival, pos, f"u{chance.randint(0, 25)}", None if chance.random() < 0.2 else chance.randint(0, 6) / 2) for pos in range(chance.randint(0, 8))]
            rows += batch
            fresh = []
            for r in batch:
                if r[3] not in seen:
                    seen.add(r[3])
                    fresh.append(r)
            merged, i, j = [], 0, 0
            score = lambda r: -1 if r[4] is None else r[4]
            while i < len(shown) and j < len(fresh):
                if score(fresh[j]) > score(shown[i]):
                    merged.append(fresh[j]); j += 1  # noqa: E702
                else:
                    merged.append(shown[i]); i += 1  # noqa: E702
            shown = merged + shown[i:] + fresh[j:]
        expected[q] = [r[1:4] for r in shown]
    df = spark.createDataFrame(rows, "query_id int, arrival int, pos int, url string, relevance double")
    found = {}
    for r in sorted(hits.merge_batches(df).collect(), key=lambda r: r.place):
        found.setdefault(r.query_id, []).append((r.arrival, r.pos, r.url))
    assert found == {q: v for q, v in expected.items() if v}


def test_titles(table):
    cases = {
        "#2519 - Scott Eastwood": "Scott Eastwood", "KILL YOUR EXCUSES - Motivational Speech": "Kill Your Excuses - Motivational Speech",
        "Deep work | Some Channel": "Deep work", "12 Rules for Life": "12 Rules for Life", "NASA and the Moon": "NASA and the Moon",
        "THE ART OF WAR": "The Art of War", "Ep. 42: The end - YouTube": "The end", "| x": "| x", "SACRIFICE": "Sacrifice", "AI": "AI",
    }
    assert values(table("t string", *[(t,) for t in cases]), titles.tidy_title("t")) == list(cases.values())


def test_durations(table):
    df = table("raw string", ("1800",), ("30:00",), ("1:02:03",), ("0",), ("soon",), (None,), ("",))
    assert values(df, clock_to_seconds("raw")) == [1800, 1800, 3723, None, None, None, None]


def test_languages(table):
    text = "le la les et des est une que qui dans pour pas sur vous avec il ce du au sont le la"
    df = table("t string", (text,), ("only a few words",))
    assert values(df, detect_language("t")) == ["fr", None]
    heads = table("h string", ("fr-FR,fr;q=0.9",), ("*",), ("",))
    assert values(heads, accepted_language("h")) == ["fr", None, None]


def test_cues(table):
    srt = "1\n00:00:01,5 --> 00:00:03,250\nHello <b>there</b>\n\n2\nno times\n\n3\r\n01:00.000 --> 01:02.000\n<v Ann Lee>Hi\nagain"
    rows = captions.cue_segments(table("file_id int, body string", (1, srt))).orderBy("seq").collect()
    assert [(r.text, r.start_s, r.duration_s, r.speaker) for r in rows] == [("Hello there", 1.5, 1.75, None), ("Hi again", 60.0, 2.0, "Ann Lee")]


def test_speaker_turns(table):
    page = "- **Language:** en-US\n- **Duration:** 1:00\n\n## Transcript\n**Ann · 0:01–0:04**\nHello\nthere\n**Bo · 1.2.3–0:09**\nHi\n**Cy · 1.2.3–:.**\nYo\n**Di · 0:20–0:10**\nBye\n## Notes\nx"
    rows = captions.speaker_turns(table("page_id int, text string", (1, page))).orderBy("turn").collect()
    assert [(r.speaker, r.text, r.start_s, r.duration_s) for r in rows] == [
        ("Ann", "Hello there", 1.0, 3.0), ("Bo", "Hi", 4.0, 5.0), ("Cy", "Yo", 9.0, 0.0), ("Di", "Bye", 20.0, 0.0)]


def test_atom_and_broken_feeds(table):
    atom = ('<feed xmlns="a"><title>F</title><entry><title>T</title><link rel="alternate" href="https://x.example/1"/><link rel="enclosure" type="audio/mpeg" href="https://x.example/1.mp3"/>'
            "<published>2024-01-02T03:04:05Z</published><summary>s</summary></entry></feed>")
    rows = feeds.feed_entries(table("feed_id int, xml string", (1, atom), (2, "<rss><chan"))).collect()
    assert [(r.feed_id, r.title, r.url, r.audio_url, str(r.published_at)) for r in rows] == [(1, "T", "https://x.example/1", "https://x.example/1.mp3", "2024-01-02 03:04:05")]


def test_chapters_and_ties(table):
    seg = table("transcript_id int, seq long, text string, start_s double, duration_s double, speaker string", *[(1, i, "x", s, 1.0, None) for i, s in enumerate([0.0, 5.0, 24.0, 25.0, 99.0])])
    marks = table("transcript_id int, mark_no long, title string, start_s double", (1, 0, "a", 5.0), (1, 1, "b", 25.0), (1, 2, "c", 25.0))
    rows = segments.assign_chapters(seg, marks, block_s=10.0).orderBy("seq")
    assert values(rows, "chapter_no") == [0, 0, 0, 2, 2]


def test_headings(table):
    df = table("md string, title string", ("# T\n\n```\n# code\n```\n## S\n###### deep", "x"), ("text", "x"))
    assert values(df, markdown.demote_headings("md")) == ["## T\n\n```\n# code\n```\n### S\n###### deep", "text"]
    lead = table("md string, title string", ("[Blog](/b)\n\n![c](c.png)\n\n\n# [My Post!](/p)\n\nbody", "My post"), ("# Other\nbody", "My post"))
    assert values(lead, markdown.strip_leading_title("md", "title")) == ["![c](c.png)\n\nbody", "# Other\nbody"]


def test_blocks(table):
    md = "# H\npara one\nstill\n\n- a\n- b\n\n  more b\n- c\n\n1. x\n\n> q\n> r\n\n| a | b |\n| - | - |\n| 1 | 2 |\n\n```py\n# no\n\ncode\n```\n\n![cap [x](y)](i.png)\n\n[^1]: note\n\n    goes on\n\n1999. was\na year"
    rows = markdown.markdown_blocks(table("doc_id int, md string", (1, md)), "doc_id").orderBy("block_no").collect()
    assert [(r.kind, r.level, r.items) for r in rows] == [
        ("heading", 1, 0), ("paragraph", 0, 0), ("bullets", 0, 3), ("ordered", 0, 1), ("quote", 0, 0), ("table", 0, 1), ("code", 0, 0), ("figure", 0, 0), ("note", 0, 0), ("paragraph", 0, 0)]
    assert rows[6].text == "# no\n\ncode" and rows[7].text == "cap [x](y)" and rows[1].text == "para one still"


def test_inline(table):
    md = r"See [^c1fn1] and **b** *i* 5 * 3 [t](https://x.example/a) `c` \* $x^2$ costs $10 and $20. ![a](i.png)"
    r = markdown.inline_inventory(table("doc_id int, md string", (1, md)), "doc_id").collect()[0]
    assert (r.note_calls, r.strong, r.emphasis, r.links, r.code, r.math, r.images) == (1, 1, 1, 1, 1, 1, 1)


def test_audit_flags(table):
    long = "\n\n".join(["word " * 40] * 5)
    df = table("pair_id int, title string, src_md string, out_md string", (1, "t", "a b c d 1,500 and 7", "a b 1500"), (2, "t", long, "Here is the corrected text " + long), (3, "t", "", ""))
    rows = {r.pair_id: r for r in audit.scorecard(df).collect()}
    assert rows[1].flags == ["lost 62% of the words", "1 figure(s) dropped: 7"] and rows[1].lost_numbers == ["7"]
    assert rows[2].flags == ["opens with model preamble", "paragraphs cut by length, not by meaning"]
    assert rows[3].word_ratio == 1.0 and rows[3].similarity == 0.0


def test_passages(table):
    src = " ".join(f"w{i}" for i in range(60))
    out = "::: x\n\n# head\n\nw20 w21 w22\n\nnothing here"
    rows = audit.passages(table("pair_id int, src_md string, out_md string", (1, src, out))).orderBy("passage_no").collect()
    assert rows[0].original == " ".join(f"w{i}" for i in range(8, 35)) and rows[1].original is None


def test_passages_skip_what_is_not_prose(table):
    src = "one two three four five six seven\n\neight nine ten eleven twelve"
    out = "::: {.source}\n*Source: x*\n:::\n\n## A heading\n\nOne, two, three, four.\n\nEleven twelve.\n\nEntirely new words here."
    rows = audit.passages(table("pair_id int, src_md string, out_md string", (1, src, out), (2, "", "Some text."), (3, None, "## only"))).orderBy("pair_id", "passage_no").collect()
    assert [r.edited for r in rows] == ["One, two, three, four.", "Eleven twelve.", "Entirely new words here.", "Some text."]
    assert "one two three four" in rows[0].original and "seven\n\neight" in rows[0].original and "eleven twelve" in rows[1].original
    assert rows[2].original is None and rows[3].original is None


def test_matching_blocks_of_repetitive_texts(monkeypatch):
    from difflib import SequenceMatcher

    from leafmill.functions import blockmatch

    chance = random.Random(4)
    monkeypatch.setattr(blockmatch, "MAX_RUN_PAIRS", 40)
    for _ in range(150):
        a, b = ([chance.choice("abc") for _ in range(chance.randint(0, 40))] for _ in range(2))
        assert blockmatch.matching_blocks(a, b) == [tuple(m) for m in SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks() if m.size]


def test_table_grid_of_spans():
    from leafmill.operators.page_markdown import table_grid

    def cell(text, rows=1, cols=1, head=False):
        return {"text": text, "rows": rows, "cols": cols, "head": head}

    titles, grid = table_grid([[cell("T")], [cell("a", rows=2), cell("b", cols=2)], [cell("c"), cell("d"), cell("e")], [cell("f", rows=9)]], "cap")
    assert titles == ["cap", "T"]
    assert [[t for t, _ in row] for row in grid] == [["a", "b", "", ""], ["", "c", "d", "e"], ["f", "", "", ""]]


def test_spans_of_many_digits(table):
    from leafmill.operators.page_markdown import MAX_SPAN, _span

    cases = {"123456789012": MAX_SPAN, "0002": 2, "0": 1, "x": 1, None: 1, "60": MAX_SPAN}
    df = table("span string", *[(c,) for c in cases]).withColumn("n", F.struct(F.create_map(F.lit("rowspan"), F.col("span")).alias("attrs")))
    assert values(df, _span(F.col("n"), "rowspan")) == list(cases.values())


def test_guards(table):
    words = " ".join(f"w{i}" for i in range(100))
    df = table("id int, role string, src string, out string", (1, "punctuate", words, words.upper() + "."), (2, "punctuate", words, words[:300]), (3, "copyedit", words, words[:300]),
               (4, "sections", words, "# New\n" + words), (5, "copyedit", words, " "), (6, "punctuate", words, None))
    assert values(polish.with_verdicts(df).orderBy("id"), "accepted") == [True, False, True, True, False, False]


def test_rewriting_falls_back(table):
    chunks = polish.chunk_rows(table("doc_id long, text string", (1, "one two three"), (2, "fail me")), "doc_id", "text", "copyedit")

    def rewrite(role, text):
        if "fail" in text:
            raise RuntimeError("busy")
        return text.upper()

    rows = polish.reassemble(chunks, polish.rewrite_with(chunks, "doc_id", rewrite), "doc_id").orderBy("doc_id").collect()
    assert [(r.text, r.cacheable) for r in rows] == [("ONE TWO THREE", True), ("fail me", False)]


def test_linked_titles(table):
    wanted = table("item_id long, title string, duration_s long", (1, "Ep 12: How the mind works today", 3600), (2, "How the mind works today", None), (3, "Part 2 of the long story", 100))
    found = table("item_id long, rank int, title string, duration_s long", (1, 0, "How the mind works today", 9000), (1, 1, "How the minds work today", 3700), (2, 0, "How the mind work today", 5), (3, 0, "Part 3 of the long story", 100))
    assert [(r.item_id, r.rank) for r in linkage.linked_titles(wanted, found).collect()] == [(1, 1)]


def test_footnote_texts(table):
    df = table("md string", ("a⟦fn2⟧ b⟦fn1⟧ c⟦fn2⟧ d⟦fn9⟧",))
    notes = F.create_map(F.lit(1), F.lit("one"), F.lit(2), F.lit("two\nmore"))
    assert values(df, books.write_footnotes("md", notes)) == ["a[^fn2] b[^fn1] c[^fn2] d\n\n[^fn2]: two\n    more\n\n[^fn1]: one"]


def test_book_text(table, tmp_path, spark):
    chapters = table("book_id string, chapter_no long, title string, source_type string, source_url string, author string, published string, content_md string, language string, channel_url string",
                     ("b", 1, "One <x>", "blog", "https://a.example/1", "Ann", "2024-01-02", "Text[^fn1].", "fr", None), ("b", 2, "Empty", "blog", "https://a.example/2", None, None, " ", "fr", None),
                     ("b", 3, "Deux", "blog", "https://a.example/3", None, None, "Plus long texte.", "en", None))
    parts = books.book_parts(chapters, table("book_id string, preface string", ("b", " Hi ")))
    rows = sorted(parts.collect(), key=lambda r: (r.section, r.number))
    assert "\n".join(r.text for r in rows) == (
        "# Sources {.front-matter}\n\n- [One \\<x>](https://a.example/1)\n- [Deux](https://a.example/3)\n\n# Preface {.front-matter}\n\nHi\n\n"
        "# One \\<x> {lang=fr}\n::: {.source-attribution lang=en}\n*Source: [https://a.example/1](https://a.example/1)* | *Author: Ann* | *Date: 2024-01-02*\n:::\n\nText[^c1fn1].\n\n"
        "# Deux {lang=en}\n::: {.source-attribution}\n*Source: [https://a.example/3](https://a.example/3)*\n:::\n\nPlus long texte.\n")
    books.write_books(parts, str(tmp_path / "books"))
    from leafmill.sources.books import scan_book_lines

    read = scan_book_lines(spark, str(tmp_path / "books"))
    assert read.filter("book_id = 'b' AND line LIKE '# %'").count() == 4
    lines = sorted(read.collect(), key=lambda r: (r.section, r.number, r.line_no))
    assert "\n".join(r.line for r in lines) == "\n".join(r.text for r in rows)


PAGE = """<html lang="en"><head><title>My Post | Site</title><script>var x="</p>";</script></head><body><header><h1>Site</h1></header><nav><a href="/x">x</a></nav>
<article><h1>My Post</h1><p>Hello <b>bold</b> and <a href="/a_(b)">link</a> &amp; H<sub>2</sub>O.<sup><a href="#n1">1</a></sup></p><ul><li>one</li><li>two<ul><li>deep</li></ul></li></ul>
<pre><code>x = 1
  y</code></pre><table><caption>Cap</caption><tr><th>a</th><th>b</th></tr><tr><td rowspan=2>1</td><td>x|y</td></tr><tr><td>z</td></tr></table>
<figure><a href="/i.png"><img src="/i.png" alt="alt"></a><figcaption>The cap</figcaption></figure><p>a<br>5 * 3<p>open <b>tags</article><ol><li id="n1">Note one <a href="#r" class="backref">back</a></li></ol><footer>f</footer></body></html>"""


def test_page(table):
    raw = table("page_id long, url string, html string", (1, "https://s.example/p/x", PAGE))
    md = page_markdown.to_markdown(raw).collect()[0].md
    assert md == (
        "# My Post\n\nHello **bold** and [link](/a_%28b%29) & H<sub>2</sub>O.[^fn1]\n\n- one\n- two\n  - deep\n\n```\nx = 1\n  y\n```\n\n**Cap**\n\n"
        "| a | b |\n| --- | --- |\n| 1 | x\\|y |\n|  | z |\n\n![The cap](https://s.example/i.png)\n\na  \n5 \\* 3\n\nopen **tags**\n\n[^fn1]: Note one")
    parsed = nodes.with_nodes(raw)
    assert values(parsed, pages.checked_title(F.lit("Site"))) == ["My Post"]
    assert values(parsed, pages.kept_text(pages.chrome_spans()))[0].startswith("My Post | Site My Post Hello bold")
    rows = {r.no: r for r in nodes.node_table(raw).collect()}
    for r in rows.values():
        assert r.parent < r.no <= r.last
        if r.parent >= 0:
            assert rows[r.parent].last >= r.last and r.path == rows[r.parent].path + rows[r.parent].tag + "/"


def test_layout_tables_and_title_rows(table):
    html = "<table><tr><td><table><tr><td colspan=2>Title</td></tr><tr><td>a</td><td>b</td></tr><tr><td>c</td></tr></table></td></tr></table><table><tr><td>only</td></tr></table>"
    cells = page_markdown.table_cells(nodes.with_nodes(table("page_id long, url string, html string", (1, "https://s.example/", html)))).collect()
    assert [(c.row_no, c.col_no, c.text) for c in cells] == [(0, 0, "a"), (0, 1, "b"), (1, 0, "c"), (1, 1, "")]


def test_code_tables_and_formulas(table):
    html = ('<body><article><p>E is <span><math alttext="E=mc^2" display="inline"><annotation encoding="application/x-tex">E=mc^2</annotation></math></span> here.</p>'
            "<table><tr><td><pre>1\n2</pre></td><td><pre>x = 1\ny = 2\n</pre></td></tr></table><pre> </pre></article></body>")
    md = page_markdown.to_markdown(table("page_id long, url string, html string", (1, "https://s.example/", html))).collect()[0].md
    assert md == "E is $E=mc^2$ here.\n\n```\nx = 1\ny = 2\n```"


def test_book_files(table, tmp_path, spark):
    from leafmill.operators.jobs import write_item_list
    from leafmill.sources.books import scan_books

    (tmp_path / "a.md").write_text("# One\n\ntext\n\n# Sources {.front-matter}\nx\n# One\nlater")
    books_read = scan_books(spark, str(tmp_path))
    rows = markdown.split_chapters(books_read.withColumnRenamed("file_name", "book_id")).collect()
    assert [(r.book_id, r.title, r.body) for r in rows] == [("a.md", "One", "later")]
    write_item_list(table("job_id long, number long, title string", (1, 2, "b"), (1, 1, "a")), str(tmp_path / "items"))
    assert [r.title for r in spark.read.json(str(tmp_path / "items")).orderBy("number").collect()] == ["a", "b"]


def test_a_page_of_any_size_has_nodes(table):
    big = "<p>" + "x" * (21 * 1024 * 1024) + "</p>"
    row = nodes.with_nodes(table("page_id int, url string, html string", (1, "u", big))).select(F.size("nodes").alias("n"), F.length(F.element_at("nodes", -1)["text"]).alias("size")).first()
    assert (row.n, row.size) == (2, 21 * 1024 * 1024)


def test_the_hundredth_feed_stays_in_its_strategy(table):
    from leafmill.operators import discovery

    sources = table("job_id int, source_index int, url string, query string", (1, 0, "https://a.example/", None))
    declared = table("url string, rank int, feed_url string", *[("https://a.example/", k, f"https://a.example/f{k}") for k in range(130)])
    entries = table("feed_url string, pos int, title string, item_url string, audio_url string", ("https://a.example/f120", 0, "declared", "https://a.example/x", None),
                    ("https://a.example/feed", 0, "guessed", "https://a.example/y", None))
    pages = table("url string, title string, reads_as_article boolean", ("https://a.example/", "t", False))
    links = table("url string, place int, href string, title string, uncertain boolean", ("https://a.example/", 0, "https://a.example/z", "link", False))
    rows = discovery.expand_sources(sources, pages, declared, entries, links).collect()
    assert [(r.strategy, r.title) for r in rows] == [(3, "declared")]


def test_words_are_cut_alike_in_a_row_and_in_blocks(spark):
    import random

    from leafmill.sources import captions

    def cut_words(words):
        """One word after the other: a new segment before a word that follows a sentence's end or another speaker's word."""
        out, before, end = [], None, 0.0
        for text, kind, a, b, who in words:
            if kind == "audio_event":
                continue
            if kind == "word" and before is not None and (before[0].rstrip().endswith((".", "?", "!")) or before[1] != who):
                out.append(["", None, end, None])
            if not out:
                out.append(["", None, end, None])
            out[-1][0] += text
            if kind == "word":
                if out[-1][1] is None:
                    out[-1][1], out[-1][3] = a, who
                before, end = (text, who), end if b is None else b
                out[-1][2] = end
        return [(t.strip(), a or 0.0, e, w) for t, a, e, w in out if t.strip()]

    chance = random.Random(8)
    schema = "id int, pos bigint, text string, kind string, start_s double, end_s double, speaker_id string"
    rows, wanted = [], {}
    for i in range(12):
        words = []
        for j in range(chance.randint(1, 60)):
            kind = chance.choice(["word"] * 6 + ["spacing", "audio_event"])
            text = {"word": chance.choice(["a", "b.", "c?", "d "]), "spacing": " ", "audio_event": "(x)"}[kind]
            words.append((text, kind, float(j), chance.choice([j + 0.5, None]), chance.choice("SST")))
        wanted[i] = cut_words(words)
        rows += [(i, j, *w) for j, w in enumerate(words)]
    df = spark.createDataFrame(rows, schema)
    for block in (1, 3, 7, 4096):
        found = {}
        for r in captions.word_segments(df, "id", block).orderBy("id", "seg_no").collect():
            found.setdefault(r.id, []).append((r.text, r.start_s, r.end_s, r.speaker))
        assert found == {i: w for i, w in wanted.items() if w}, block
    payloads = spark.createDataFrame(
        [(i, __import__("json").dumps({"words": [dict(zip(("text", "type", "start", "end", "speaker_id"), r[2:])) for r in rows if r[0] == i]})) for i in wanted], "payload_id int, body string")
    found = {}
    for r in captions.speech_segments(payloads).orderBy("payload_id", "seq").collect():
        found.setdefault(r.payload_id, []).append((r.text, r.start_s, r.end_s, r.speaker))
    assert found == {i: w for i, w in wanted.items() if w}


def test_a_reference_without_semicolon_is_text(table):
    html = ('<body><article><h1>a &amp;&amp</h1><p x&y="1">b &lt c &lt;&#65; <a href="?a=1&copy=2&amp;c">d&eacute;</a></p><x&y>e</x&y>f&</article>'
            "<script>a &amp b &lt; c && d</script></body>")
    rows = nodes.node_table(table("page_id long, url string, html string", (1, "https://s.example/", html))).collect()
    assert [r.text for r in rows if r.tag == "#text"] == ["a &&amp", "b &lt c <A ", "d\u00e9", "e", "f&"]
    assert [r.text for r in rows if r.tag == "#raw"] == ["a &amp b &lt; c && d"]
    assert [r.attrs for r in rows if r.attrs] == [{"x&y": "1"}, {"href": "?a=1&copy=2&c"}]
    assert "x&y" in [r.tag for r in rows]


def test_nodes_of_some_tags_are_those_of_the_page(table):
    raw = table("page_id long, url string, html string", (1, "https://s.example/p/x", PAGE), (2, "https://s.example/", "<ol><li>a<h1>b <i>c</i></h1><li>d</ol>x<h1>e"), (3, "u", None))
    whole = {(r.page_id, r.no): r for r in nodes.node_table(raw).collect()}
    for tags in (("h1",), ("title", "meta", "link"), ("li", "h1"), ("blink",)):
        roots = [r for r in whole.values() if r.tag in tags]
        want = sorted((k, r) for k, r in whole.items() if any(r.page_id == x.page_id and x.no <= r.no <= x.last for x in roots))
        rows = nodes.with_nodes(raw, only=tags, html=True).select("page_id", "html", F.explode("nodes").alias("n")).select("page_id", "html", "n.*").orderBy("page_id", "no").collect()
        assert [(r.page_id, r.tag, r.path, r.attrs, r.text, r.item, r.last - r.no) for r in rows] == [(r.page_id, r.tag, r.path, r.attrs, r.text, r.item, r.last - r.no) for _, r in want]
        for page in (1, 2):
            own = [r for r in rows if r.page_id == page]
            assert [r.no for r in own] == list(range(len(own))) and all(r.parent < r.no for r in own)


def test_article_records_shuffle_neither_pages_nor_texts(spark):
    from leafmill.plans.catalog import QUERIES

    todo, joins = [QUERIES["article_record"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan()], 0
    while todo:
        plan = todo.pop()
        below = [plan.children().apply(i) for i in range(plan.children().size())]
        todo += below
        if plan.nodeName() == "Join":
            joins += 1
            columns = {name for child in below for name in child.output().mkString(",").replace("#", ",").split(",")}
            assert not columns & {"html", "nodes", "md"}
    assert joins == 1


def test_words_are_shuffled_once(spark):
    # Blocks are cut and settled; what is left to read is their pieces, not the words again.
    words = spark.createDataFrame([(1, i, w, "word", float(i), i + 0.5, "S") for i, w in enumerate(("a ", "b. ", "c ", "d. ", "e. ", "f "))],
                                  "id int, pos bigint, text string, kind string, start_s double, end_s double, speaker_id string")
    for block in (2, 4096):
        found = captions.word_segments(words, "id", block)
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "audio_event" not in plan and "is_word" not in plan
        assert [tuple(r) for r in found.orderBy("seg_no").collect()] == [(1, 0, "a b.", 0.0, 1.5, "S"), (1, 1, "c d.", 2.0, 3.5, "S"), (1, 2, "e.", 4.0, 4.5, "S"), (1, 3, "f", 5.0, 5.5, "S")]
