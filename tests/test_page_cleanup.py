"""Pages rewritten before they become Markdown: images, tables, code, notes, encyclopedia pages."""

import time

import pytest

from leafmill.operators.page_cleanup import rewritten
from leafmill.operators.page_markdown import to_markdown
from leafmill.sources.pages import _Nodes
from leafmill.sources.sweep import Flat

URL = "https://x.test/post/"


def markdown(table, *pages, encyclopedia=False, url=URL):
    rows = to_markdown(table("page_id long, url string, html string", *[(i, url, p) for i, p in enumerate(pages)]), encyclopedia=encyclopedia).collect()
    return [r.md for r in sorted(rows, key=lambda r: r.page_id)]


def test_images(table):
    found = markdown(
        table,
        '<p>a</p><a href="https://x.test/big.png"><img src="https://x.test/fig.png"/></a>',
        '<p><a href="https://x.test/page"><img src="i.png" alt="icon"/> Read more</a></p>',
        '<p>x</p><img src="/post/./fig.jpg" alt="a b"/><img src="data:image/png;base64,AA">',
        '<p>x</p><a href="/f"><graphic src="//cdn.test/fig.png"></graphic></a><graphic src="http://cdn.test/fig.png"></graphic><img src="">',
        '<figure><a href="/big"><img src="z.png" alt="no" title="hover"></a><figcaption>The <em>porch</em>\n today</figcaption></figure><p>after</p>',
        '<div class="x wp-caption"><img src="z.png"><p class="wp-caption-text">Beside</p></div>',
        '<figure><img src="a.png" alt="one"><img src="b.png"><figcaption>Two</figcaption></figure>',
        '<p>t</p><img src="dot.gif" width="1"><img src="wide.gif" width="100" height="2"><img src="a(1).png">',
    )
    assert found == [
        "a\n\n![](https://x.test/fig.png)",
        "[![icon](https://x.test/post/i.png) Read more](https://x.test/page)",
        "x\n\n![a b](https://x.test/post/fig.jpg)![](data:image/png;base64,AA)",
        "x\n\n![](https://cdn.test/fig.png)",
        "![The porch today](https://x.test/post/z.png)\n\nafter",
        "![Beside](https://x.test/post/z.png)",
        "![one](https://x.test/post/a.png)![](https://x.test/post/b.png)\n\nTwo",
        "t\n\n![](https://x.test/post/a%281%29.png)",
    ]


def test_tables_and_code(table):
    found = markdown(
        table,
        "<table><tr><th><p>Pitfall</p></th><th><p>Mitigation</p></th></tr><tr><td><p>Hype</p></td><td><p>Ship <b>it</b></p></td></tr></table>",
        "<table><tr><td><img/></td><td><p/><img src='/s.gif' width='26' height='1'/></td></tr></table><table><tr><td><p>July 2023</p><p>First.</p><p>Second.</p></td></tr></table>",
        "<table><tr><td><pre>1\n2\n3</pre></td><td><pre>def f():\n    return 1</pre></td></tr></table>",
        "<p>Text</p><pre><code></code></pre><p><code>kept</code></p>",
        f"<table><tr><td>{'word ' * 300}</td><td>b</td></tr></table>",
        "<table><tr><td>a<table><tr><td>1</td><td>2</td></tr></table></td></tr></table>",
        "<pre><pre>one</pre> <pre>two</pre></pre><p>see <pre>x = 1</pre></p>",
        "<table><tr><td>1</td><td>x<sup><a href='#n'>1</a></sup></td></tr></table><ol><li id='n'>Note.</li></ol>",
    )
    assert found[0] == "| Pitfall | Mitigation |\n| --- | --- |\n| Hype | Ship it |"
    assert found[1] == "July 2023\n\nFirst.\n\nSecond."
    assert found[2] == "```\ndef f():\n    return 1\n```"
    assert found[3] == "Text\n\n`kept`"
    assert found[4] == "word " * 299 + "word\n\nb"
    assert found[5] == "a\n\n| 1 | 2 |\n| --- | --- |"
    assert found[6] == "```\none\ntwo\n```\n\nsee `x = 1`"
    assert found[7] == "| 1 | x [^fn1] |\n| --- | --- |\n\n[^fn1]: Note."


def test_notes_keep_their_formatting(table):
    found = markdown(
        table,
        '<p>Zeno taught at the Stoa.<sup id="fnref:1"><a href="#fn:1" class="footnote-ref">1</a></sup></p><div class="footnotes" role="doc-endnotes"><hr><ol>'
        '<li id="fn:1"><p>The painted porch. <a href="#fnref:1" class="footnote-backref">↩︎</a></p></li></ol></div>',
        '<p>A claim<a class="footnote-anchor" id="footnote-anchor-1" href="#footnote-1">1</a>.</p>'
        '<div class="footnote"><a id="footnote-1" href="#footnote-anchor-1" class="footnote-number">1</a><div class="footnote-content"><p>The <em>source</em>.</p></div></div>',
        '<p>Stoa<sup id="r1"><a href="./S%C3%A9#cite-1"><span>[</span>1<span>]</span></a></sup><sup class="v">,</sup><sup id="ra"><a href="./S#cite-a">[a]</a></sup>.</p>'
        '<p>Again<sup id="r1b"><a href="#cite-1">[1]</a></sup>.</p><div><ol><li id="cite-1"><span class="mw-cite-backlink"><a href="#r1">↑</a></span> <span>Diogène, VII.</span></li>'
        '<li id="cite-a"><a href="#ra">↑</a> Le portique.</li></ol></div>',
        '<p>See <a href="#method">the method</a>, the XIX<sup>e</sup> century, x<sup>2</sup>.</p><h2 id="method">Method</h2>',
        '<p>Text<sup><a href="#n1">1</a></sup>.</p><ol><li id="n1"><a href="#x">↩</a></li></ol>',
        '<p>Text<sup><a href="#n1">1</a></sup></p><ol><li id="n1"><p>One <a href="/r">ref</a>.</p><ul><li>a</li><li>b</li></ul><p>Two.</p></li></ol>',
        f'<p>T<sup><a href="#n1">1</a></sup></p><div id="n1">{"long " * 1000}</div>',
        '<ol><li id="n2">Two.</li><li id="n1">One <b>b</b>.</li></ol><p>A<sup><a href="#n1">1</a></sup> B<sup><a href="#n2">2</a></sup></p><h2>Notes</h2>',
    )
    assert found[0] == "Zeno taught at the Stoa.[^fn1]\n\n[^fn1]: The painted porch."
    assert found[1] == "A claim[^fn1].\n\n[^fn1]: The *source*."
    assert found[2] == "Stoa[^fn1][^fn2].\n\nAgain[^fn1].\n\n[^fn1]: Diogène, VII.\n\n[^fn2]: Le portique."
    assert "[the method](#method)" in found[3] and "XIX<sup>e</sup>" in found[3] and "[^" not in found[3]
    assert found[4] == "Text."
    assert found[5] == "Text[^fn1]\n\n[^fn1]: One [ref](/r).\n\n    - a\n    - b\n\n    Two."
    assert found[6].startswith("T<sup>[1](#n1)</sup>\n\nlong long")
    assert found[7] == "A[^fn1] B[^fn2]\n\n## Notes\n\n[^fn1]: One **b**.\n\n[^fn2]: Two."


def test_encyclopedia_page(table):
    page = (
        '<html><body><section data-mw-section-id="0"><div class="hatnote">For other uses, see X.</div><p>Zeno taught at the <a href="./Stoa_Poikile">Stoa</a>.'
        '<sup class="mw-ref reference"><a href="#cite_note-1">[1]</a></sup><sup class="citation nobold"><a href="./Stoicism#endnote_A">[a]</a></sup></p>'
        '<figure><a href="./File:Zeno.jpg"><img src="//upload.example/zeno.jpg"></a><figcaption>Zeno</figcaption></figure>'
        '<p>Softmax: <span><math><semantics><annotation>{\\displaystyle x}</annotation></semantics></math><img src="//m.example/x.svg"></span></p></section>'
        '<section><h2>Sources</h2><p>Diogenes is our main witness.</p><section><h3>Notes</h3><p>inner</p></section></section><section><h2>Notes</h2><p>1. A note.</p><ol><li id="cite_note-1">By <a href="./D">D</a>.</li></ol></section>'
        '<section><h2>Fragment collections</h2><p>SVF.</p></section><div class="navbox">Philosophy navigation</div></body></html>'
    )
    formulas = (
        '<p>written as <math class="mwe-math-element-inline" data-mw=\'{"name":"math","body":{"extsrc":"d_{\\\\text{emb}}"}}\'><mi>d</mi></math>.</p>'
        '<p><math class="mwe-math-element-block" display="block" alttext="{\\displaystyle a^2}"><mi>a</mi></math></p><p><math><mi>b</mi></math>end</p>'
    )
    found = markdown(table, page, formulas, "", encyclopedia=True, url="https://en.wikipedia.org/wiki/Stoicism")
    assert found[0] == (
        "Zeno taught at the [Stoa](https://en.wikipedia.org/wiki/Stoa_Poikile).[^fn1]\n\n![Zeno](https://upload.example/zeno.jpg)\n\nSoftmax: ![](https://m.example/x.svg)\n\n"
        "## Sources\n\nDiogenes is our main witness.\n\n### Notes\n\ninner\n\n[^fn1]: By [D](https://en.wikipedia.org/wiki/D)."
    )
    assert "A note" not in found[0] and "SVF" not in found[0] and "[a]" not in found[0] and "other uses" not in found[0]
    assert found[1] == "written as $d_{\\text{emb}}$.\n\n$${\\displaystyle a^2}$$\n\nend"
    assert found[2] == ""


def test_marks_of_more_than_three_digits(table):
    found = markdown(
        table,
        '<p>A<sup><a href="#n1">999</a></sup> B<sup><a href="#n2">1000</a></sup> C<sup><a href="#n3">[123456]</a></sup></p>'
        '<ol><li id="n1">One.</li><li id="n2">Two.</li><li id="n3">Three.</li></ol>',
    )
    assert found == ["A[^fn1] B[^fn2] C[^fn3]\n\n[^fn1]: One.\n\n[^fn2]: Two.\n\n[^fn3]: Three."]


@pytest.mark.parametrize("encyclopedia", [False, True])
def test_notes_alone_are_those_of_the_whole_page(encyclopedia):
    call = '<sup><a href="#n{0}">{0}</a></sup>'.format
    pages = [
        f'<main><p>a{call(1)}</p><img src="i.png"><ol><li id="n1">See <a href="/r">r</a> <img src="i.png"><img src="j.png" alt="j"></li></ol><img src="j.png"></main>',
        f'<p>a{call(1)}{call(2)}</p><table><tr><th>k</th><th>v</th></tr><tr><td><p id="n1">in a cell</p></td><td>x</td></tr></table><table><tr><td><div id="n2">layout</div><p>b</p><p>c</p></td></tr></table>',
        f'<p>a{call(1)}</p><pre>one<div id="n1">two <pre>three</pre></div></pre><p>b{call(2)}</p><div id="n2">Sum <math alttext="x_1"><mi>x</mi></math> <pre>y</pre><table><tr><td>1</td><td>2</td></tr></table></div>',
        f'<p>a{call(1)}{call(2)}</p><figure><img src="f.png"><figcaption><p id="n1">caption</p></figcaption></figure><div id="n2"><figure><img src="g.png"><figcaption>G</figcaption></figure></div>',
        f'<section><h2>Part</h2><p>a{call(1)}</p></section><section><h2>References</h2><div class="navbox"><ol><li id="n1">kept <i>here</i></li></ol></div><table class="collapsed"><tr><td>t</td></tr></table></section>',
        "<p>no notes</p><table><tr><td>1</td><td>2</td></tr></table>",
    ]
    parser = _Nodes()
    for page in pages:
        parser.add_page(page)
    urls = [URL] * len(pages)
    whole, alone = (rewritten(Flat.of(parser), urls, encyclopedia, notes_only) for notes_only in (False, True))
    assert alone[0].null_count == len(pages) and sum(len(x) for x in whole[1].to_pylist()) >= 6
    assert alone[1:] == whole[1:]


def test_site_furniture(table):
    found = markdown(
        table,
        "<header><p>Site</p></header><nav>menu</nav><article><header><h1>T</h1></header><p>text</p></article><footer>foot</footer>",
        "<body><header>Site</header><div><p>only text</p></div><script>x()</script></body>",
        "<main><header><p>kept</p></header><p>text</p></main><article>short</article>",
        "<header><article><p>a whole article</p></article></header>",
    )
    assert found == ["# T\n\ntext", "only text", "kept\n\ntext", "a whole article"]


def test_sweeps_agree_with_the_tree():
    parser = _Nodes()
    for page in ("<div><p>a<b>b</b></p><ul><li>c<li>d</ul></div><p>e", "", "<table><tr><td>1<table><tr><td>2</table></table>"):
        parser.add_page(page)
    flat = Flat(parser.array())
    for marked in (flat.tags("p", "td"), flat.tags("li"), flat.tags("nothing"), flat.tags("table")):
        for node in range(flat.n):
            chain, at = [], node
            while at < flat.n:
                chain.append(at)
                at = int(flat.parent[at])
            hits = [c for c in chain if marked[c]]
            assert flat.inside(marked)[node] == bool(hits) and flat.inside(marked, itself=False)[node] == any(marked[c] for c in chain[1:])
            assert flat.nearest(marked)[node] == (hits[0] if hits else flat.n)
            assert flat.below(marked)[node] == marked[node + 1 : flat.last[node] + 1].sum()


@pytest.mark.parametrize("shape", ["flat", "deep", "tables"])
def test_time_is_linear_in_the_nodes(shape):
    unit = {
        "flat": lambda i: f'<p>text {i} <b>bold</b><sup><a href="#n{i}">{i % 1000}</a></sup></p><ol><li id="n{i}">note <a href="/x">y</a></li></ol>',
        "deep": lambda i: f"<div class='c{i}'><p>t</p>",
        "tables": lambda i: f"<table><tr><td>{i}</td><td><img src='{i}.png'></td></tr></table><figure><img src='f{i}.png'><figcaption>c</figcaption></figure>",
    }[shape]

    def took(n):
        parser = _Nodes()
        parser.add_page("<main>" + "".join(map(unit, range(n))) + "</main>")
        nodes = parser.array()
        started = time.process_time()
        rewritten(Flat(nodes), [URL], False)
        return time.process_time() - started, len(nodes.flatten())

    (small, few), (large, many) = took(900), took(7200)
    assert many > 7 * few and large < 8 * small * 2.5 + 0.5
