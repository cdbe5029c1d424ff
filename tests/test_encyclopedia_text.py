"""An encyclopedia page's own text leaves the pass that reads the page: its nodes do not."""

from leafmill.operators.page_cleanup import encyclopedia_text

PAGES = [
    '<head><title>T</title></head><body><section>Lead<sup class="mw-ref">[1]</sup><sup>2</sup></section><section><h2>Story</h2>body</section>'
    '<section><div class="x mw-heading"><h2>See <i>also</i></h2></div>gone</section><section><h2>After</h2>gone too</section></body>',
    # A section below another closes only what stands beside it; the first in page order counts, not the first heading.
    '<section>a<section><h2>Notes</h2>b</section><section>c</section></section><section>d</section>',
    '<div class="navbox">x</div><table class="collapsed">x</table><table class="open">y</table><math>z</math> <p class="reflist no">w</p>',
    '<section><p><h2>Notes</h2></p>kept: the heading is no child</section>',
    None,
]


def test_own_text(table):
    rows = [(i, "u", html) for i, html in enumerate(PAGES)]
    text = encyclopedia_text(table("page_id long, url string, html string", *rows))
    assert "nodes" not in text._jdf.queryExecution().optimizedPlan().toString()
    assert [r.text for r in text.orderBy("page_id").collect()] == ["Lead 2 Story body", "a d", "y w", "Notes kept: the heading is no child", ""]
