"""Pages, archives and vectors against brute force."""

import hashlib
import random
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
import zstandard

sys.path.insert(0, str(Path(__file__).resolve().parent))

from leafmill.llm import html_text, topk, warc  # noqa: E402
from leafmill.shared import shared_folder  # noqa: E402

PAGE = "page_id bigint, url string, html string, record int, error string, size int"


def pages(spark, rows):
    return spark.createDataFrame([(*r, 1, "e", 2) for r in rows], PAGE)


LONG = "<p>ü" + "x" * 1200
ODD_PAGES = [
    (1, "http://a.example/", LONG), (2, "http://a.example/2", LONG), (9, None, LONG), (3, "u\r\nX: y", "small"), (4, "u", "small"), (5, "u", None), (6, "u", ""),
    (7, "u", "y" * 3_000_000), (None, "u", LONG), (2, "http://a.example/2", LONG), (8, "u", "\r\n\r\nWARC/1.1\r\n\r\n"), (10, "u", "z" * 1000), (11, "u", "z" * 999), (12, "u", "z" * 1000), (13, "u", "z" * 999),
]


def test_archives_come_back_whole(spark):
    path = shared_folder(spark, "test-warc")
    warc.write(pages(spark, ODD_PAGES), path)
    rows = warc.read(spark, path).collect()
    responses = {}
    for i, _, h in ODD_PAGES:
        if i is not None:
            responses[h or ""] = max(responses.get(h or "", i), i)
    want = Counter()
    for i, _, h in ODD_PAGES:
        body = (h or "").encode()
        other = responses.get(h or "") if len(body) >= 1000 else None
        again = other is not None and other != i
        want[(i, len(body), hashlib.sha1(body).hexdigest(), "revisit" if again else "response", other if again else None, None if again else body, None)] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload), r.error) for r in rows) == want
    assert len({(r.archive, r.record) for r in rows}) == len(rows)


def test_an_archive_starts_with_its_dictionary_and_has_a_frame_per_record():
    records = [warc.record_bytes(i, "u", b"body %d" % i * 50, len(b"body %d" % i * 50), hashlib.sha1(b"body %d" % i * 50).hexdigest(), None) for i in range(300)]
    archive, = warc.archives(iter(records))
    size = int.from_bytes(archive[4:8], "little")
    assert archive[:4] == b"\x5d\x2a\x4d\x18" and list(warc.frames(archive)) == records
    plain = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(archive[8 : 8 + size]))
    assert plain.decompressobj().decompress(archive[8 + size :]) == records[0]
    assert list(warc.archives(iter([]))) == []


def test_damage_is_found():
    good = warc.record_bytes(1, "u", b"payload", 7, hashlib.sha1(b"payload").hexdigest(), None)
    assert warc.parsed(good)["payload"] == b"payload"
    for bad in (
        good.replace(b"payload\r\n", b"paYload\r\n"), good[:-1], good.replace(b"WARC/1.1", b"WARC/0.9"), good.replace(b"WARC-Date", b"WARC-Dat"), good + b"x",
        good.replace(b"Content-Length: 7", b"Content-Length: 8"), good.replace(b"Type: response", b"Type: other"), b"", good.replace(b"<urn:page:1>", b"<urn:page:1"),
    ):
        with pytest.raises(ValueError):
            warc.parsed(bad)
    archive, = warc.archives(iter([good, good]))
    for bad in (archive[:-3], archive[:4], b"abcdefgh" + archive):
        with pytest.raises(warc.Damaged):
            list(warc.frames(bad))


def test_frames_are_decoded_from_pieces(monkeypatch):
    bodies = [random.Random(n).randbytes(n) for n in (0, 10, 5_000, 200_000, 30)]
    records = [warc.record_bytes(i, "u", b, len(b), hashlib.sha1(b).hexdigest(), None) for i, b in enumerate(bodies)]
    archive, = warc.archives(iter(records))
    handed, real = [], zstandard.ZstdDecompressor

    class Noted:
        def __init__(self, **kw):
            self.real = real(**kw)

        def decompressobj(self):
            noted = self

            class Object:
                def __init__(self):
                    self.real = noted.real.decompressobj()

                def decompress(self, data):
                    handed.append(len(data))
                    return self.real.decompress(data)

                eof = property(lambda self: self.real.eof)
                unused_data = property(lambda self: self.real.unused_data)

            return Object()

    monkeypatch.setattr(warc.zstandard, "ZstdDecompressor", Noted)
    assert list(warc.frames(archive)) == records
    assert max(handed) < 100_000 < len(archive)


def test_payloads_that_are_not_asked_for_are_checked(spark):
    path = shared_folder(spark, "test-warc")
    warc.write(pages(spark, ODD_PAGES), path)
    whole, bare = (warc.read(spark, path, payloads) for payloads in (True, False))
    assert whole.drop("payload").exceptAll(bare.drop("payload")).count() == 0 == bare.filter("payload IS NOT NULL").count()
    assert whole.count() == bare.count()


def test_few_repeated_payloads_shuffle_no_page(spark):
    plan = warc.planned(pages(spark, ODD_PAGES))
    plan.collect()
    assert "Exchange hashpartitioning" not in plan._jdf.queryExecution().executedPlan().toString()


def test_no_archives(spark):
    path = shared_folder(spark, "test-warc")
    warc.write(pages(spark, []), path)
    assert warc.read(spark, path).count() == 0


# --- 7: top-k

VECTOR = "vec_id bigint, embedding array<float>, rank int, score double"


def brute_top(rows, k):
    fit = {(i, tuple(int(np.floor(float(np.float32(x)) * 256)) for x in v)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    out = set()
    for q, a in fit:
        if q % 50 == 0:
            scored = sorted({(-sum(x * y for x, y in zip(a, b)), c) for c, b in fit if c != q and len(b) == len(a)})
            out |= {(q, n, c, -s) for n, (s, c) in enumerate(scored[:k], 1)}
    return out


@pytest.mark.parametrize("spread", [0.01, 1.0])
def test_top_k_is_exact(spark, spread):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(size=24) * spread).astype(float).tolist()) for i in range(320)]
    rows += [(400, rows[3][1]), (401, rows[3][1]), (3, rows[3][1]), (402, None), (450, [float("nan")] * 24), (403, [None] * 24), (404, [float("inf")] + [0.0] * 23), (None, rows[3][1])]
    rows += [(500, [1.0, -2.0]), (501, [0.5, 0.5]), (550, []), (551, []), (600, [9.0])]
    df = spark.createDataFrame([(i, v, 1, 0.0) for i, v in rows], VECTOR)
    got = topk.top_k(df, 5, df["vec_id"] % 50 == 0).collect()
    assert sorted(map(tuple, got)) == sorted(brute_top(rows, 5))


def test_top_k_in_several_query_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERY_BLOCK", 3)
    rng = np.random.default_rng(5)
    rows = [(i, rng.integers(-2, 3, 8).astype(float).tolist()) for i in range(0, 600, 5)]
    df = spark.createDataFrame([(i, v, 1, 0.0) for i, v in rows], VECTOR)
    assert set(map(tuple, topk.top_k(df, 3, df["vec_id"] % 50 == 0).collect())) == brute_top(rows, 3)
    assert topk.top_k(df.limit(0), 3, df["vec_id"] % 50 == 0).count() == 0


# --- 10: main text

CASES = {
    "": "", "   ": "", "text only": "text only", "a < b && c &lt; d <b": "a < b && c < d <b", "<p>one<p>two, three.": "one\ntwo, three.",
    "<article><h1>T</h1><p>x &amp;amp; y&nbsp;z<br>w</p></article><footer>f</footer>": "T\nx &amp; y z w",
    "<html><body class='has-sidebar'><header><h1>Site</h1><ul><li><a href=x>Home</a></ul></header><div id=cookie-notice>We use cookies, a lot.</div><div class='content'><h2>Title</h2>"
    "<p>First, with <b>bold</b> text.<p>Second; long enough to count.<ul><li>item one<li>item two</ul><p>ok.<div class=comments><p>Nice post! I loved it; great.</p></div></div>"
    "<aside>More</aside><form><p>name</p></form><script>if(a<b){x='</p>'}</script><footer>c 2020</footer>": "Title\nFirst, with bold text.\nSecond; long enough to count.\nitem one\nitem two\nok.",
    "<nav><p>Home, about.</p></nav><main><article><header><h1>Head</h1></header><p>Body text, long.</p></article><section class=comments><p>hello, there.</p></section></main>": "Head\nBody text, long.",
    "<div class=ad>Buy, now!</div><table><tr><td>Left, a<td>Right, b</table>": "Left, a\nRight, b",
    "<article><p>A, b.<!-- no <p>comment --><style>p{}</style><p title='a>b'>C, d.</article>": "A, b.\nC, d.",
    "<article><p>Café &eacute; &#8212; &#x2014; x.</p><div class='newsletter-signup'>Sign up, please.</div><p>tail</p></article>": "Café é — — x.\ntail",
}


def test_main_texts(spark):
    rows = [(i, f"u{i}", h) for i, h in enumerate(CASES)] + [(None, None, None), (0, "u0", "")]
    got = html_text.main_texts(pages(spark, rows)).collect()
    want = [(i, f"u{i}", t, len(t)) for i, t in enumerate(CASES.values())] + [(None, None, "", 0), (0, "u0", "", 0)]
    assert Counter(map(tuple, got)) == Counter(want)
    assert html_text.main_texts(pages(spark, [])).count() == 0


LONG = "This is a long paragraph, with marks; and many words in it. "
P = f"<p>{LONG * 4}</p>"
SHAPES = {
    f"<body><form id=aspnetForm><div class=top-nav><a href=x>Menu</a></div><div class=text><h1>Head</h1>{P}{P}</div></form></body>": ("Head", 2),
    f"<body><nav><a>menu</a></nav><div class='elementor-widget-container'><h1>Head</h1>{P}{P}</div><footer>f</footer></body>": ("Head", 2),
    f"<body><div class='widget Blog'><div class=post><h3>Head</h3>{P}</div><div class=comments><p>{LONG}</p></div></div></body>": ("Head", 1),
    f"<article><h1>Head</h1>{P}<div class='share-of-market'>{P}</div><div class='share-buttons'><a>Tweet</a></div></article>": ("Head", 2),
    f"<body><div class=menu><a>m</a></div><div class=post><h1>Head</h1><p>Lead</p><div class=entry>{P}{P}</div></div></body>": ("Head\nLead", 2),
    f"<body><div class=wrap><div class=one>{P}</div><div class=ad>Buy</div><div class=two>{P}</div></div><footer>f</footer></body>": ("", 2),
    f"<body><div class=post><h1>Head</h1>{P}{P}</div><div id=comments><p>{LONG * 2}</p></div></body>": ("Head", 2),
    f"<body><div class=links><ul><li><a>one</a></li><li><a>two</a></li></ul></div><div class=c>{P}{P}</div></body>": ("", 2),
}


@pytest.mark.parametrize("page", list(SHAPES))
def test_pages_without_a_plain_article(page):
    head, paragraphs = SHAPES[page]
    assert html_text.main_text(page) == "\n".join([head] * bool(head) + [(LONG * 4).strip()] * paragraphs)


def test_the_ratios_select(monkeypatch):
    page = list(SHAPES)[-1]
    with_ratios = html_text.main_text(page)
    monkeypatch.setattr(html_text, "content", lambda blocks, page: [True] * len(blocks))
    assert html_text.main_text(page) != with_ratios


def test_odd_markup_ends_soon():
    chance = random.Random(3)
    marks = ["<", ">", "</", "<p>", "<b", "\"", "'", "<!--", "-->", "&", ";", "<script>", "</script", "<li>", "</ul>", "<td>", "x", " ", "<![CDATA[", "]]>", "=", "<article>"]
    for _ in range(400):
        html_text.main_text("".join(chance.choice(marks) for _ in range(chance.randint(0, 80))))
    html_text.main_text("<" * 50_000)
    html_text.main_text("<a " + "x='" * 20_000)
    html_text.main_text("<div>" * 3000 + "deep, text." + "</div>" * 3000)
