"""Phrases against plain dictionaries over texts; the query's SQL is in test_queries."""

import random
import re
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

from edge import edge_documents, edge_texts, no_documents  # noqa: E402

from leafmill.llm import collocations  # noqa: E402

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, top, longest=4, inside=80):
    f, totals = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        totals[lang] += 0
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)):
            w = [x for x in re.split(r"[ \t]+", piece) if x]
            totals[lang] += len(w)
            for n in range(1, longest + 1):
                for i in range(len(w) - n + 1):
                    f[lang, tuple(w[i : i + n])] += 1
    often = {k: v for k, v in f.items() if v >= least}
    out = []
    for (lang, w), a in often.items():
        if len(w) == 1:
            continue
        score, k = min((2_000_000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k) for k in range(1, len(w)))
        held = any(
            100 * b >= inside * a and any(v[i : i + len(w)] == w for i in range(len(v) - len(w) + 1))
            for (other, v), b in often.items() if other == lang and len(v) > len(w)
        )
        if not held:
            out.append((lang, score, a, " ".join(w), f[lang, w[:k]], f[lang, w[k:]]))
    rows_ = []
    for lang in totals:
        ranked = sorted((x for x in out if x[0] == lang), key=lambda x: (-x[1], -x[2], x[3].encode()))[:top]
        rows_ += [(lang, i + 1, p, a, left, right, totals[lang], s) for i, (_, s, a, p, left, right) in enumerate(ranked)]
    return sorted(rows_)


def found(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def many_texts(seed=3):
    chance = random.Random(seed)
    vocabulary = ["alpha", "Beta", "gamma", "é", "naïve", "d", "EPS", "zeta", "a.b", "(x)", "\x00z", "nb sp"]
    rows = [(text, lang) for (_, text), lang in zip(edge_texts(), ["en", None, "de", "en", "", "und"] * 5)]
    for _ in range(150):
        words = []
        while len(words) < chance.randint(0, 60):
            words += ["new", "york", "city"] if chance.random() < 0.1 else [chance.choice(vocabulary)]
            words[-1] += chance.choice(["", "", "", ".", ",", "\n", "\t", "  ", "\x0b", "!?"])
        rows.append((" ".join(words), chance.choice(["en", "en", "de", None])))
    return rows


@pytest.mark.parametrize("cut", [2 << 20, 300])
def test_matches_dictionaries(spark, monkeypatch, cut):
    rows = many_texts()
    monkeypatch.setattr(collocations, "slices", lambda column: [(i, i + 1) for i in range(len(column))] if cut == 300 else [(0, len(column))])
    docs = spark.createDataFrame([(t, g, 1, "x", 2) for t, g in rows], "text string, lang string, rank int, phrase string, n int")
    assert found(collocations.collocations(docs, least=5, top=40)) == brute(rows, 5, 40)


def test_repeated_rows_one_language_and_empty(spark):
    docs = edge_documents(spark)
    rows = [(r.text, r.lang) for r in docs.collect()] * 3
    assert found(collocations.collocations(docs.union(docs).union(docs), least=30)) == brute(rows, 30, 2000)
    assert found(collocations.collocations(no_documents(spark))) == []
    assert found(collocations.collocations(docs.filter("text is null"))) == []


def test_equal_fingerprints_are_told_apart(spark, monkeypatch):
    # Fingerprints of which only the slice is left: the second value alone separates phrases.
    real = collocations.Slice.prints

    def few(self, at, n, bits):
        first, second = real(self, at, n, bits)
        return first & np.uint64(0xFC00000000000000), second

    rows = many_texts(4)
    monkeypatch.setattr(collocations.Slice, "prints", few)
    own = collocations.Slice(pa.array([t for t, _ in rows]), pa.array(["en"] * len(rows)))
    first, second = own.prints(own.starts(2), 2, 6)
    order, new = collocations.identified(first, second)
    wanted = Counter()
    for i in own.starts(2):
        wanted[own.phrase(int(i), 2)] += 1
    counts = {own.phrase(int(own.starts(2)[order[a]]), 2): b - a for a, b in zip(new, [*new[1:], len(order)])}
    assert counts == dict(wanted) and len(np.unique(first)) < len(wanted) / 4


def test_scores_pass_64_bits(spark):
    # 2,000,000 * a beyond 2^63 is exact.
    from pyspark.sql import functions as F

    row = spark.range(1).select(F.lit(6 * 10**12).alias("a"), F.lit(7 * 10**12 + 1).alias("l"), F.lit(9 * 10**12).alias("r"))
    score = F.expr("(cast(2000000 as decimal(18,0)) * cast(a as decimal(20,0))) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    assert row.select(score).first()[0] == 2_000_000 * 6 * 10**12 // (16 * 10**12 + 1)
