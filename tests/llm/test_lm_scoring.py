"""The Bloom filter language model against counts in plain dictionaries."""

import math
import random
import sys
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

from edge import edge_documents, edge_texts, no_documents  # noqa: E402

from leafmill.llm import bloom_lm, words  # noqa: E402
from leafmill.llm.queries import QUERIES  # noqa: E402

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text):
    return [*(text or "").translate(LOWER).encode().split(), None]


def brute(rows, train, order=3):
    """Scores by the documented formulas, from dictionaries."""
    steps = [1]
    while steps[-1] < 10**7:
        steps.append(max(steps[-1] + 1, math.ceil(steps[-1] * 1.5)))
    level = lambda c: sum(1 for s in steps if s <= c)
    value = lambda c: math.sqrt(steps[level(c) - 1] * (steps[level(c)] - 1)) if c else 0.0
    counts = [Counter() for _ in range(order + 1)]
    n_texts = 0
    for row, learn in zip(rows, train):
        if learn:
            n_texts += 1
            seq = ["<", *tokens(row)]
            for k in range(1, order + 1):
                for i in range(1, len(seq)):
                    if i - k + 1 >= 0:
                        counts[k][tuple(seq[i - k + 1 : i + 1])] += 1
    n, v = sum(counts[1].values()), len(counts[1])

    def heaps(histories, kinds):
        low, high = 0.0, 1.0
        for _ in range(50):
            mid = (low + high) / 2
            low, high = (mid, high) if sum(h**mid for h in histories) < kinds else (low, mid)
        return (low + high) / 2

    growth = {}
    for k in range(2, order + 1):
        histories = [value(c) for c in counts[k - 1].values()] + ([value(n_texts)] if k == 2 and n_texts else [])
        growth[k] = heaps(histories, len(counts[k]))
    out = []
    for row in rows:
        seq, base, score, known = ["<", *tokens(row)], 0.0, 0.0, 0
        for i in range(1, len(seq)):
            c = counts[1][(seq[i],)]
            known += c > 0
            base += math.log10((c + 1) / (n + v + 1))
            p = (value(c) + 1) / (n + v + 1)
            for k in range(2, order + 1):
                if i - k + 1 < 0:
                    break
                h = tuple(seq[i - k + 1 : i])
                ch = n_texts if h == ("<",) else value(counts[k - 1][h])
                if ch:
                    q = min(value(counts[k][h + (seq[i],)]), ch, value(counts[k - 1][h[1:] + (seq[i],)]))
                    p = (q + 4 * ch ** growth[k] * p) / (ch + 4 * ch ** growth[k])
            score += math.log10(p)
        out.append((len(seq) - 1, known, n, base, score))
    return out


def check(found, wanted):
    found = sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in found)
    wanted = sorted((i is not None, i or 0, *w) for i, w in wanted)
    assert len(found) == len(wanted)
    for f, w in zip(found, wanted):
        assert f[:5] == w[:5] and f[5:] == pytest.approx(w[5:], rel=1e-9, abs=1e-9), (f, w)


@pytest.mark.parametrize("settings", [{}, {"ROUND_BYTES": 70000, "PIECE_BYTES": 30000}, {"HEAD": 20}])
def test_matches_dictionaries(spark, monkeypatch, settings):
    # So many bits that no false membership is left; small rounds, and words that are not broadcast.
    monkeypatch.setattr(bloom_lm, "BITS", 2000)
    for name, value in settings.items():
        monkeypatch.setattr(bloom_lm, name, value)
    texts = edge_texts()
    chance = random.Random(7)
    texts += [(100 + i, " ".join(chance.choice(["red", "Red", "blue", "fish", "one", "two"]) for _ in range(chance.randint(0, 25)))) for i in range(40)]
    train = [i is not None and i % 3 != 0 for i, _ in texts]
    learn = F.col("doc_id") % 3 != 0
    found = bloom_lm.scores(edge_documents(spark, texts), learn).collect()
    check(found, list(zip([i for i, _ in texts], brute([t for _, t in texts], train))))


def test_default_filter_overstates_little(spark):
    texts = [(i, t) for i, t in edge_texts() if i is not None]
    found = {r.doc_id: r.score for r in bloom_lm.scores(edge_documents(spark, texts), F.lit(True)).collect()}
    wanted = dict(zip([i for i, _ in texts], brute([t for _, t in texts], [True] * len(texts))))
    for i, score in found.items():
        assert score == pytest.approx(wanted[i][4], rel=0.05, abs=0.5)


def test_nothing_to_learn_from(spark):
    docs = edge_documents(spark)
    rows = bloom_lm.scores(docs, F.lit(False)).collect()
    assert len(rows) == docs.count() and all((r.n_known, r.train_tokens, r.base_score, r.score) == (0, 0, 0.0, 0.0) for r in rows)
    assert bloom_lm.scores(no_documents(spark), F.lit(True)).collect() == []


def test_text_order_and_cut_do_not_matter(spark):
    docs = edge_documents(spark)
    key = lambda df: sorted((str(r.doc_id), r.n_tokens, round(r.score, 6)) for r in df.collect())
    learn = F.lit(True)
    assert key(bloom_lm.scores(docs.repartition(7), learn)) == key(bloom_lm.scores(docs.coalesce(1), learn))


def test_query(spark):
    import zlib

    folder = "/root/testdata/sf0.001"
    rows = QUERIES["op11_lm_scoring"](spark, folder).collect()
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    train = [zlib.crc32(str(d.doc_id).encode()) % 7 != 2 for d in docs]
    wanted = {d.doc_id: (t, w) for d, t, w in zip(docs, train, brute([d.text for d in docs], train))}
    assert len(rows) == len(docs)
    better, errors = defaultdict(list), []
    for r in rows:
        learn, (n_tokens, n_known, n, base, score) = wanted[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (not learn, n_tokens, n_known, n)
        assert r.base_score == pytest.approx(base, rel=1e-9)
        # The filter may overstate counts, never understate them.
        errors.append((r.score - score) / score)
        better[r.held_out].append(r.score > r.base_score)
    assert max(map(abs, errors)) < 0.25 and abs(sum(errors)) / len(errors) < 0.02
    assert sum(better[True]) > 0.7 * len(better[True]) and all(better[False])


def test_a_round_sorts_its_own_slices_alone():
    bits = 8
    hashes = np.arange(256, dtype=np.uint64) << np.uint64(56)
    asked = bloom_lm.held_here(hashes, [(10, 12, None), (13, 20, None)], bits)
    assert np.flatnonzero(asked).tolist() == list(range(10, 21))


def test_word_hashes_weigh_bytes_by_their_place():
    slab = words._SLAB
    texts = ["a word", "b" * (slab - 1) + " c", "d" * (slab + 7) + " e", "", "\u00fc " * 9, "f" * (slab // 2) + " " + "g" * slab]
    odd, byte = int(words._ODD[0]), words._BYTE.tolist()
    want = []
    for word in (w for t in texts for w in t.encode().split()):
        total, weight = 0, 1
        for b in word:
            total, weight = (total + byte[b] * weight) % 2**64, weight * odd % 2**64
        want.append(total)
    found = words.words(pa.array(texts))
    assert np.array_equal(found.hash, words.mixed(np.array(want, np.uint64)))
