"""Spelling variants against all pairs of words."""

import random
import re
import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

from edge import edge_documents, no_documents  # noqa: E402

from leafmill.llm import spelling  # noqa: E402
from leafmill.llm.queries import QUERIES  # noqa: E402

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def vocabulary(rows, letters=5, least=3, damage=97):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if damage and h % damage == 0:
                cut = h % len(run)
                run = run[:cut] + run[cut + 1 :]
            n[run] += len(run) >= letters
    return {w: k for w, k in n.items() if k >= least}


def is_near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(known):
    near = {w: [] for w in known}
    by_cut = {}
    for w in known:  # words that share a form with one letter left out: all candidates, then checked
        for cut in {w} | {w[:i] + w[i + 1 :] for i in range(len(w))}:
            by_cut.setdefault(cut, []).append(w)
    for group in by_cut.values():
        for a in group:
            near[a] += [b for b in group if is_near(a, b)]
    out, forms = {}, {}
    for w, n in known.items():
        own = sorted(set(near[w]), key=lambda x: (-known[x], x))
        forms[w] = own[0] if own and known[own[0]] >= 2 * n else None
        out[w] = [forms[w], w, n, len(own), known.get(forms[w])]
    for w in out:
        while forms[out[w][1]]:
            out[w][1] = forms[out[w][1]]
    return sorted((w, *row) for w, row in out.items())


def rows_of(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def typed(seed=5):
    chance = random.Random(seed)
    base = ["".join(chance.choice("abcdeéÿß") for _ in range(chance.randint(4, 8))) for _ in range(60)] + ["ab" * 60, "abcdeabcde" * 9]
    rows = []
    for i in range(200):
        words = []
        for _ in range(chance.randint(0, 40)):
            w = list(chance.choice(base[: chance.choice([5, 20, 62])]))
            if chance.random() < 0.3:
                at = chance.randrange(len(w))
                w[at : at + chance.randint(0, 1)] = [chance.choice(["", "a", "e", "é"])]
            words.append("".join(w).upper() if chance.random() < 0.1 else "".join(w))
        rows.append((chance.choice([i, None]), chance.choice([" ", ", ", "1", "Ā", "¿", "漢"]).join(words)))
    return [*rows, (None, None), (7, ""), (8, "x" * 30000), *[rows[3]] * 3]


@pytest.mark.parametrize("settings", [{}, {"LEAF": 8, "BOTTOM": 2}, {"LEAF": 1, "SAMPLE": 100}])
@pytest.mark.parametrize("damage", [97, 3])
def test_matches_all_pairs(spark, monkeypatch, settings, damage):
    for name, value in settings.items():
        monkeypatch.setattr(spelling, name, value)
    rows = typed()
    docs = spark.createDataFrame([(i, t, "w", "r", 1) for i, t in rows], "doc_id bigint, text string, word string, root string, n int")
    assert rows_of(spelling.variants(docs, damage=damage)) == brute(vocabulary(rows, damage=damage))


def test_equal_letter_counts_are_dealt_by_hash(spark):
    chance = random.Random(2)
    words = sorted({"".join(chance.sample("aaabbbccc", 9)) for _ in range(400)} | {"".join(chance.sample("aaabbbccd", 9)) for _ in range(100)})
    known = {w: 3 + i % 7 for i, w in enumerate(words)}
    tree = spelling.Tree(np.full(len(words), 9), spelling.letter_counts(*spelling.codes_of(pa.array(words))), 1.0, 20)
    assert max(tree.parts) > 1
    found = spelling.near_pairs(spark.createDataFrame(list(known.items()), "word string, n bigint"))
    pairs = sorted((r.word, r.near, r.near_n) for r in found.collect())
    assert pairs == sorted((a, b, known[b]) for a in words for b in words if a != b and is_near(a, b))


def test_parts_meet_all_searches(spark, monkeypatch):
    monkeypatch.setattr(spelling, "LEAF", 10)
    chance = random.Random(4)
    words = sorted({"".join(chance.sample("aaaabbbb", 8)) for _ in range(400)} | {"".join(chance.sample("aaabbbb", 7)) for _ in range(400)} | {"".join(chance.sample("aaaabbbc", 8)) for _ in range(100)})
    found = spelling.near_pairs(spark.createDataFrame([(w, 5) for w in words], "word string, n bigint"))
    assert sorted((r.word, r.near) for r in found.collect()) == sorted((a, b) for a in words for b in words if a != b and is_near(a, b))


def test_crc_of_pieces():
    data = np.frombuffer("naïve straße ".encode() * 3 + b"z" * 300, np.uint8)
    start, end = np.array([0, 3, 7, 5, 20]), np.array([6, 3, 14, 300, 90])
    seed = np.array([zlib.crc32(str(i).encode()) for i in range(5)], np.uint32)
    assert spelling.crcs(data, start, end, seed).tolist() == [zlib.crc32(str(i).encode() + data[a:b].tobytes()) for i, (a, b) in enumerate(zip(start, end))]


def test_odd_tables(spark):
    docs = edge_documents(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert rows_of(spelling.variants(docs)) == brute(vocabulary(rows))
    assert rows_of(spelling.variants(no_documents(spark))) == []


def test_query(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    assert rows_of(QUERIES["op13_spelling_variants"](spark, folder)) == brute(vocabulary([(d.doc_id, d.text) for d in docs]))
