"""Document operators against brute force, on tables with every odd case and on empty ones."""

import hashlib
import random
import sys
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

from edge import edge_documents, edge_texts, no_documents, sentence, words_of  # noqa: E402

from leafmill.llm import decontaminate, minhash, mixing, packing, substrings, token_counts, toxicity  # noqa: E402
from leafmill.llm.components import roots  # noqa: E402
from leafmill.shared import shared_folder  # noqa: E402


def order(id_):
    return -(2**63) if id_ is None else id_


# --- 1: mixing

def test_mixing_keeps_targets_and_budget(spark):
    chance = random.Random(5)
    docs = edge_documents(spark, [(i, sentence(chance, chance.randint(0, 30))) for i in range(280)])
    tokens = {r.doc_id: (r.source, len(words_of(r.text))) for r in docs.collect()}
    total = Counter()
    for s, n in tokens.values():
        total[s] += n
    rows = mixing.mixed(docs, entropy_share=1.0, repeats=2.0).collect()
    used, uses = Counter(), Counter(r.doc_id for r in rows)
    for r in rows:
        assert tokens[r.doc_id] == (r.source, r.n_tokens)
        used[r.source] += r.n_tokens
    assert set(uses) == set(tokens) and max(uses.values()) == 2
    weight = {r.source: r.weight for r in rows}
    assert set(weight) == {"a", "b", None, ""} and abs(sum(weight.values()) - 1) < 1e-5
    share = {s: n / sum(used.values()) for s, n in used.items()}
    assert all(abs(share[s] - weight[s]) < 0.02 for s in weight)
    rate = {s: used[s] / total[s] for s in total}
    assert max(rate.values()) <= 2.0 * min(rate.values()) * 1.02
    # Passes are whole but for the last, and places in a pass follow each other.
    by_pass = defaultdict(list)
    for r in rows:
        by_pass[(r.source, r["pass"])].append((r.token_start, r.n_tokens))
    for steps in by_pass.values():
        at = 0
        for start, n in sorted(steps):
            assert start == at
            at += n


@pytest.mark.parametrize("budget", [1, 40, 900])
def test_mixing_stays_in_a_given_budget(spark, budget):
    rows = mixing.mixed(edge_documents(spark), budget=budget, repeats=100.0).collect()
    assert sum(r.n_tokens for r in rows) <= budget


def test_mixing_bisects_the_entropy(spark):
    import math

    sources = spark.createDataFrame([(float(s), int(s * 1000)) for s in (0.7, 0.2, 0.1)], "share double, tokens bigint")
    a = mixing.exponent(sources, 0.9, 100.0, None)
    p = np.array([0.7, 0.2, 0.1]) ** a
    p /= p.sum()
    assert abs(-(p * np.log(p)).sum() - 0.9 * math.log(3)) < 1e-6


@pytest.mark.parametrize("repeats", [1.5, 2.0])
def test_mixing_keeps_the_limit_for_a_tiny_source(spark, repeats):
    rows = [(100 * s + i, f"big{s}", (1 + s % 3) * 10**8) for s in range(22) for i in range(2)] + [(10**6 + i, "tiny", 40) for i in range(11)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, n bigint").withColumn("text", F.lit(""))
    found = mixing.mixed(docs, repeats=repeats, tokens=F.col("n")).collect()
    assert {r.doc_id for r in found} == {r[0] for r in rows}
    used = sum(r.n_tokens for r in found if r.source == "tiny")
    assert 440 <= used <= repeats * 440
    weight = {r.source: r.weight for r in found}
    assert 0 < weight["tiny"] < 1e-6 and abs(sum(weight.values()) - 1) < 2e-5


def test_mixing_of_nothing(spark):
    assert mixing.mixed(no_documents(spark)).count() == 0
    assert mixing.mixed(edge_documents(spark, [(1, None), (2, "")])).count() == 0
    assert mixing.remixed(no_documents(spark)).count() == 0


def test_remixed_keeps_columns_and_every_document(spark):
    docs = edge_documents(spark)
    rows = mixing.remixed(docs)
    assert rows.columns == docs.columns
    kept = {r.doc_id for r in rows.collect()}
    assert {i for i, t in edge_texts() if words_of(t)} <= kept


# --- 2: token counts

def test_token_counts_are_the_librarys(spark):
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(token_counts.MODEL))
    docs = edge_documents(spark)
    cache = shared_folder(spark, "test-cache")
    for _ in range(2):
        rows = token_counts.token_counts(docs, cache, limit=100).collect()
        want = Counter((i, len((t or "").encode()), len(model.encode(t or "")), len(model.encode(t or "")) > 100) for i, t in edge_texts())
        assert Counter(map(tuple, rows)) == want
    # The second time nothing was missing.
    assert spark.read.parquet(cache).count() == len({t or "" for _, t in edge_texts()})
    assert token_counts.token_counts(no_documents(spark), shared_folder(spark, "test-cache")).count() == 0


# --- 4: packing

def test_packing_loses_nothing(spark):
    docs = edge_documents(spark)
    encoding = packing.encoder(public_tokenizers.path(packing.RANKS))
    rows = packing.packed(docs, width=64).collect()
    parts = defaultdict(Counter)
    for r in rows:
        ids, places = np.frombuffer(r.input_ids, "<u2"), np.frombuffer(r.position_ids, "<u2")
        assert len(ids) == len(places) == 64 and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens and len(r.doc_ids) == r.n_segments
        assert (ids[r.n_tokens:] == packing.FILL).all()
        for d, p, a, b in zip(r.doc_ids, r.parts, r.cu_seqlens, r.cu_seqlens[1:]):
            assert (places[a:b] == np.arange(b - a)).all()
            parts[d][(p, tuple(ids[a:b].tolist()))] += 1
    want = defaultdict(Counter)
    for i, t in edge_texts():
        ids = encoding.encode(t or "", disallowed_special=())
        want[i].update((k, tuple(ids[k * 64 : k * 64 + 64])) for k in range(-(-len(ids) // 64)))
    assert {k: v for k, v in want.items() if v} == dict(parts)
    assert packing.packed(no_documents(spark)).count() == 0


def test_best_fit_decreasing_takes_the_tightest_row():
    chance = random.Random(8)
    for width in (1, 7, 64):
        lengths = [chance.randint(1, width) for _ in range(200)]
        rows: list[list[int]] = []
        for i in sorted(range(200), key=lambda i: -lengths[i]):
            room = [(width - sum(lengths[j] for j in r), k) for k, r in enumerate(rows)]
            fit = min((x for x in room if x[0] >= lengths[i]), default=None, key=lambda x: x[0])
            if fit is None:
                rows.append([i])
            else:
                rows[fit[1]].append(i)
        packed = packing.best_fit_decreasing(lengths, width)
        assert sorted(i for r in packed for i in r) == list(range(200)) and all(sum(lengths[i] for i in r) <= width for r in packed)
        fill = lambda rows: sorted(sum(lengths[i] for i in r) for r in rows)
        assert fill(packed) == fill(rows)


# --- 5: near-duplicates

def brute_groups(texts, size, share):
    def shingles(text):
        words = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()).split()
        return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if len(words) >= size else {tuple(words)} if words else set()

    sets = [shingles(t) for _, t in texts]
    group = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and both * share[1] >= len(sets[i] | sets[j]) * share[0]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    least = {g: min(order(texts[k][0]) for k in range(len(texts)) if group[k] == g) for g in group}
    real = lambda i: None if i == -(2**63) else i
    return Counter((i, len(s), real(least[g]), i is None or i == least[g]) for (i, _), s, g in zip(texts, sets, group))


@pytest.mark.parametrize(("size", "share"), [(3, (85, 100)), (5, (80, 100))])
def test_groups_are_those_of_all_pairs(spark, size, share):
    chance = random.Random(9)
    family = sentence(chance, 150).split()
    texts = edge_texts()
    for i in range(60):
        own = list(family)
        for _ in range(chance.randint(0, 12)):
            own[chance.randrange(len(own))] = f"e{i}x{chance.randint(0, 99)}"
        texts.append((100 + i, " ".join(own)))
    chain = list(family)
    for i in range(25):
        chain[6 * i] = f"c{i}"
        texts.append((300 - i, " ".join(chain)))
    rows = minhash.groups(edge_documents(spark, texts), size, share).collect()
    assert Counter(map(tuple, rows)) == brute_groups(texts, size, share)


def test_groups_of_nothing(spark):
    assert minhash.groups(no_documents(spark)).count() == 0
    assert minhash.first_of_each_group(no_documents(spark)).count() == 0


def test_first_of_each_group_keeps_columns(spark):
    docs = edge_documents(spark)
    kept = minhash.first_of_each_group(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} >= {None, 4, 5, 7, 9, 10} and kept.filter("doc_id in (1, 2)").count() == 0


def test_match_threshold_bounds_the_misses():
    import math

    t = minhash.match_threshold(64, 0.85)
    assert sum(math.comb(64, k) * 0.85**k * 0.15 ** (64 - k) for k in range(t)) < 1e-8 and 30 < t < 50


def test_components_of_chains_and_stars(spark):
    chance = random.Random(3)
    names = list(range(400))
    chance.shuffle(names)
    links = [(names[i], names[i + 1]) for i in range(150)] + [(names[200], names[i]) for i in range(200, 300)] + [(5, None), (None, None)]
    got = dict(map(tuple, roots(spark.createDataFrame(links, "a int, b int")).collect()))
    assert {got[names[i]] for i in range(151)} == {min(names[:151])} and {got[names[i]] for i in range(200, 300)} == {min(names[200:300])} and len(got) == 251
    assert roots(spark.createDataFrame([], "a int, b int")).count() == 0


# --- 6: repeated passages

def brute_removals(texts, window):
    known: dict[int, set] = {}
    firsts: dict[tuple, tuple] = {}
    rows = [(order(i), words_of(t)) for i, t in texts]
    for i, w in rows:
        for p in range(len(w) - window + 1):
            key = tuple(w[p : p + window])
            firsts[key] = min(firsts.get(key, (i, p)), (i, p))
    out = Counter()
    for (i, w), (id_, _) in zip(rows, texts):
        gone = set()
        for p in range(len(w) - window + 1):
            if firsts[tuple(w[p : p + window])] < (i, p):
                gone.update(range(p, p + window))
        left = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out[(id_, len(w), len(gone), hashlib.sha256(left).hexdigest())] += 1
    return out


@pytest.mark.parametrize("window", [20, 6])
def test_removals_are_those_of_all_windows(spark, window):
    chance = random.Random(6)
    passage, texts = sentence(chance, 60), edge_texts()
    for i in range(40):
        cut = sorted(chance.sample(range(60), 2))
        texts.append((200 - i, f"{sentence(chance, chance.randint(0, 30))} {' '.join(passage.split()[cut[0]:cut[1]])} {sentence(chance, 5)} {passage if i % 3 == 0 else ''}"))
    rows = substrings.removals(edge_documents(spark, texts), window).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in rows) == brute_removals(texts, window)
    words = defaultdict(list)
    for i, t in texts:
        words[order(i)].append(words_of(t))
    stretch = lambda i, at, n: [w[at : at + n] for w in words[i] if len(w) >= at + n]
    for r in rows:
        # Each factor reads as its source does.
        for f in r.factors:
            assert stretch(order(r.doc_id), f.start, f.n_words)[0] in stretch(f.ref_id, f.ref_start, f.n_words)
            assert (f.ref_id, f.ref_start) < (order(r.doc_id), f.start)


def test_texts_of_one_id_are_told_apart(spark):
    chance = random.Random(2)
    a, b = sentence(chance, 40), sentence(chance, 40)
    texts = [(1, a), (1, b), (2, a + " " + b), (3, b)]
    rows = substrings.removals(edge_documents(spark, texts)).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in rows) == brute_removals(texts, 20)


def test_strip_removes_the_words(spark):
    texts = [(i, t) for i, t in {order(i): (i, t) for i, t in edge_texts()}.values()]
    docs = edge_documents(spark, texts)
    want = {r.doc_id: r.kept_sha256 for r in substrings.removals(docs).collect()}
    stripped = substrings.strip(docs)
    assert stripped.columns == docs.columns
    for r in stripped.collect():
        assert hashlib.sha256(b" ".join(words_of(r.text))).hexdigest() == want[r.doc_id]
    assert substrings.removals(no_documents(spark)).count() == 0


# --- 8: toxicity

LABEL = "doc_id bigint, quality int, toxic int"


def test_toxicity_learns_and_never_looks_at_held_out_labels(spark):
    from zlib import crc32

    chance = random.Random(12)
    plain = [f"w{chance.randint(0, 900)}" for _ in range(3000)]

    def text(bad):
        words = [chance.choice(plain) for _ in range(chance.randint(10, 120))]
        for _ in range(chance.randint(2, 4) if bad else 0):
            words[chance.randrange(len(words))] = "vilest" + chance.choice(["", "er", "ing", "ed", str(chance.randint(0, 99))])
        return " ".join(words)

    truth = {i: int(chance.random() < 0.2) for i in range(1500)}
    docs = edge_documents(spark, [(i, text(bad)) for i, bad in truth.items()] + [(5000, None), (5001, ""), (None, "vilest vilester"), (7, None)])
    labels = spark.createDataFrame([(i, 1, bad) for i, bad in truth.items()] + [(5000, 1, None), (None, 1, 1)], LABEL)
    rows = toxicity.scores(docs, labels).collect()
    assert len(rows) == 1504 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert all(r.held_out == (r.doc_id is not None and crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    assert {r.score for r in rows if r.doc_id in (5000, 5001)} != {None}
    wrong = spark.createDataFrame([(i, 1, 1 - bad if crc32(str(i).encode()) % 5 == 0 else bad) for i, bad in truth.items()], LABEL)
    again = {(r.doc_id, r.score) for r in toxicity.scores(docs, wrong).collect()}
    assert again == {(r.doc_id, r.score) for r in rows}


def test_toxicity_without_labels(spark):
    rows = toxicity.scores(edge_documents(spark), spark.createDataFrame([], LABEL)).collect()
    assert len(rows) == len(edge_texts()) and {r.score for r in rows} == {0.5}
    assert toxicity.scores(no_documents(spark), spark.createDataFrame([], LABEL)).count() == 0
    one = spark.createDataFrame([(1, 1, 1), (1, 1, 0), (2, 1, 0)], LABEL)
    assert toxicity.scores(edge_documents(spark), one).count() == len(edge_texts())


def test_toxicity_counts_every_word_of_a_stem(spark):
    from math import log

    texts = [(i, " ".join(f"Stems{j}" for j in range(40 * (i % 2) + 3)) + " other" * i) for i in range(1, 9)]
    rows = spark.createDataFrame([(i, t, i % 2, 4 if i > 6 else 1) for i, t in texts], "_id bigint, _text string, _toxic int, _fold int")
    counts = toxicity.word_counts(rows)
    n = [Counter(w for i, t in texts if i % 2 == c for w in t.lower().split()) for c in range(2)]
    assert counts.count() == len(n[0] | n[1])
    known, stems = toxicity.log_ratios(counts)
    kinds = [Counter(w[:5] for w in own) for own in n]
    either = Counter(w[:5] for w in n[0] | n[1])

    def order(count):
        once, twice = (sum(x == k for x in count.values()) for k in (1, 2))
        d = (once + 0.5) / (once + 2 * twice + 1)
        return d, d * len(count) / sum(count.values()), sum(count.values())

    high, low = [order(x) for x in n], [order(x) for x in kinds]
    left, lower_left = max(x[1] for x in high), max(x[1] for x in low)

    def stem_p(s, c):
        return max(kinds[c][s] - low[c][0], 0) / low[c][2] + lower_left * (either[s] + 0.5) / (either.total() + 0.5 * (len(either) + 1))

    def p(w, c):
        return max(n[c][w] - high[c][0], 0) / high[c][2] + left * stem_p(w[:5], c) / either[w[:5]]

    wanted = sorted(round(log(p(w, 1) / p(w, 0)) * toxicity.UNIT) for w in n[0] | n[1])
    assert np.allclose(sorted(r.full for r in known.collect()), wanted, atol=1)
    assert sorted(r.n for r in stems.collect()) == [1, 43]
    assert np.allclose(sorted(r.full for r in stems.collect()), sorted(round(log(stem_p(s, 1) / stem_p(s, 0)) * toxicity.UNIT) for s in either), atol=1)


def test_toxicity_joins_what_is_not_broadcast(spark, monkeypatch):
    chance = random.Random(4)
    docs = edge_documents(spark, [(i, sentence(chance, 20) + (f" foul{i % 7}" if i % 3 == 0 else "") + f" rare{i}") for i in range(200)] + [(None, "unseen"), (500, None)])
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(150)], LABEL)
    whole = sorted(toxicity.scores(docs, labels).collect(), key=str)
    for most in (0, 3, 40):
        monkeypatch.setattr(toxicity, "HEAD", most)
        assert sorted(toxicity.scores(docs, labels).collect(), key=str) == whole


# --- 9: benchmark passages

ITEM = "item_id bigint, text string, start int, edits int"


def brute_edits(passage, text):
    """Fewest edits from the passage to any stretch of the text."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(passage, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j - 1] + (p != t), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_passages_are_those_within_the_edits(spark):
    chance = random.Random(7)
    items = [(i, sentence(chance, chance.randint(8, 40))) for i in range(12)] + [(90, None), (91, ""), (92, "too short"), (3, "twice " + sentence(chance, 9))]
    docs: list[tuple[int | None, str | None]] = [(4, None), (5, ""), (None, "x " + items[0][1])]
    for d in range(60):
        passage = list(items[d % 12][1])
        for _ in range(chance.randint(0, len(passage) // 8)):
            at = chance.randrange(len(passage))
            passage[at : at + chance.randint(0, 1)] = chance.choice(["", "q", "zz"])
        docs.append((10 + d, f"{sentence(chance, 20)} {''.join(passage).upper() if d % 5 == 0 else ''.join(passage)} {sentence(chance, 20)}"))
    rows = decontaminate.passages(edge_documents(spark, docs), spark.createDataFrame([(*i, 1, 2) for i in items], ITEM)).collect()
    import pyarrow as pa

    def plain(text):
        data, bounds, _ = decontaminate.compared(pa.array([text]))
        return data.tobytes()

    index = decontaminate.index_of([i for i, _ in items], [t for _, t in items])
    want = set()
    for d, t in docs:
        for item, passage, edits in zip(index.ids, index.passages, index.edits):
            best = brute_edits(passage, plain(t or ""))
            if best <= edits:
                want.add((d, item, best))
    assert {(r.doc_id, r.item_id, r.edits) for r in rows} == want
    text = dict(docs)
    for r in rows:
        found = plain(text[r.doc_id].lower()[r.start : r.start + r.length])
        # A space at either end of the stretch is lost in the cut.
        assert min(brute_edits(p, found) for i, p in zip(index.ids, index.passages) if i == r.item_id) <= r.edits + 2


def test_passages_of_nothing(spark):
    items = spark.createDataFrame([(1, "a passage that is long enough to be looked for", 1, 2)], ITEM)
    assert decontaminate.passages(no_documents(spark), items).count() == 0
    assert decontaminate.passages(edge_documents(spark), spark.createDataFrame([], ITEM)).count() == 0
    docs = edge_documents(spark, [(1, "Here: A passage, that is long enough to be looked for!"), (2, "clean")])
    assert [r.doc_id for r in decontaminate.without_passages(docs, items).collect()] == [2]


def test_a_benchmark_larger_than_a_block(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 64)
    chance = random.Random(1)
    items = [(i, sentence(chance, 20)) for i in range(6)]
    docs = edge_documents(spark, [(i, t) for i, t in items])
    rows = decontaminate.passages(docs, spark.createDataFrame([(*i, 1, 2) for i in items], ITEM)).collect()
    assert {(r.doc_id, r.item_id) for r in rows} >= {(i, i) for i in range(6)}
