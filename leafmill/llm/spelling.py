"""Spelling variants: words one edit apart, found by k-d trees over their letter counts.

Words are the maximal runs of letters (A-Z, a-z, U+00C0 to U+00FF) with A-Z lower-cased, at least ``LETTERS`` code points long and
with ``LEAST`` occurrences in all. As a stand-in for typing errors, a run whose crc32 of ``<id>:<run>`` is divisible by
``DAMAGE`` loses its code point ``crc % length`` first; 0 switches that off.

One replaced letter changes letter counts by an L1 distance of 2 at most, one more letter by exactly 1. So each word
searches the words of its own length within 2, and those of one letter less within 1. For every length a k-d tree cuts the
letter-count space into boxes of about ``LEAF`` words; it is fitted on a sample of ``SAMPLE`` words at most (by hash), has 2^16
boxes at most, is broadcast, and every word is put into its box. A word is sent to each box that its search reaches,
so a task holds one box with the words that search it, and goes down a tree of its own with exact bounding boxes. What
is left is verified letter by letter. Words whose counts are all equal cannot be cut by counts: a box that stays too
large is dealt by hash into parts, and so are its searches, each pair of parts being a task.

A word's form is its near word with most occurrences (ties: the smallest) if it has at least ``RATIO`` times its own; its root
is the end of the chain of forms, found by doubling steps.

Counts of letters beyond z are kept in six of 32 dimensions and at most 255, which only lowers distances: nothing is missed.
Words are counted by their text; within a slice of text by a 64-bit hash.

Defined results: null text has no words; a null id is an empty string before the colon; repeated rows count each; words are
compared by code points; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.words import LOWER, slices, text_bytes, words
from leafmill.shared import settle

LETTERS = 5
LEAST = 3
DAMAGE = 97
RATIO = 2
LEAF = 4096
SAMPLE = 1 << 17
BOXES = 1 << 14
DIMENSIONS = 32
BOTTOM = 24
#: Words that a task sends to their boxes.
ROUTED = 20_000
#: Longer runs get their crc one by one.
_LONG = 64

_ASCII = np.zeros(256, bool)
_ASCII[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True


def _crc_table() -> np.ndarray:
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, np.uint32(0xEDB88320) ^ (out >> np.uint32(1)), out >> np.uint32(1))
    return out


_CRC = _crc_table()


def crcs(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """crc32 of each piece of ``data``, continued from ``seed``."""
    size = end - start
    order = np.argsort(-np.minimum(size, _LONG), kind="stable")
    state, at = ~seed[order].astype(np.uint32), start[order]
    left = np.searchsorted(-np.minimum(size[order], _LONG), -np.arange(1, _LONG + 1), "right")
    for j, n in enumerate(left):
        state[:n] = _CRC[(state[:n] ^ data[at[:n] + j]) & np.uint32(0xFF)] ^ (state[:n] >> np.uint32(8))
    out = np.empty(len(size), np.uint32)
    out[order] = ~state
    for i in np.flatnonzero(size > _LONG):
        out[i] = zlib.crc32(data[start[i] : end[i]].tobytes(), int(seed[i]))
    return out


def letter_runs(column: pa.Array) -> pa.Array:
    """The texts with a blank for every byte outside a run of letters, and A-Z lower-cased."""
    data, offsets = text_bytes(column)
    # The letters U+00C0 to U+00FF are C3 and one byte more in UTF-8, and nothing else starts with C3.
    lead = data == 0xC3
    letter = _ASCII[data] | lead
    letter[1:] |= lead[:-1]
    data = np.where(letter, LOWER[data], np.uint8(0x20))
    return pa.Array.from_buffers(pa.large_string(), len(column), [None, pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(data.tobytes())])


def gathered(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The pieces of ``data`` as a string column."""
    size = end - start
    ends = np.cumsum(size)
    at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(start - ends + size, size)
    offsets = np.concatenate(([0], ends)).astype(np.int64)
    return pa.Array.from_buffers(pa.large_string(), len(size), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data[at].tobytes())]).cast(pa.string())


def vocabulary(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", letters: int = LETTERS, least: int = LEAST, damage: int = DAMAGE) -> DataFrame:
    """``word, n`` of the words of whole texts."""
    texts = docs.select(F.concat(F.coalesce(F.col(id_column).cast("string"), F.lit("")), F.lit(":")).alias("_before"), F.coalesce(F.col(text_column), F.lit("")).alias("_text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to in slices(batch["_text"]):
                found = words(letter_runs(batch["_text"].slice(at, to - at)))
                points = np.concatenate(([0], np.cumsum(found.data != 0xC3)))
                size = points[found.end] - points[found.start]
                keep = np.flatnonzero(size >= letters)
                damaged = np.empty(0, np.int64)
                if damage and len(keep):
                    before = np.array([zlib.crc32(x.encode()) for x in batch["_before"].slice(at, to - at).to_pylist()], np.uint32)
                    seed = np.repeat(before, np.diff(found.first))[keep]
                    crc = crcs(found.data, found.start[keep], found.end[keep], seed)
                    hit = crc % np.uint32(damage) == 0
                    damaged, crc, keep = keep[hit], crc[hit], keep[~hit]
                changed: Counter[str] = Counter()
                for i, h in zip(damaged, crc if len(damaged) else ()):
                    word = found.data[found.start[i] : found.end[i]].tobytes().decode()
                    cut = int(h) % len(word)
                    if len(word) > letters:
                        changed[word[:cut] + word[cut + 1 :]] += 1
                _, place, times = np.unique(found.hash[keep], return_index=True, return_counts=True)
                place = keep[place]
                yield pa.record_batch([gathered(found.data, found.start[place], found.end[place]), pa.array(times.astype(np.int64))], ["word", "n"])
                if changed:
                    yield pa.record_batch([pa.array(list(changed)), pa.array(list(changed.values()), pa.int64())], ["word", "n"])

    found = texts.mapInArrow(scan, "word string, n bigint")
    return found.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def codes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """One byte for each code point of the words, and the end of each word."""
    joined = "".join(column.to_pylist()).encode("latin-1")
    return np.frombuffer(joined, np.uint8), np.cumsum(pc.utf8_length(column).to_numpy().astype(np.int64))


def letter_counts(codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    dimension = np.where(codes >= 0xC0, 26 + codes % 6, codes.astype(np.int64) - 0x61)
    word = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    return np.minimum(np.bincount(word * DIMENSIONS + dimension, minlength=len(ends) * DIMENSIONS), 255).reshape(-1, DIMENSIONS).astype(np.uint8)


def best_cut(vectors: np.ndarray, least: float = 0.0) -> tuple[int, int] | None:
    """The letter and count whose cut (up to that count or over it) is most even; None where the smaller side never has more than a share of ``least``."""
    best, found = least, None
    for t in range(int(vectors.max(initial=0))):
        share = (vectors <= t).mean(0)
        even = np.minimum(share, 1 - share)
        d = int(even.argmax())
        if even[d] > best:
            best, found = float(even[d]), (d, t)
        if found and best >= 0.4 or t > 8 and found:
            break
    return found


class Tree:
    """Cuts of the letter-count space for each length; a box has the consecutive part pairs ``base`` to ``base + parts ** 2``."""

    def __init__(self, sizes: np.ndarray, vectors: np.ndarray, share: float, leaf: int):
        self.root: dict[int, int] = {}
        self.letter, self.most, self.low, self.high, self.base, self.parts = [], [], [], [], [], []
        self.tasks = 1
        self._node(np.empty((0, DIMENSIONS), np.uint8), share, leaf)  # of lengths that the sample lacks
        for length in np.unique(sizes).tolist():
            self.root[length] = self._node(vectors[sizes == length], share, leaf)

    def _node(self, vectors: np.ndarray, share: float, leaf: int) -> int:
        own = len(self.letter)
        for column in (self.letter, self.most, self.low, self.high, self.base, self.parts):
            column.append(-1)
        cut = best_cut(vectors, 0.02) if len(vectors) > leaf * share else None
        if cut is None:
            self.parts[own] = max(1, round(len(vectors) / share / (4 * leaf)))
            self.base[own] = self.tasks
            self.tasks += self.parts[own] ** 2
            return own
        left = vectors[:, cut[0]] <= cut[1]
        self.letter[own], self.most[own] = cut
        self.low[own] = self._node(vectors[left], share, leaf)
        self.high[own] = self._node(vectors[~left], share, leaf)
        return own

    def boxes(self, length: int, vectors: np.ndarray, reach: int) -> Iterator[tuple[int, np.ndarray]]:
        """The boxes of words of a length, each with the vectors (their numbers) that have it within ``reach``."""
        start = self.root.get(length, 0)
        stack = [(start, np.arange(len(vectors)), np.zeros(len(vectors), np.int64), {})]
        while stack:
            node, own, distance, limits = stack.pop()
            if not len(own):
                continue
            d = self.letter[node]
            if d < 0:
                yield node, own
                continue
            value, (low, high) = vectors[own, d].astype(np.int64), limits.get(d, (0, 255))
            before = np.maximum(low - value, 0) + np.maximum(value - high, 0)
            for child, bound in ((self.low[node], (low, min(high, self.most[node]))), (self.high[node], (max(low, self.most[node] + 1), high))):
                to = distance - before + np.maximum(bound[0] - value, 0) + np.maximum(value - bound[1], 0)
                near = to <= reach
                stack.append((child, own[near], to[near], {**limits, d: bound}))


def close(residents: np.ndarray, searches: np.ndarray, reach: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (number of a search, number of a resident) whose vectors are within ``reach``, by box pruning."""
    stack = [(np.arange(len(residents)), np.arange(len(searches)))]
    while stack:
        own, asked = stack.pop()
        if not len(own) or not len(asked):
            continue
        box, point = residents[own], searches[asked]
        low, high = box.min(0), box.max(0)
        far = (np.maximum(low, point) - point).sum(1, dtype=np.int32) + (point - np.minimum(high, point)).sum(1, dtype=np.int32)
        asked = asked[far <= reach]
        cut = best_cut(box) if len(own) > BOTTOM else None
        if cut is not None:
            left = box[:, cut[0]] <= cut[1]
            stack += [(own[left], asked), (own[~left], asked)]
            continue
        step = max(1, (1 << 17) // len(own))
        for at in range(0, len(asked), step):
            point = searches[asked[at : at + step], None, :]
            distance = (np.maximum(point, box) - np.minimum(point, box)).sum(2, dtype=np.int32)
            i, j = np.nonzero(distance <= reach)
            yield asked[at + i], own[j]


def one_replaced(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a != b).sum(1) == 1


def one_more(longer: np.ndarray, shorter: np.ndarray) -> np.ndarray:
    """Which words of ``longer`` are those of ``shorter`` with one letter put in."""
    head = np.logical_and.accumulate(longer[:, :-1] == shorter, axis=1).sum(1)
    tail = np.logical_and.accumulate((longer[:, 1:] == shorter)[:, ::-1], axis=1).sum(1)
    return head + tail >= shorter.shape[1]


def near_pairs(known: DataFrame) -> DataFrame:
    """``word, near, near_n`` for each pair of words of ``known`` (``word, n``) that are one edit apart, in both directions."""
    spark = known.sparkSession
    total = known.count()
    sample = known.filter(F.pmod(F.xxhash64("word"), F.lit(1 << 20)) < int((1 << 20) * min(1.0, SAMPLE / max(total, 1)))).select("word").toArrow()["word"].combine_chunks()
    codes, ends = codes_of(sample)
    tree = spark.sparkContext.broadcast(Tree(np.diff(ends, prepend=0), letter_counts(codes, ends), max(len(sample) / max(total, 1), 1e-12), max(LEAF, total // BOXES)))
    home, same, longer = range(3)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Tree = tree.value
        for batch in batches:
            codes, ends = codes_of(batch["word"])
            size = np.diff(ends, prepend=0)
            vectors = letter_counts(codes, ends)
            for length in np.unique(size).tolist():
                own = np.flatnonzero(size == length)
                for kind, of, reach in ((home, length, 0), (same, length, 2), (longer, length - 1, 1)):
                    for node, at in index.boxes(of, vectors[own], reach):
                        at, parts = own[at], index.parts[node]
                        rows = batch.take(pa.array(at))
                        part = np.array([zlib.crc32(w.encode()) % parts for w in rows["word"].to_pylist()]) if parts > 1 else np.zeros(len(at), np.int64)
                        for other in range(parts):
                            task = index.base[node] + (part * parts + other if kind == home else other * parts + part)
                            yield pa.record_batch([pa.array(np.full(len(at), of, np.int32)), pa.array(task.astype(np.int32)), pa.array(np.full(len(at), kind, np.int32)), rows["word"], rows["n"]], ["size", "task", "kind", "word", "n"])

    def search(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        kind, length = table["kind"].to_numpy(), table["size"][0].as_py()
        numbers, out = table["n"].to_numpy(), ([], [], [])
        matrices, counts, places = {}, {}, {}
        for k, size in ((home, length), (same, length), (longer, length + 1)):
            places[k] = np.flatnonzero(kind == k)
            column = table["word"].take(pa.array(places[k])).combine_chunks()
            codes, ends = codes_of(column)
            matrices[k], counts[k] = codes.reshape(-1, size), letter_counts(codes, ends)
        for k, reach in ((same, 2), (longer, 1)):
            for i, j in close(counts[home], counts[k], reach):
                if k == same:
                    true = one_replaced(matrices[k][i], matrices[home][j])
                else:
                    true = one_more(matrices[k][i], matrices[home][j])
                a, b = places[k][i[true]], places[home][j[true]]
                out[0].append(a), out[1].append(b)
                if k == longer:
                    out[0].append(b), out[1].append(a)
        a, b = (np.concatenate(x) if x else np.empty(0, np.int64) for x in out[:2])
        return pa.table({"word": table["word"].take(pa.array(a)), "near": table["word"].take(pa.array(b)), "near_n": numbers[b]})

    routed = known.select("word", "n").repartition(total // ROUTED + 1).mapInArrow(route, "size int, task int, kind int, word string, n bigint")
    return routed.groupBy("size", "task").applyInArrow(search, "word string, near string, near_n bigint")


def chained(forms: DataFrame) -> DataFrame:
    """``word, root`` of the words that have a ``form``: the last word of the chain. A form occurs more often than its word, so chains end."""
    steps = settle(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = steps.select(F.col("word").alias("root"), F.col("root").alias("_on"))
        joined = steps.join(onward, "root", "left").select("word", F.coalesce("_on", "root").alias("root"), F.col("_on").isNotNull().alias("_moved"))
        steps = settle(joined, "roots")
        if not steps.filter("_moved").limit(1).count():
            return steps.drop("_moved")
        steps = steps.drop("_moved")


def variants(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", letters: int = LETTERS, least: int = LEAST, damage: int = DAMAGE, ratio: int = RATIO) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word."""
    known = settle(vocabulary(docs, id_column, text_column, letters, least, damage), "vocabulary", free=True)
    best = near_pairs(known).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("_best"))
    form_n = -F.col("_best.less")
    good = form_n >= F.col("n") * ratio
    rows = known.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(good, F.col("_best.near")).alias("form"), F.when(good, form_n).alias("form_n")
    )
    rows = settle(rows, "forms", free=True)
    roots = chained(rows.filter("form is not null"))
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
