"""Scores of an n-gram language model whose quantised counts lie in a log-frequency Bloom filter.

Tokens are lower-cased words and an end mark; each text has a begin mark before them, which is no token. Counts of all
n-grams up to ``ORDER`` of the training texts are quantised to the steps 1, 2, 3, 5, 8, 12 ... (the next at least
``STEP`` times as large): an n-gram of level j, at or over the j-th step, is put into the filter as the items (n-gram, 1) to
(n-gram, j). Its count is read back by asking for level 1, 2, ... until one is missing, so a filter may
overstate a count (an item's chance is about 2 in 100 at ``BITS`` = 10 and ``PROBES`` = 6), never understate it. The bits of an item
lie in one 64-bit word, so that a membership probe is one look-up.

A word's probability interpolates from the lowest order upward:

    P_1(w)   = (q(w) + 1) / (N + V + 1)
    P_k(w|h) = (q(hw) + W C(h)^b_k P_{k-1}(w)) / (C(h) + W C(h)^b_k)

with q the quantised counts and C(h) that of the history (the number of texts for the begin mark). As in Witten-Bell smoothing the
weight of the lower order goes with the number of kinds that follow a history; that number is taken as C^b (Heaps' law)
with the b_k that makes the numbers of all histories add up to the k-grams there are, so only counts need be stored. W = ``LOWER_WEIGHT``.
A longer n-gram never counts more than its own parts, which takes back most overstatements.

Work: one pass turns slices of text into sorted n-gram hashes, sent by their leading bits as byte strings; each slice of hashes
is counted by itself and becomes its own part of the filter. The parts are broadcast in pieces of ``PIECE_BYTES`` and at most
``ROUND_BYTES`` in a pass over the texts; a larger filter takes more passes, which hand on the levels found so
far (one byte for each token and order). Exact counts of words give ``base_score``: of the ``HEAD`` commonest words they are
broadcast, other words are joined by shuffle. N-grams are told apart by 46 hash bits or more, words by 64.

Defined results: null text is empty and has the end mark alone; null id counts as an empty id; repeated rows are scored and
counted each; without training texts every token has probability 1; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm.blobs import binaries, grouped, packed, slice_bits, sliced, steps, summed, unpacked
from leafmill.llm.words import grams, mixed, slices, words
from leafmill.shared import settle

ORDER = 3
STEP = 1.5
BITS = 10
PROBES = 6
LOWER_WEIGHT = 4.0
SLICE_TEXT = 4 << 20
PIECE_BYTES = 16 << 20
ROUND_BYTES = 256 << 20
HEAD = 1 << 20

_U = np.uint64
BEGIN, END = _U(0x5851F42D4C957F2D), _U(0x14057B7EF767814F)


def tag(n: int) -> np.uint64:
    return _U(n * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)


@cache
def levels() -> tuple[np.ndarray, np.ndarray]:
    """The steps, and the count that stands for each level (none for level 0)."""
    at = [1]
    while at[-1] < 1 << 61:
        at.append(max(at[-1] + 1, int(np.ceil(at[-1] * STEP))))
    at_ = np.array(at, np.uint64)
    return at_, np.concatenate(([0.0], np.sqrt(at_.astype(float) * np.append(at_[1:] - _U(1), at_[-1]).astype(float))))


def sequences(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes with begin and end marks, and the first place of each text (and the length)."""
    found = words(column, lower=True)
    first = found.first + 2 * np.arange(len(found.first))
    out = np.empty(int(first[-1]), np.uint64)
    inner = np.ones(len(out), bool)
    inner[first[:-1]] = inner[first[1:] - 1] = False
    out[inner], out[first[:-1]], out[first[1:] - 1] = found.hash, BEGIN, END
    return out, first


def ngrams(sequence: np.ndarray, first: np.ndarray, order: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams that end in a token, and the places of those tokens."""
    offset = np.arange(len(sequence)) - np.repeat(first[:-1], np.diff(first))
    at = np.flatnonzero(offset >= max(1, order - 1))
    h = mixed(grams(sequence, order)[at - order + 1] + tag(order))
    return (h if order == 1 else h & ~_U((1 << cut_bits(bits)) - 1)), at


def cut_bits(bits: int) -> int:
    """The last bits that hashes go without, so that their differences in a slice of text fit 32 bits."""
    return 64 - max(46, bits + 36)


@cache
def masks() -> tuple[np.ndarray, np.ndarray]:
    """2^16 choices of ``PROBES`` bits of a word, and each as a mask."""
    bits = np.random.Generator(np.random.PCG64(11)).random((1 << 16, 64)).argsort(axis=1)[:, :PROBES].astype(np.uint64)
    return bits, np.bitwise_or.reduce(_U(1) << bits, axis=1)


def places(items: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The word of an item among ``size`` words."""
    return ((items >> _U(32)) * size) >> _U(32)


def counted(texts: DataFrame, bits: int, order: int) -> DataFrame:
    """One row per slice of n-gram hashes: its part of the filter, its words with exact counts, and for every order its n-grams by level."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to in slices(batch["_text"]):
                sequence, first = sequences(batch["_text"].slice(at, to - at))
                out: tuple[list, ...] = ([], [], [], [], [])
                for k in range(1, order + 1):
                    own, times = np.unique(ngrams(sequence, first, k, bits)[0], return_counts=True)
                    for s, low, high in sliced(own, bits):
                        row = (s, k, high - low, packed(steps(own[low:high], s << (64 - bits)) >> _U(0 if k == 1 else cut_bits(bits))), packed(times[low:high]))
                        for column, x in zip(out, row):
                            column.append(x)
                yield pa.record_batch([pa.array(x, t) for x, t in zip(out, (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()))], ["slice", "k", "size", "hashes", "times"])

    steps_, _ = levels()

    def build(table: pa.Table) -> pa.Table:
        s = table["slice"][0].as_py()
        kinds, items, own = [], [], (np.empty(0, np.uint64), np.empty(0, np.uint64))
        ks = table["k"].to_numpy()
        for k in range(1, order + 1):
            rows = table.filter(pa.array(ks == k))
            if not len(rows):
                kinds.append([0] * len(steps_))
                continue
            shift = _U(0 if k == 1 else cut_bits(bits))
            n = rows["size"].to_pylist()
            hashes = np.concatenate([summed(unpacked(v, i) << shift, s << (64 - bits)) for v, i in zip(rows["hashes"].to_pylist(), n)])
            times = np.concatenate([unpacked(v, i) for v, i in zip(rows["times"].to_pylist(), n)])
            place, starts = grouped(hashes)
            hashes, times = hashes[place[starts]], np.add.reduceat(times[place], starts)
            level = np.searchsorted(steps_, times, "right")
            kinds.append(np.bincount(level, minlength=len(steps_) + 1)[1:].tolist())
            for j in range(1, int(level.max()) + 1):
                items.append(mixed(hashes[level >= j] + tag(j)))
            if k == 1:
                own = (hashes, times)
        all_items = np.concatenate(items)
        size = -(-max(64, BITS * len(all_items)) // 64)
        filled, at = np.zeros(64 * size, bool), places(all_items, _U(size)) << _U(6)
        for probe in range(PROBES):
            filled[at + masks()[0][all_items & _U(0xFFFF), probe]] = True
        row = [[s], [size], [np.packbits(filled, bitorder="little").tobytes()], [kinds], [own[0].view(np.int64).tolist()], [own[1].astype(np.int64).tolist()]]
        return pa.table([pa.array(x, f.type) for x, f in zip(row, schema)], schema=schema)

    numbers = pa.list_(pa.int64())
    schema = pa.schema([("slice", pa.int32()), ("size", pa.int64()), ("bits", pa.binary()), ("kinds", pa.list_(numbers)), ("h", numbers), ("c", numbers)])
    found = texts.mapInArrow(scan, "slice int, k int, size bigint, hashes binary, times binary")
    return found.groupBy("slice").applyInArrow(build, "slice int, size bigint, bits binary, kinds array<array<bigint>>, h array<bigint>, c array<bigint>")


@dataclass
class Piece:
    """Consecutive slices of the filter: the first, where each one's words start, how many it has, and the words."""

    low: int
    start: np.ndarray
    size: np.ndarray
    bits: np.ndarray

    def levels(self, hashes: np.ndarray, slice_bits_: int) -> np.ndarray:
        """The level of each n-gram (0 if it is not there); all belong to slices of this piece."""
        steps_, _ = levels()
        own = (hashes >> _U(64 - slice_bits_)).astype(np.int64) - self.low
        out, alive = np.zeros(len(hashes), np.uint8), np.flatnonzero(self.size[own])
        hashes, start, size = hashes[alive], self.start[own[alive]], self.size[own[alive]]
        _, chosen = masks()
        for j in range(1, len(steps_) + 1):
            if not len(alive):
                break
            items = mixed(hashes + tag(j))
            mask = chosen[items & _U(0xFFFF)]
            hit = np.flatnonzero(self.bits[start + places(items, size)] & mask == mask)
            alive, hashes, start, size = alive[hit], hashes[hit], start[hit], size[hit]
            out[alive] = j
        return out


def rounds(table: DataFrame) -> list[list[tuple[int, int]]]:
    """Ranges of slices, each a piece of at most ``PIECE_BYTES`` (or one slice), in rounds of at most ``ROUND_BYTES``."""
    out: list[list[tuple[int, int]]] = [[]]
    in_piece = in_round = 0
    for s, size in sorted((r["slice"], r["size"] * 8) for r in table.select("slice", "size").collect()):
        if out[-1] and in_round + size > ROUND_BYTES:
            out.append([])
            in_round = 0
        if not out[-1] or in_piece + size > PIECE_BYTES:
            out[-1].append((s, s))
            in_piece = 0
        out[-1][-1] = (out[-1][-1][0], s)
        in_piece, in_round = in_piece + size, in_round + size
    return [x for x in out if x]


def piece(table: DataFrame, low: int, high: int) -> Piece:
    rows = table.filter(F.col("slice").between(low, high)).select("slice", "size", "bits").toArrow().sort_by("slice")
    size = np.zeros(high - low + 1, np.uint64)
    size[rows["slice"].to_numpy() - low] = rows["size"].to_numpy()
    return Piece(low, np.cumsum(size) - size, size, np.frombuffer(b"".join(x.as_buffer() for x in rows["bits"]), "<u8"))


def held_here(hashes: np.ndarray, pieces: list[tuple], bits: int) -> np.ndarray:
    """Which n-grams belong to the slices of a round's pieces: only those are sorted and looked up."""
    slice_ = hashes >> _U(64 - bits)
    return (slice_ >= _U(pieces[0][0])) & (slice_ <= _U(pieces[-1][1]))


def probed(texts: DataFrame, table: DataFrame, bits: int, order: int, finish: Callable, schema: str) -> DataFrame:
    """``finish(rows, sequence, first, found)`` of slices of ``texts``, with ``found`` for each token the level of the n-gram of each order that ends there.

    A round looks into a part of the filter; several rounds write a table with the levels found so far between them.
    """
    context = texts.sparkSession.sparkContext
    frame = texts.withColumn("_found", F.lit(None).cast("binary"))
    names, between = frame.columns, frame.schema
    all_rounds = rounds(table) or [[]]
    several = len(all_rounds) > 1
    for number, ranges in enumerate(all_rounds):
        pieces = [(low, high, context.broadcast(piece(table, low, high))) for low, high in ranges]
        last = number + 1 == len(all_rounds)

        def scan(batches: Iterator[pa.RecordBatch], pieces=pieces, last=last) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at, to in slices(batch["_text"], 1 << 20):
                    part = batch.slice(at, to - at)
                    sequence, first = sequences(part["_text"])
                    level = np.zeros((len(sequence), order), np.uint8)
                    for k in range(1, order + 1):
                        h, where = ngrams(sequence, first, k, bits)
                        if several:
                            asked = held_here(h, pieces, bits)
                            h, where = h[asked], where[asked]
                        own, inverse = np.unique(h, return_inverse=True)
                        found, slice_ = np.zeros(len(own), np.uint8), own >> _U(64 - bits)
                        for low, high, held in pieces:
                            a, b = np.searchsorted(slice_, _U(low)), np.searchsorted(slice_, _U(high), "right")
                            found[a:b] = held.value.levels(own[a:b], bits)
                        level[where, k - 1] = found[inverse]
                    token = np.ones(len(sequence), bool)
                    token[first[:-1]] = False
                    flat = level[token].reshape(-1)
                    before = part["_found"]
                    if before.null_count < len(before):
                        flat = np.maximum(flat, np.frombuffer(b"".join(x.as_buffer() for x in before), np.uint8))
                    if last:
                        yield finish(part, sequence, first, flat.reshape(-1, order))
                        continue
                    ends = (first[1:] - np.arange(1, len(first))) * order
                    yield pa.record_batch([part[c] if c != "_found" else binaries(flat, ends) for c in names], names)

        if last:
            return frame.mapInArrow(scan, schema)
        frame = settle(frame.mapInArrow(scan, between), "levels")
        for _, _, held in pieces:
            held.unpersist()
    raise AssertionError("there is always a last round")


@dataclass
class Model:
    tokens: int
    kinds: int
    texts: int
    #: The exponents b_k of the orders from 2.
    growth: list[float]

    def log10(self, found: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The log10 probability of every token; ``found`` has a row of levels per token, ``first`` the first token of each text."""
        _, counts = levels()
        q = counts[found]
        p = (q[:, 0] + 1) / (self.tokens + self.kinds + 1)
        for k, growth in enumerate(self.growth, 1):
            history = np.zeros(len(q))
            history[1:] = q[:-1, k - 1]
            history[first] = self.texts if k == 1 else 0
            own = np.minimum(np.minimum(q[:, k], history), q[:, k - 1])
            lower = LOWER_WEIGHT * np.power(history, growth, where=history > 0, out=np.zeros(len(q)))
            p = np.where(history > 0, (own + lower * p) / np.where(history > 0, history + lower, 1), p)
        return np.log10(p)


def heaps(histories: np.ndarray, kinds: int) -> float:
    """The b in 0 to 1 with which the histories (numbers of them by level) are followed by ``kinds`` kinds in all."""
    _, counts = levels()
    low, high = 0.0, 1.0
    for _ in range(50):
        middle = (low + high) / 2
        low, high = (middle, high) if (histories * counts[1:] ** middle).sum() < kinds else (low, middle)
    return (low + high) / 2


def model_of(table: DataFrame, texts: int, order: int) -> Model:
    tokens = table.agg(F.sum(F.aggregate("c", F.lit(0).cast("bigint"), lambda a, x: a + x))).first()[0] or 0
    by_level = table.select(F.posexplode("kinds").alias("k", "own")).select("k", F.posexplode("own").alias("level", "n"))
    kinds = np.zeros((order, len(levels()[0])))
    for row in by_level.groupBy("k", "level").agg(F.sum("n").alias("n")).collect():
        kinds[row["k"], row["level"]] = row["n"]
    begin = np.zeros(kinds.shape[1])
    if texts:
        begin[np.searchsorted(levels()[0], texts, "right") - 1] = 1
    growth = [heaps(kinds[k - 1] + (begin if k == 1 else 0), int(kinds[k].sum())) for k in range(1, order)]
    return Model(tokens, int(kinds[0].sum()), texts, growth)


def head(counts: DataFrame) -> tuple[np.ndarray, np.ndarray, bool]:
    """The commonest words, ``HEAD`` at most and sorted by hash, with their counts, and whether these are all."""
    power = F.floor(F.log2(F.col("c") + 0.5))
    least, taken, sizes = None, 0, sorted(counts.groupBy(power.alias("power")).count().collect(), reverse=True)
    for size in sizes:
        if taken + size["count"] > HEAD:
            break
        least, taken = size["power"], taken + size["count"]
    rows = (counts.limit(0) if least is None else counts.filter(power >= least)).toArrow()
    order = np.argsort(rows["h"].to_numpy())
    return rows["h"].to_numpy()[order], rows["c"].to_numpy()[order], taken == sum(s["count"] for s in sizes)


def scores(docs: DataFrame, train: Column, id_column: str = "doc_id", text_column: str = "text", order: int = ORDER) -> DataFrame:
    """Per row of ``docs``: ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score``, learned from the rows where ``train`` holds."""
    texts = docs.select(F.col(id_column).alias("_id"), F.coalesce(F.col(text_column), F.lit("")).alias("_text"), F.coalesce(train, F.lit(False)).alias("_train"))
    learned = texts.filter("_train").select("_text")
    n_texts, n_bytes = learned.agg(F.count("*"), F.sum(F.octet_length("_text"))).first()
    bits = slice_bits(n_bytes or 0, SLICE_TEXT)
    table = settle(counted(learned, bits, order), "ngrams", free=True)
    model = model_of(table, n_texts, order)
    counts = table.select(F.explode(F.arrays_zip("h", "c")).alias("_x")).select("_x.*")
    common, times, whole = head(counts)
    held = docs.sparkSession.sparkContext.broadcast((common, np.log10(times + 1.0)))

    def score(part: pa.RecordBatch, sequence: np.ndarray, first: np.ndarray, found: np.ndarray) -> pa.RecordBatch:
        known, logs = held.value
        own = ngrams(sequence, first, 1, bits)[0].view(np.int64)
        first = first - np.arange(len(first))
        place = np.minimum(np.searchsorted(known, own), max(len(known) - 1, 0))
        there = known[place] == own if len(known) else np.zeros(len(own), bool)
        base = np.add.reduceat(np.where(there, logs[place] if len(known) else 0.0, 0.0), first[:-1])
        value = np.add.reduceat(model.log10(found, first[:-1]), first[:-1])
        rest, ends = own[~there], np.searchsorted(np.flatnonzero(~there), first)
        if whole:
            rest, ends = rest[:0], np.zeros_like(ends)
        others = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(rest))
        n_known = np.add.reduceat(there.astype(np.int64), first[:-1])
        columns = [part["_id"], part["_train"], pa.array(np.diff(first)), pa.array(n_known), pa.array(base), pa.array(value), others]
        return pa.record_batch(columns, ["_id", "_train", "n_tokens", "n_known", "_base", "score", "_rest"])

    kind = docs.schema[id_column].dataType.simpleString()
    found = probed(texts, table, bits, order, score, f"_id {kind}, _train boolean, n_tokens bigint, n_known bigint, _base double, score double, _rest array<bigint>")
    if not whole:
        found = settle(found.withColumn("_row", F.monotonically_increasing_id()), "described")
        rest = found.select("_row", F.explode("_rest").alias("h")).join(settle(counts, "words"), "h")
        rest = rest.groupBy("_row").agg(F.sum(F.log10(F.col("c") + 1)).alias("_more"), F.count("*").alias("_n"))
        found = found.drop("_rest").join(rest, "_row", "left")
        found = found.withColumn("_base", F.col("_base") + F.coalesce("_more", F.lit(0.0))).withColumn("n_known", F.col("n_known") + F.coalesce("_n", F.lit(0)))
    each = float(np.log10(model.tokens + model.kinds + 1))
    return found.select(
        F.col("_id").alias(id_column), "_train", "n_tokens", "n_known", F.lit(model.tokens).cast("bigint").alias("train_tokens"),
        (F.col("_base") - F.col("n_tokens") * F.lit(each)).alias("base_score"), "score",
    )
