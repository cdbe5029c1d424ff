"""Repeated passages by relative Lempel-Ziv parsing against the corpus itself.

The reference is every document, in ``doc_id`` order, indexed in blocks of ``window`` words. A block's anchor is
the ``ANCHOR``-gram with the smallest hash in it; neighbouring blocks with one anchor form a run, about six of
them. Equal blocks have equal anchors, so a block can only occur twice where its anchor does.

1. ``anchors``: one row per (document, anchor) from a narrow scan; anchors seen once are dropped.
2. ``runs``: documents meet their repeated anchors; the runs around those get a 128-bit hash of all their words.
3. A run whose words have occurred before points to their earliest place: all its blocks are found at once.
   Where all runs of an anchor are equal, their earliest is no repetition. What is left are the edges of
   passages, where one anchor has different runs: there each block is hashed and points by itself.
4. ``removals``: each document is factored greedily: from the first place with an earlier occurrence, the
   factor runs for as long as the next pointer continues in the same source. A factor of b blocks is
   ``b + window - 1`` words. At a factor's boundary the next block is checked by its own pointer, so a
   block that lies across two factors is found where it occurs whole.

All joins are
equi-joins that adaptive execution may split, so a passage found in a third of all documents costs one
row per occurrence. A task holds a slice of text or one document.

Defined results: null text is empty; a null id counts as the smallest and comes back null; rows that
repeat id and text are one document and get equal results; rows that share an id but not the text are
separate documents at the same place in the order, and neither is earlier than the other; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.keys import real_id, texts
from leafmill.llm.words import grams, inner, mixed, slices, text_bytes, words
from leafmill.shared import settle

WINDOW = 20
ANCHOR = 9
FACTOR = "struct<start: int, n_words: int, ref_id: bigint, ref_start: int>"
RESULT = f"n_words bigint, n_removed bigint, kept_sha256 string, factors array<{FACTOR}>"


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def _block_anchors(hashes: np.ndarray, first: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The block starts, the place of each block's anchor, and the hash of every possible anchor."""
    count = max(0, len(hashes) - window + 1)
    size = min(ANCHOR, (window + 1) // 2)
    values = grams(hashes, size)
    start = np.flatnonzero(inner(first, window, count))
    if not len(start):
        return start, start, values
    best = sliding_window_view(values, window - size + 1).argmin(1)[start]
    return start, start + best, values


def anchors(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``_id, anchor``: the anchors of each document, once per place."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to in slices(batch["_text"]):
                part = batch.slice(at, to - at)
                found = words(part["_text"])
                _, place, values = _block_anchors(found.hash, found.first, window)
                place = np.unique(place)
                owner = pa.array(np.searchsorted(found.first, place, "right") - 1)
                yield pa.record_batch([part["_id"].take(owner), _signed(values[place])], ["_id", "anchor"])

    return docs.select("_id", "_text").mapInArrow(scan, "_id bigint, anchor bigint")


RUN = "_id bigint, _copy bigint, pos int, n_blocks int, anchor bigint, r1 bigint, r2 bigint"


def _runs(start: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Where the runs open among the blocks of a slice."""
    return np.flatnonzero(np.concatenate(([True], (np.diff(place) != 0) | (np.diff(start) != 1)))) if len(start) else start


def runs(docs: DataFrame, marks: DataFrame, window: int = WINDOW) -> DataFrame:
    """Documents and the runs around their repeated anchors, in one table of two kinds of rows.

    A row with ``pos`` is a run. A row without is a document: its text where it has such runs, else its finished
    result. ``_copy`` tells texts of one id apart, and is 0 where the id has one text.
    ``marks``: per id, its repeated anchors, the texts that are later copies, and whether it has several texts.
    """
    schema = pa.schema([
        ("_id", pa.int64()), ("_copy", pa.int64()), ("pos", pa.int32()), ("n_blocks", pa.int32()), ("anchor", pa.int64()), ("r1", pa.int64()),
        ("r2", pa.int64()), ("_text", pa.string()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()),
    ])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to in slices(batch["_text"]):
                yield from one(batch.slice(at, to - at))

    def one(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        found = words(part["_text"])
        start, place, values = _block_anchors(found.hash, found.first, window)
        opens = _runs(start, place)
        owner = np.searchsorted(found.first, start[opens], "right") - 1
        anchor = values[place[opens]] if len(opens) else values
        flat = part["repeated"].flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        lists = np.concatenate(([0], np.cumsum(part["repeated"].value_lengths().fill_null(0).to_numpy(zero_copy_only=False))))
        bounds = np.searchsorted(owner, np.arange(len(part) + 1))
        wanted = np.zeros(len(opens), bool)
        for i in np.flatnonzero(np.diff(lists)):
            low, high = bounds[i], bounds[i + 1]
            wanted[low:high] = np.isin(anchor[low:high], flat[lists[i] : lists[i + 1]])
        keep = np.flatnonzero(wanted)
        count = np.diff(found.first)
        later = part["later_copy"].to_numpy(zero_copy_only=False).astype(bool)
        open_ = np.zeros(len(part), bool)
        open_[owner[keep]] = True
        n = len(keep)
        if n:
            size = np.diff(np.append(opens, len(start)))
            step = mixed(np.arange(len(start), dtype=np.uint64) - np.repeat(opens, size).astype(np.uint64) + np.uint64(1))
            hashes = [np.add.reduceat(mixed(grams(found.hash, window, second)[start] ^ step), opens)[keep] for second in (False, True)]
            local = (start[opens] - found.first[owner])[keep].astype(np.int32)
            spot = pa.array(owner[keep])
            none = [pa.nulls(n, t) for t in (pa.string(), pa.int64(), pa.int64(), pa.string())]
            yield pa.record_batch([
                part["_id"].take(spot), part["_copy"].take(spot), pa.array(local), pa.array(size[keep].astype(np.int32)), _signed(anchor[keep]),
                *map(_signed, hashes), *none,
            ], schema=schema)
        data, offsets = text_bytes(part["_text"])
        digests, removed = [], np.zeros(len(part), np.int64)
        for i in range(len(part)):
            whole = later[i] and count[i] >= window
            removed[i] = count[i] if whole else 0
            digests.append(None if open_[i] else hashlib.sha256(b"" if whole else b" ".join(data[offsets[i] : offsets[i + 1]].tobytes().split())).hexdigest())
        m = len(part)
        text = part["_text"].take(pa.array(np.arange(m), mask=~open_))
        none = [pa.nulls(m, t) for t in (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64())]
        yield pa.record_batch([part["_id"], part["_copy"], *none, text, pa.array(count, pa.int64()), pa.array(removed), pa.array(digests, pa.string())], schema=schema)

    none = F.array().cast("array<bigint>")
    later = F.coalesce(F.array_contains("later", F.col("_copy")), F.lit(False))
    rows = docs.join(marks, "_id", "left").select(
        "_id", F.when(F.col("apart"), F.col("_copy")).otherwise(0).alias("_copy"), "_text",
        F.when(later, none).otherwise(F.coalesce("repeated", none)).alias("repeated"), later.alias("later_copy"),
    )
    return rows.mapInArrow(scan, f"{RUN}, _text string, n_words bigint, n_removed bigint, kept_sha256 string")


def blocks(docs: DataFrame, places: DataFrame, window: int = WINDOW) -> DataFrame:
    """``_id, _copy, pos, b1, b2``: each block of the runs in ``places`` (per document, ``places`` of pos and n_blocks)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to in slices(batch["_text"]):
                part = batch.slice(at, to - at)
                found = words(part["_text"])
                spots = part["places"].flatten()
                owner = np.repeat(np.arange(len(part)), part["places"].value_lengths().to_numpy(zero_copy_only=False))
                pos, size = (spots.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(2))
                inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                local = np.repeat(pos, size) + inside
                owner = np.repeat(owner, size)
                start = found.first[owner] + local
                spot = pa.array(owner)
                hashes = [_signed(grams(found.hash, window, second)[start]) for second in (False, True)]
                yield pa.record_batch([part["_id"].take(spot), part["_copy"].take(spot), pa.array(local.astype(np.int32)), *hashes], ["_id", "_copy", "pos", "b1", "b2"])

    rows = docs.join(places, ["_id", "_copy"]).select("_id", "_copy", "_text", "places")
    return rows.mapInArrow(scan, "_id bigint, _copy bigint, pos int, b1 bigint, b2 bigint")


def _earliest(table: DataFrame, *content: str) -> DataFrame:
    """``table`` with the earliest place of each row's content that occurs again, and whether the row comes later.

    The earliest places are settled, so that both sides of the join are plain shuffles and content that a third of
    all documents hold can be split.
    """
    first = table.groupBy(*content).agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct("_id", "pos")).alias("_first")).filter("_n > 1")
    later = (F.col("_id") > F.col("_first._id")) | ((F.col("_id") == F.col("_first._id")) & (F.col("pos") > F.col("_first.pos")))
    joined = table.join(settle(first.drop("_n"), "earliest"), list(content), "left")
    return joined.withColumn("later", F.coalesce(later, F.lit(False)))


def pointers(found: DataFrame, docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``_id, _copy, pointers``: per document, its stretches of blocks that also start earlier, with that earlier place."""
    placed = settle(_earliest(found, "r1", "r2").select("_id", "_copy", "pos", "n_blocks", "anchor", "r1", "r2", "later", F.col("_first._id").alias("ref_id"), F.col("_first.pos").alias("ref_start")), "runs", free=True)
    heads = placed.filter("not later")
    content = F.struct("r1", "r2")
    edges = heads.groupBy("anchor").agg(F.min(content).alias("_low"), F.max(content).alias("_high")).filter("_low != _high").select("anchor")
    open_ = heads.join(edges, "anchor").groupBy("_id", "_copy").agg(F.collect_set(F.struct("pos", "n_blocks")).alias("places"))
    single = settle(blocks(docs, open_, window), "blocks", free=True)
    parts = [
        placed.filter("later").select("_id", "_copy", "pos", "n_blocks", "ref_id", "ref_start"),
        _earliest(single, "b1", "b2").filter("later").select("_id", "_copy", "pos", F.lit(1).alias("n_blocks"), F.col("_first._id").alias("ref_id"), F.col("_first.pos").alias("ref_start")),
    ]
    return parts[0].unionByName(parts[1]).groupBy("_id", "_copy").agg(F.collect_set(F.struct("pos", "n_blocks", "ref_id", "ref_start")).alias("pointers"))


def factored(pos: np.ndarray, n_blocks: np.ndarray, ref_id: np.ndarray, ref_start: np.ndarray, window: int) -> list[dict]:
    """The greedy factors of one document from its pointers."""
    order = np.argsort(pos)
    pos, n_blocks, ref_id, ref_start = pos[order], n_blocks[order], ref_id[order], ref_start[order]
    on = (np.diff(pos) == n_blocks[:-1]) & (np.diff(ref_id) == 0) & (np.diff(ref_start) == n_blocks[:-1])
    opens = np.concatenate(([0], np.flatnonzero(~on) + 1))
    size = np.add.reduceat(n_blocks, opens)
    return [{"start": int(pos[o]), "n_words": int(b) + window - 1, "ref_id": int(ref_id[o]), "ref_start": int(ref_start[o])} for o, b in zip(opens, size)]


def removals(docs: DataFrame, window: int = WINDOW, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row of ``docs``: its words, how many lie in passages that also start earlier, what is kept, the factors."""
    rows = texts(docs, id_column, text_column).withColumn("_copy", F.xxhash64("_text"))
    digest = rows.select("_id", "_copy", F.sha2("_text", 256).alias("_digest"))
    firsts = digest.groupBy("_digest").agg(F.min("_id").alias("_least"), F.max("_id").alias("_most")).filter("_least < _most")
    copies = digest.join(firsts, "_digest").filter("_id > _least").select("_id", "_copy")
    several = digest.groupBy("_id").agg((F.min("_copy") < F.max("_copy")).alias("apart")).filter("apart")
    places = anchors(rows, window)
    repeats = settle(places.groupBy("anchor").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("anchor"), "repeats")
    marked = [
        places.join(repeats, "anchor").select("_id", "anchor"),
        # A later copy is one factor: it brings no blocks of its own.
        copies.select("_id", F.col("_copy").alias("later")),
        several.select("_id", "apart"),
    ]
    one = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), marked)
    marks = one.groupBy("_id").agg(F.collect_set("anchor").alias("repeated"), F.collect_set("later").alias("later"), F.coalesce(F.max("apart"), F.lit(False)).alias("apart"))
    both = settle(runs(rows, marks, window), "documents", free=True)
    found = both.filter("pos is not null").select("_id", "_copy", "pos", "n_blocks", "anchor", "r1", "r2")
    whole = both.filter("pos is null").select("_id", "_copy", "_text", "n_words", "n_removed", "kept_sha256")
    done = whole.filter("_text is null").select(real_id("_id").alias(id_column), "n_words", "n_removed", "kept_sha256", F.array().cast(f"array<{FACTOR}>").alias("factors"))
    open_ = whole.filter("_text is not null").select("_id", "_copy", "_text")
    rest = open_.join(pointers(found, open_, window), ["_id", "_copy"], "left")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("factors", pa.list_(pa.struct([("start", pa.int32()), ("n_words", pa.int32()), ("ref_id", pa.int64()), ("ref_start", pa.int32())])))])
        for batch in batches:
            for at, to in slices(batch["_text"]):
                out: list[dict] = []
                part = batch.slice(at, to - at)
                for i in range(len(part)):
                    tokens = part["_text"][i].as_py().encode().split()
                    entry = part["pointers"][i]
                    factors: list[dict] = []
                    kept = np.ones(len(tokens), bool)
                    if entry.is_valid and len(entry.values):
                        fields = [entry.values.field(k).to_numpy(zero_copy_only=False) for k in range(4)]
                        factors = factored(*fields, window)
                        for f in factors:
                            kept[f["start"] : f["start"] + f["n_words"]] = False
                    left = b" ".join(t for t, k in zip(tokens, kept.tolist()) if k)
                    out.append({"_id": part["_id"][i].as_py(), "n_words": len(tokens), "n_removed": int((~kept).sum()), "kept_sha256": hashlib.sha256(left).hexdigest(), "factors": factors})
                yield pa.RecordBatch.from_pylist(out, schema)

    parsed = rest.mapInArrow(parse, f"_id bigint, {RESULT}")
    return done.unionByName(parsed.select(real_id("_id").alias(id_column), "n_words", "n_removed", "kept_sha256", "factors"))


def strip(docs: DataFrame, window: int = WINDOW, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` with each text's removed words gone and one space between the kept ones.

    For ids that are unique. Later whole-text copies become empty.
    """
    found = removals(docs, window, id_column, text_column).select(
        F.col(id_column).alias("_rid"), F.col("n_removed").alias("_gone"), F.col("n_words").alias("_words"), F.col("factors").alias("_factors")
    )
    tokens = F.filter(F.split(F.coalesce(F.col(text_column), F.lit("")), "[ \\x09-\\x0D]+"), lambda w: w != "")
    spans = F.col("_factors")
    kept = F.filter(
        F.transform(tokens, lambda w, i: F.struct(w.alias("w"), i.alias("i"))),
        lambda t: ~F.exists(spans, lambda s: (t["i"] >= s["start"]) & (t["i"] < s["start"] + s["n_words"])),
    )
    text = F.when(F.col("_gone") == 0, F.array_join(tokens, " ")).when(F.col("_gone") == F.col("_words"), F.lit(""))
    joined = docs.join(found, docs[id_column].eqNullSafe(F.col("_rid")), "left")
    return joined.withColumn(text_column, text.otherwise(F.array_join(F.transform(kept, lambda t: t["w"]), " "))).select(*docs.columns)
