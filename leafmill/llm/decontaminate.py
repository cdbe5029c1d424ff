"""Benchmark passages in documents, up to a share of edits, by the q-gram lemma.

Texts are compared as lower-case letters and digits with one space between words. A passage of m bytes with
at most k edits keeps at least ``m - Q + 1 - k * Q`` of its q-grams, and all of them lie within k diagonals
(place in the document minus place in the passage). So:

1. every q-gram of every document is looked up in the benchmark's q-grams;
2. hits are counted in diagonal bands of ``2 * (k + 1)`` that overlap by half, so that any k diagonals lie
   whole in one of them;
3. bands with as many hits as the lemma asks are kept, and a banded alignment of the whole passage decides.

``k`` is ``EDIT_SHARE`` of the passage, lowered for short passages until the lemma asks for one q-gram at
least. Passages under ``LEAST`` bytes identify nothing and are left out.

Documents are scanned where they lie: no shuffle. The benchmark comes to the tasks as a broadcast index, in
blocks of about ``BLOCK_BYTES`` of passages; a larger benchmark means more scans, never a larger index.

Defined results: null texts are empty and hold no passage; null ids come back as they are; repeated documents
or items are reported once each; equal hits are merged into the one with fewest edits, then the first; an
empty table on either side gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.keys import text_key, with_keys
from leafmill.llm.words import mixed, slices, text_bytes

Q = 10
EDIT_SHARE = 1 / 16
LEAST = 24
BLOCK_BYTES = 16 << 20
_BITS = 22
_BASE = np.uint64(0x9E3779B97F4A7C15)

HIT = "item_id bigint, start int, length int, edits int"

_KEPT = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])


def compared(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes to compare of a text column, where each text's begin, and each byte's place in its text.

    Places count bytes of the lower-cased text.
    """
    data, offsets = text_bytes(pc.utf8_lower(column))
    kept = _KEPT[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    # The first byte after a word of the same text becomes the one space.
    space = np.zeros(len(data), bool)
    space[1:] = ~kept[1:] & kept[:-1] & ~first[1:-1]
    place = np.flatnonzero(kept | space)
    out = np.where(space[place], np.uint8(0x20), data[place])
    bounds = np.searchsorted(place, offsets)
    return out, bounds, place - np.repeat(offsets[:-1], np.diff(bounds))


def qgrams(data: np.ndarray) -> np.ndarray:
    """A hash of each Q consecutive bytes."""
    wide = data.astype(np.uint64) + np.uint64(1)

    def joined(left: np.ndarray, right: np.ndarray, size: int, lead: int) -> np.ndarray:
        """Left parts of ``size`` bytes, each followed by a right part of ``lead`` bytes: one polynomial over both."""
        n = max(0, len(right) - size)
        return left[:n] * np.uint64(pow(int(_BASE), lead, 1 << 64)) + right[size : size + n]

    two = joined(wide, wide, 1, 1)
    four = joined(two, two, 2, 2)
    return mixed(joined(joined(four, four, 4, 4), two, 8, 2))


@dataclass
class Index:
    """Q-grams of passages: ``known`` in order, with the passage and the place of entry ``first[g]`` up to ``first[g + 1]``."""

    ids: list[int | None]
    passages: list[bytes]
    edits: np.ndarray
    asked: np.ndarray
    known: np.ndarray
    first: np.ndarray
    item: np.ndarray
    place: np.ndarray
    seen: np.ndarray


def index_of(ids: list[int | None], texts: list[str | None]) -> Index:
    data, bounds, _ = compared(pa.array(texts, pa.string()))
    passages = [data[a:b].tobytes().strip() for a, b in zip(bounds[:-1], bounds[1:])]
    keep = [i for i, p in enumerate(passages) if len(p) >= LEAST]
    ids, passages = [ids[i] for i in keep], [passages[i] for i in keep]
    size = np.array([len(p) for p in passages], np.int64)
    edits = np.minimum((size * EDIT_SHARE).astype(np.int64), (size - Q) // Q)
    grams = [qgrams(np.frombuffer(p, np.uint8)) for p in passages]
    flat = np.concatenate(grams) if grams else np.empty(0, np.uint64)
    item = np.repeat(np.arange(len(grams)), [len(g) for g in grams]).astype(np.int64)
    place = np.concatenate([np.arange(len(g)) for g in grams]).astype(np.int64) if grams else item
    order = np.argsort(flat, kind="stable")
    known, first = np.unique(flat[order], return_index=True)
    seen = np.zeros(1 << _BITS, bool)
    seen[known >> np.uint64(64 - _BITS)] = True
    return Index(ids, passages, edits, size - Q + 1 - edits * Q, known, np.append(first, len(flat)), item[order], place[order], seen)


def aligned(passage: np.ndarray, text: np.ndarray, low: int, high: int, most: int, fixed: bool = False) -> tuple[int, int] | None:
    """The fewest edits from ``passage`` to a stretch of ``text`` that keeps to diagonals low..high, and its end.

    None where that takes more than ``most``. Ties go to the first end. ``fixed``: the stretch starts where the text does.
    """
    width = high - low + 1
    far = most + 1
    slope = np.arange(width)
    columns = np.arange(low, high + 1)
    row = np.where((columns >= 0) & (columns <= len(text)), np.minimum(columns, far) if fixed else 0, far)
    padded = np.concatenate((text, np.zeros(1, text.dtype)))
    for i, byte in enumerate(passage):
        columns = columns + 1
        within = (columns >= 1) & (columns <= len(text))
        same = (padded[np.where(within, columns - 1, len(text))] == byte) & within
        new = np.minimum(row + ~same, np.append(row[1:], far) + 1)
        new = np.where((columns >= 0) & (columns <= len(text)), new, far)
        row = np.minimum(np.minimum.accumulate(new - slope) + slope, far)
        if row.min() >= far:
            return None
    best = int(row.argmin())
    return int(row[best]), low + best + len(passage)


def found_in(data: np.ndarray, bounds: np.ndarray, index: Index) -> list[tuple[int, int, int, int, int]]:
    """``(text, passage, begin, end, edits)`` of each passage found in the texts ``data[bounds[i]:bounds[i + 1]]``."""
    grams = qgrams(data)
    spot = np.flatnonzero(index.seen[grams >> np.uint64(64 - _BITS)])
    owner = np.searchsorted(bounds, spot, "right") - 1
    whole = spot + Q <= bounds[owner + 1]
    spot, owner = spot[whole], owner[whole]
    gram = np.searchsorted(index.known, grams[spot])
    exact = (gram < len(index.known)) & (index.known[np.minimum(gram, len(index.known) - 1)] == grams[spot])
    spot, owner, gram = spot[exact], owner[exact], gram[exact]
    if not len(spot):
        return []
    count = index.first[gram + 1] - index.first[gram]
    entry = np.repeat(index.first[gram] - np.cumsum(count) + count, count) + np.arange(count.sum())
    item = index.item[entry]
    diagonal = np.repeat(spot, count) - index.place[entry] - bounds[np.repeat(owner, count)]
    step = index.edits[item] + 1
    band = diagonal // step
    text = np.repeat(owner, count)
    keys = np.stack([np.concatenate((text, text)), np.concatenate((item, item)), np.concatenate((band, band - 1))])
    order = np.lexsort(keys[::-1])
    keys = keys[:, order]
    fresh = np.concatenate(([True], (np.diff(keys, axis=1) != 0).any(0)))
    opens = np.flatnonzero(fresh)
    hits = np.diff(np.append(opens, keys.shape[1]))
    good = hits >= index.asked[keys[1, opens]]
    out: list[tuple[int, int, int, int, int]] = []
    for i, p, b in keys[:, opens[good]].T.tolist():
        most = int(index.edits[p])
        base, end = int(bounds[i]), int(bounds[i + 1])
        low = b * (most + 1) - most
        high = (b + 2) * (most + 1) + most
        own = data[base:end]
        left = max(0, low)
        whole = own[left : high + len(index.passages[p])].tobytes().find(index.passages[p])
        if whole >= 0:
            out.append((i, p, left + whole, left + whole + len(index.passages[p]), 0))
            continue
        passage = np.frombuffer(index.passages[p], np.uint8)
        best = aligned(passage, own, low, high, most)
        if best is None:
            continue
        edits, stop = best
        # The same from behind, fixed at the end found, gives the beginning.
        back = aligned(passage[::-1], own[max(0, stop - len(passage) - most) : stop][::-1], -most, most, edits, fixed=True) if edits else (0, len(passage))
        out.append((i, p, stop - back[1], stop, edits))
    return merged(out)


def merged(hits: list[tuple[int, int, int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """Overlapping hits of one passage in one text become the one with the fewest edits, then the first."""
    out: list[tuple[int, int, int, int, int]] = []
    reach = -1
    for hit in sorted(set(hits)):
        if out and out[-1][:2] == hit[:2] and hit[2] < reach:
            reach = max(reach, hit[3])
            if hit[4] < out[-1][4]:
                out[-1] = hit
        else:
            out.append(hit)
            reach = hit[3]
    return out


def passages(
    docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """One row per benchmark passage found: the document, the item, its characters in the lower-cased text, the edits."""
    return keyed_passages(docs, benchmark, id_column, text_column, item_column, item_text).drop("_copy").withColumnRenamed("_id", id_column)


def keyed_passages(docs: DataFrame, benchmark: DataFrame, id_column: str, text_column: str, item_column: str, item_text: str) -> DataFrame:
    """``passages`` with the key of the document's row, ``_id`` and ``_copy``."""
    spark = docs.sparkSession
    items = benchmark.filter(F.col(item_text).isNotNull()).select(F.col(item_column).cast("bigint").alias("id"), F.col(item_text).alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = -(-total // BLOCK_BYTES) or 1
    rows = docs.select(F.col(id_column).cast("bigint").alias("_id"), F.coalesce(F.col(text_column), F.lit("")).alias("_text"), text_key(text_column).alias("_copy"))

    def scanned(index) -> DataFrame:
        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = index.value
            schema = pa.schema([("_id", pa.int64()), ("_copy", pa.int64()), ("item_id", pa.int64()), ("start", pa.int32()), ("length", pa.int32()), ("edits", pa.int32())])
            for batch in batches:
                for at, to in slices(batch["_text"]):
                    part = batch.slice(at, to - at)
                    data, bounds, place = compared(part["_text"])
                    lowered: dict[int, bytes] = {}
                    out = []
                    for i, p, begin, end, edits in found_in(data, bounds, known):
                        low, high = int(place[bounds[i] + begin]), int(place[bounds[i] + end - 1]) + 1
                        raw = lowered.setdefault(i, part["_text"][i].as_py().lower().encode())
                        skipped, inside = (sum((b & 0xC0) != 0x80 for b in x) for x in (raw[:low], raw[low:high]))
                        out.append({"_id": part["_id"][i].as_py(), "_copy": part["_copy"][i].as_py(), "item_id": known.ids[p], "start": skipped, "length": inside, "edits": edits})
                    if out:
                        yield pa.RecordBatch.from_pylist(out, schema)

        return rows.mapInArrow(scan, f"_id bigint, _copy bigint, {HIT}")

    parts = []
    for block in range(n_blocks):
        own = items.filter(F.pmod(F.xxhash64("id", "text"), F.lit(n_blocks)) == block).toArrow()
        parts.append(scanned(spark.sparkContext.broadcast(index_of(own["id"].to_pylist(), own["text"].to_pylist()))))
    return reduce(DataFrame.unionAll, parts)


def without_passages(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold a benchmark passage."""
    held = keyed_passages(docs, benchmark, "doc_id", "text", "item_id", "text").select("_id", "_copy").distinct()
    return with_keys(docs, held, "left_anti")
