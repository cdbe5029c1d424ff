"""Token id matrices: best-fit-decreasing packing of tokenised documents into rows of one width.

Each task tokenises its documents as they come, cuts those longer than a row into pieces (all tokens stay,
in order), gathers pieces up to ``GATHER`` tokens, and packs them: longest piece first, each into the open
row with the least room that still holds it. That row is found in a segment tree over capacities whose
leaf c counts the open rows with room c: the search is log2(width) steps. Documents never leave their task:
no shuffle, and what a task holds is bounded by ``GATHER`` and one document.

Result, one row per matrix row:

* ``shard``, ``row``: the task and the row's number in it;
* ``input_ids``: ``width`` little-endian 16-bit ids (32-bit where the vocabulary is larger), the tail
  filled with ``fill``;
* ``position_ids``: as many places, starting again at 0 with every segment (and in the tail); a document's
  later pieces start at 0 too, since attention does not reach across rows;
* ``cu_seqlens``: cumulative segment lengths, from 0 to ``n_tokens``;
* ``doc_ids``, ``parts``: the document and the piece (from 0) of each segment.

Defined results: null and empty texts have no tokens and no segment; null ids come back as null; repeated rows
are packed as often as they come; ties in length keep their order; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import base64
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDTH = 4096
GATHER = 1 << 20
RANKS = "byte_bpe_50k.tiktoken"
#: Free in the vocabulary.
FILL = 50256
PACKED = (
    "shard int, row int, n_tokens int, n_segments int, input_ids binary, position_ids binary, cu_seqlens array<int>, "
    "doc_ids array<bigint>, parts array<int>"
)
_SCHEMA = pa.schema([
    ("shard", pa.int32()), ("row", pa.int32()), ("n_tokens", pa.int32()), ("n_segments", pa.int32()), ("input_ids", pa.binary()),
    ("position_ids", pa.binary()), ("cu_seqlens", pa.list_(pa.int32())), ("doc_ids", pa.list_(pa.int64())), ("parts", pa.list_(pa.int32())),
])


@lru_cache(maxsize=2)
def encoder(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


class Capacities:
    """A segment tree over 0..width: each leaf counts open rows with that much room."""

    def __init__(self, width: int) -> None:
        self.size = 1 << width.bit_length()
        self.count = [0] * (2 * self.size)
        self.rows: dict[int, list[int]] = defaultdict(list)

    def add(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        self._change(room, 1)

    def _change(self, room: int, by: int) -> None:
        at = room + self.size
        while at:
            self.count[at] += by
            at >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """Remove and return (room, row) of the open row with the least room of at least ``need``."""
        count, at = self.count, need + self.size
        if not count[at]:
            # Up to the first right-hand neighbour that holds anything, then down its left edge.
            while at > 1 and (at & 1 or not count[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.size:
                at = 2 * at if count[2 * at] else 2 * at + 1
        room = at - self.size
        self._change(room, -1)
        return room, self.rows[room].pop()


def best_fit_decreasing(lengths: list[int], width: int) -> list[list[int]]:
    """Which pieces go into which row, each at most ``width``."""
    rows: list[list[int]] = []
    open_rows = Capacities(width)
    for piece in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        found = open_rows.take(lengths[piece])
        room, row = found or (width, len(rows))
        if found is None:
            rows.append([])
        rows[row].append(piece)
        if room > lengths[piece]:
            open_rows.add(room - lengths[piece], row)
    return rows


def packed(
    docs: DataFrame, width: int = WIDTH, ranks_path: str | None = None, fill: int = FILL, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    path = ranks_path or public_tokenizers.path(RANKS)
    kind = np.dtype("<u2") if max(fill, encoder(path).n_vocab) <= 0xFFFF else np.dtype("<u4")
    place = np.dtype("<u2") if width <= 0xFFFF else np.dtype("<u4")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, shard, row = encoder(path), TaskContext.get().partitionId(), 0
        steps = np.arange(width, dtype=place)
        owners: list[tuple[int | None, int]] = []
        pieces: list[np.ndarray] = []
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal row
            out = []
            for members in best_fit_decreasing([len(p) for p in pieces], width):
                ends = np.concatenate(([0], np.cumsum([len(pieces[m]) for m in members])))
                ids, places = np.full(width, fill, kind), np.zeros(width, place)
                for m, at, to in zip(members, ends[:-1], ends[1:]):
                    ids[at:to] = pieces[m]
                    places[at:to] = steps[: to - at]
                places[ends[-1] :] = steps[: width - ends[-1]]
                out.append({
                    "shard": shard, "row": row, "n_tokens": int(ends[-1]), "n_segments": len(members), "input_ids": ids.tobytes(),
                    "position_ids": places.tobytes(), "cu_seqlens": ends.tolist(), "doc_ids": [owners[m][0] for m in members],
                    "parts": [owners[m][1] for m in members],
                })
                row += 1
            owners.clear()
            pieces.clear()
            if out:
                yield pa.RecordBatch.from_pylist(out, _SCHEMA)

        for batch in batches:
            for id_, text in zip(batch["_id"].to_pylist(), batch["_text"]):
                ids = encoding.encode_to_numpy(text.as_py(), disallowed_special=())
                for part, at in enumerate(range(0, len(ids), width)):
                    owners.append((id_, part))
                    pieces.append(ids[at : at + width].astype(kind))
                    held += len(pieces[-1])
                    if held >= GATHER:
                        yield from flush()
                        held = 0
        yield from flush()

    rows = docs.select(F.col(id_column).cast("bigint").alias("_id"), F.coalesce(F.col(text_column), F.lit("")).alias("_text"))
    return rows.mapInArrow(scan, PACKED)
