"""Sorted hashes and small numbers as byte strings, so that a shuffle moves a few bytes for each instead of a row."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A bitmap of hashes has 2^BITMAP bits whatever the number of hashes: 16 MB.
BITMAP = 27


def packed(numbers: np.ndarray) -> bytes:
    """Whole numbers from 0 in the fewest bytes that hold the largest."""
    most = int(numbers.max()) if len(numbers) else 0
    width = next(w for w in (1, 2, 4, 8) if most < 1 << 8 * w)
    return numbers.astype(f"<u{width}").tobytes()


def unpacked(value: bytes, n: int) -> np.ndarray:
    return np.frombuffer(value, f"<u{len(value) // n}").astype(np.uint64) if n else np.empty(0, np.uint64)


def steps(ascending: np.ndarray, base: int = 0) -> np.ndarray:
    """The differences of sorted numbers, the first from ``base``: what ``packed`` holds in few bytes."""
    return np.diff(ascending, prepend=np.uint64(base))


def summed(steps_: np.ndarray, base: int = 0) -> np.ndarray:
    return np.cumsum(steps_, dtype=np.uint64) + np.uint64(base)


def slice_bits(n_bytes: int, most: int) -> int:
    """How many leading hash bits cut the n-grams of ``n_bytes`` of text into slices of about ``most`` bytes of text."""
    return min(24, max(6, int(n_bytes // most).bit_length()))


def sliced(ascending: np.ndarray, bits: int) -> list[tuple[int, int, int]]:
    """``(slice, from, to)`` for each slice that sorted hashes fall into, by their leading ``bits``."""
    own, first = np.unique(ascending >> np.uint64(64 - bits), return_index=True)
    return list(zip(own.tolist(), first.tolist(), [*first[1:].tolist(), len(ascending)]))


def grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order that sorts ``keys``, and where each new key starts in it."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    return order, np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1]))) if len(keys) else np.empty(0, np.int64)


def binaries(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A binary column of the consecutive pieces of ``data`` that end at ``ends``."""
    offsets = np.concatenate(([0], ends)).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())]).cast(pa.binary())


def bitmap(rows: DataFrame, column: str) -> np.ndarray:
    """Which leading ``BITMAP`` bits the hashes of a column have: at most 2^(BITMAP - 6) words come to the driver."""
    place = F.shiftrightunsigned(column, 64 - BITMAP)
    bit = F.expr(f"shiftleft(1L, cast(shiftrightunsigned({column}, {64 - BITMAP}) & 63 as int))")
    found = rows.groupBy(F.shiftright(place, 6).alias("at")).agg(F.bit_or(bit).alias("bits")).toArrow()
    out = np.zeros(1 << (BITMAP - 6), np.int64)
    out[found["at"].to_numpy()] = found["bits"].to_numpy()
    return out.view(np.uint64)


def has(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether a hash may be in a bitmap: never no for one that is."""
    place = hashes >> np.uint64(64 - BITMAP)
    return (bits[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) > 0
