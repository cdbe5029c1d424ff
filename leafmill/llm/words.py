"""Words and hashes of whole Arrow text columns, without a Python object per word.

A word is a maximal run of bytes outside ``\\x20 \\x09-\\x0D``. All functions work on slices of a column
(``slices``) so that a task holds a few megabytes of text, or one document where that is longer.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20
_SLAB = 1 << 18
_U = np.uint64
_ODD = (_U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F))
_INVERSE = _U(pow(int(_ODD[0]), -1, 1 << 64))

_generator = np.random.Generator(np.random.PCG64(20))
#: A random odd number per byte; white space counts nothing.
_BYTE = _generator.integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTE[SPACE] = 0
#: Upper-case A-Z to lower case, all else as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


@dataclass
class Words:
    """Word ``w`` is ``data[start[w]:end[w]]``; document ``i`` has the words ``first[i]`` up to ``first[i + 1]``."""

    data: np.ndarray
    first: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column and the n + 1 offsets of its values; null counts as empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return whole[ends[0] : ends[-1]], ends - ends[0]


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most ``most`` bytes each, or one row where that is longer."""
    size = np.concatenate(([0], np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False))))
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(size, size[at] + most, "right")) - 1)
        yield at, min(to, len(column))
        at = to


def mixed(x: np.ndarray) -> np.ndarray:
    """A well mixed 64-bit value of each 64-bit value."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def words(column: pa.Array, lower: bool = False, separators: np.ndarray = SPACE) -> Words:
    """``separators``: which bytes stand between words; white space must be among them."""
    data, offsets = text_bytes(column)
    if lower:
        data = LOWER[data]
    if separators is not SPACE:
        data = np.where(separators[data], np.uint8(0x20), data)
    inside = ~SPACE[data]
    opens, closes = inside.copy(), inside.copy()
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    opens[1:] &= ~inside[:-1] | cut[1:-1]
    closes[:-1] &= ~inside[1:] | cut[1:-1]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return Words(data, np.searchsorted(start, offsets), start, end, _hashes(data, start))


@cache
def _weights() -> tuple[np.ndarray, np.ndarray]:
    return powers(_ODD[0], _SLAB), powers(_INVERSE, _SLAB)


def _hashes(data: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The bytes of a word are weighed with rising powers of an odd number: those of their places in the slab, divided by that of the word's start."""
    out = np.empty(len(start), np.uint64)
    weight, inverse = _weights()
    at = 0
    while at < len(start):
        to = max(at + 1, int(np.searchsorted(start, start[at] + _SLAB)) - 1)
        low, high = start[at], start[to] if to < len(start) else len(data)
        own = start[at:to] - low
        if high - low > _SLAB:
            weight = powers(_ODD[0], int(high - low))
        out[at:to] = np.add.reduceat(_BYTE[data[low:high]] * weight[: high - low], own) * inverse[own]
        at = to
    return mixed(out)


def grams(hashes: np.ndarray, n: int, second: bool = False) -> np.ndarray:
    """A hash of each ``n`` consecutive word hashes; ``second`` gives an independent one."""
    count = max(0, len(hashes) - n + 1)
    out = np.zeros(count, np.uint64)
    source = mixed(hashes ^ _ODD[1]) if second else hashes
    for j in range(n):
        out = out * _ODD[second] + source[j : j + count]
    return mixed(out)


def inner(first: np.ndarray, n: int, count: int) -> np.ndarray:
    """Which of ``count`` positions start ``n`` consecutive words of one document."""
    owner = np.searchsorted(first, np.arange(count), "right") - 1
    return np.arange(count) + n <= first[owner + 1]
