"""Matching blocks of two sequences, for the few pairs that cheaper bounds leave undecided.

The result is that of the standard library's ``SequenceMatcher`` without its junk rule. That walks
every pair of equal words again for each block it finds, which takes minutes on a chapter-length
pair; here runs of two or more equal words are found once and clipped as the search narrows, all runs of one
length in one step. Texts with too many runs to hold are first split at their longest one, which gives the same blocks.
"""

from __future__ import annotations

from collections.abc import Sequence
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bigram pairs held at once, 8 bytes each in half a dozen arrays.
MAX_RUN_PAIRS = 2_000_000
#: Pairs of items up to which the standard library is quicker than arrays: titles, not chapters.
FEW_PAIRS = 20_000


def _codes(a: Sequence[str], b: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    known: dict[str, int] = {}
    return tuple(np.fromiter((known.setdefault(w, len(known)) for w in s), np.int64, len(s)) for s in (a, b))


def _runs(a: np.ndarray, b: np.ndarray) -> np.ndarray | None:
    """Maximal runs of two or more equal items as rows (start in a, start in b, length)."""
    width = int(max(a.max(initial=0), b.max(initial=0))) + 1
    pairs_a, pairs_b = a[:-1] * width + a[1:], b[:-1] * width + b[1:]
    order = np.argsort(pairs_b, kind="stable")
    ranked = pairs_b[order]
    low, high = np.searchsorted(ranked, pairs_a, "left"), np.searchsorted(ranked, pairs_a, "right")
    counts = high - low
    if counts.sum() > MAX_RUN_PAIRS:
        return None
    at_a = np.repeat(np.arange(len(pairs_a)), counts)
    offset = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    at_b = order[np.repeat(low, counts) + offset]
    # Bigram matches that follow each other on a diagonal are one run.
    by_diagonal = np.lexsort((at_a, at_a - at_b))
    i, j = at_a[by_diagonal], at_b[by_diagonal]
    first = np.r_[True, (np.diff(i - j) != 0) | (np.diff(i) != 1)] if len(i) else np.zeros(0, bool)
    starts = np.flatnonzero(first)
    lengths = np.diff(np.r_[starts, len(i)]) + 1
    return np.stack([i[starts], j[starts], lengths], axis=1)


def _longest(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """The longest equal run, first in ``a``, then in ``b``: row by row, in memory for one row."""
    best = (0, 0, 0)
    row = np.zeros(len(b) + 1, np.int64)
    for i, code in enumerate(a):
        row[1:] = np.where(b == code, row[:-1] + 1, 0)
        size = int(row.max())
        if size > best[2]:
            best = (i + 1 - size, int(row.argmax()) - size, size)
    return best


def matching_blocks(a: Sequence[str], b: Sequence[str]) -> list[tuple[int, int, int]]:
    """(start in a, start in b, length) of each block, in order."""
    codes_a, codes_b = _codes(list(a), list(b))
    blocks: list[tuple[int, int, int]] = []
    todo = [(0, len(codes_a), 0, len(codes_b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        if a0 >= a1 or b0 >= b1:
            continue
        runs = _runs(codes_a[a0:a1], codes_b[b0:b1]) if a1 - a0 > 1 and b1 - b0 > 1 else np.zeros((0, 3), np.int64)
        if runs is None:
            # Too repetitive to list all its runs: split at the longest, until the parts are not.
            x, y, n = _longest(codes_a[a0:a1], codes_b[b0:b1])
            x, y = a0 + x, b0 + y
            blocks.append((x, y, n))
            todo += [(a0, x, b0, y), (x + n, a1, y + n, b1)]
        else:
            found, gaps = _from_runs(runs + np.array([a0, b0, 0]), a0, a1, b0, b1)
            blocks += found
            for gap in gaps:
                blocks += _singles(codes_a, codes_b, *gap)
    return sorted(blocks)


def _from_runs(runs: np.ndarray, a0: int, a1: int, b0: int, b1: int) -> tuple[list[tuple[int, int, int]], list[list[int]]]:
    """The blocks of two or more items, and the gaps between them as (a0, a1, b0, b1).

    The longest run wins its gap, the first of equals, and cuts it in two. Runs as long as the longest can only follow it
    in what is right of it, so those of one length are taken in one walk over all gaps, which lie in order on both sides.
    """
    blocks: list[tuple[int, int, int]] = []
    gaps = np.array([[a0, a1, b0, b1]], np.int64)
    i, j, size = runs.T
    while len(size):
        longest = int(size.max())
        best = np.flatnonzero(size == longest)
        best = best[np.lexsort((j[best], i[best]))]
        taken, x, y = [], -1, -1
        for p, q in zip(i[best].tolist(), j[best].tolist()):
            if p >= x and q >= y:
                taken.append((p, q, longest))
                x, y = p + longest, q + longest
        blocks += taken
        # A block cuts the gap it lies in: its start closes one, its end opens the next.
        at, to, _ = np.array(taken, np.int64).T
        gaps = np.stack([
            np.sort(np.r_[gaps[:, 0], at + longest]), np.sort(np.r_[gaps[:, 1], at]),
            np.sort(np.r_[gaps[:, 2], to + longest]), np.sort(np.r_[gaps[:, 3], to]),
        ], axis=1)
        gaps = gaps[(gaps[:, 0] < gaps[:, 1]) & (gaps[:, 2] < gaps[:, 3])]
        # What is left of a run lies in the gaps that it meets on both sides.
        low = np.maximum(np.searchsorted(gaps[:, 1], i, "right"), np.searchsorted(gaps[:, 3], j, "right"))
        high = np.minimum(np.searchsorted(gaps[:, 0], i + size, "left"), np.searchsorted(gaps[:, 2], j + size, "left"))
        count = np.maximum(high - low, 0)
        of = np.repeat(low, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        i, j, size = np.repeat(i, count), np.repeat(j, count), np.repeat(size, count)
        cut = np.maximum(np.maximum(gaps[of, 0] - i, gaps[of, 2] - j), 0)
        i, j, size = i + cut, j + cut, size - cut
        size = np.minimum(np.minimum(size, gaps[of, 1] - i), gaps[of, 3] - j)
        i, j, size = i[size > 1], j[size > 1], size[size > 1]
    return blocks, gaps.tolist()


def _singles(a: np.ndarray, b: np.ndarray, a0: int, a1: int, b0: int, b1: int) -> list[tuple[int, int, int]]:
    """The blocks of a gap without a run of two: each item in turn meets the first equal one that is left."""
    places: dict[int, list[int]] = {}
    for j in range(b1 - 1, b0 - 1, -1):
        places.setdefault(int(b[j]), []).append(j)
    blocks, at = [], b0
    for i in range(a0, a1):
        equal = places.get(int(a[i]), [])
        while equal and equal[-1] < at:
            equal.pop()
        if equal:
            blocks.append((i, equal[-1], 1))
            at = equal[-1] + 1
    return blocks


def ratio(a: Sequence[str], b: Sequence[str]) -> float:
    total = len(a) + len(b)
    if len(a) * len(b) <= FEW_PAIRS:
        return SequenceMatcher(None, a, b, autojunk=False).ratio()
    return 2.0 * sum(n for *_, n in matching_blocks(a, b)) / total if total else 1.0


@F.pandas_udf(T.DoubleType())
def exact_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratio of two word arrays (or two strings); null in, null out."""
    return pd.Series([None if x is None or y is None else ratio(x, y) for x, y in zip(a, b)], dtype="float64")


def similarity(a: Column, b: Column) -> Column:
    """Exact ratio of two arrays of words without spaces. Pairs of which one side stands whole in the other never leave the JVM."""
    both_empty, one_empty = (F.size(a) == 0) & (F.size(b) == 0), (F.size(a) == 0) | (F.size(b) == 0)

    def line(words: Column) -> Column:
        return F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))

    # The longest run is then all of the shorter side, and nothing of it is left to match.
    longer = F.size(a) >= F.size(b)
    inside = F.contains(line(F.when(longer, a).otherwise(b)), line(F.when(longer, b).otherwise(a)))
    decided = one_empty | inside
    exact = exact_ratio(F.when(~decided, a), F.when(~decided, b))
    by_size = F.try_divide(2.0 * F.least(F.size(a), F.size(b)), F.size(a) + F.size(b))
    return F.when(both_empty, 1.0).when(one_empty, 0.0).when(inside, by_size).otherwise(exact)
