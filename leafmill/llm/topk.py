"""Exact top-k by inner product, pruned with segment statistics from coarse to fine.

For integer vectors q and c the squared distance is |q|^2 + |c|^2 - 2 qc, so a lower bound on the distance is an
upper bound on the score. With both cut into the same segments of l components, means m and deviations s,

    distance^2 >= sum of l * ((m_q - m_c)^2 + (s_q - s_c)^2),    qc <= sum of l * (m_q m_c + s_q s_c)

A task keeps each query's k best so far. A batch of candidates is bounded with ``LEVELS`` segments, few first;
only pairs whose bound reaches the query's k-th score go on to the next level, and what is left is scored
exactly. Bounds are rounded up by more than their arithmetic error, ties are kept, so nothing is lost.

Queries are taken in blocks of about ``QUERY_BLOCK`` (a broadcast of some megabytes), each against one scan of all
candidates where they lie; only k rows per query and task are shuffled, to the final ranking. More queries mean
more scans, as they must.

Defined results: vectors that are null, or hold a null or non-finite component, and rows without an id take no
part; vectors of different lengths are not compared; rows that repeat an id and score count once; a query's own id
is no candidate; ties go to the smaller id; fewer candidates than k give fewer rows; an empty table gives none.
Scores are exact while they fit 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

QUERY_BLOCK = 4096
LEVELS = (4, 16)
SCALE = 256
_EXACT = 2.0**53


def whole_numbers(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """``vec_id, v``: floor(SCALE * component) of every vector that takes part."""
    v = F.col(vector_column)
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    fit = vectors.filter(v.isNotNull() & F.col(id_column).isNotNull() & ~odd)
    return fit.select(F.col(id_column).cast("bigint").alias("vec_id"), F.transform(v, lambda x: F.floor(x.cast("double") * SCALE).cast("bigint")).alias("v"))


def statistics(v: np.ndarray, segments: int) -> np.ndarray:
    """Rows whose inner products bound those of ``v`` from above."""
    parts = [p for p in np.array_split(np.arange(v.shape[1]), segments) if len(p)]
    columns = [np.sqrt(len(p)) * f(v[:, p], axis=1) for p in parts for f in (np.mean, np.std)]
    return np.stack(columns, axis=1) if columns else np.zeros((len(v), 0))


class Best:
    """Each query's k best candidates so far, of vectors of one length."""

    def __init__(self, ids: np.ndarray, v: np.ndarray, k: int) -> None:
        self.ids, self.v, self.k = ids, v, k
        self.wide = v.astype(np.float64)
        self.levels = [statistics(self.wide, n) for n in LEVELS]
        self.norm = np.sqrt((self.wide**2).sum(1))
        self.query, self.candidate, self.score = (np.empty(0, np.int64) for _ in range(3))
        self.least = np.full(len(ids), -np.inf)

    def see(self, ids: np.ndarray, v: np.ndarray) -> None:
        wide = v.astype(np.float64)
        # Far above what rounding can take off a bound.
        slack = 1e-9 * self.norm[:, None] * np.sqrt((wide**2).sum(1))[None, :] + 1e-6
        open_ = self.ids[:, None] != ids[None, :]
        for n, own in zip(LEVELS, self.levels):
            open_ &= own @ statistics(wide, n).T + slack >= self.least[:, None]
        q, c = np.nonzero(open_)
        if not len(q):
            return
        peak = self.norm.max(initial=0) * np.sqrt((wide**2).sum(1)).max(initial=0)
        if len(q) > open_.size // 8 and peak < _EXACT:
            score = (self.wide @ wide.T)[q, c].astype(np.int64)
        else:
            score = np.concatenate([np.einsum("ij,ij->i", self.v[q[i : i + 65536]], v[c[i : i + 65536]]) for i in range(0, len(q), 65536)])
        good = score >= self.least[q]
        self._keep(q[good], ids[c[good]], score[good])

    def _keep(self, q: np.ndarray, c: np.ndarray, score: np.ndarray) -> None:
        q, c, score = np.concatenate((self.query, q)), np.concatenate((self.candidate, c)), np.concatenate((self.score, score))
        order = np.lexsort((c, -score, q))
        q, c, score = q[order], c[order], score[order]
        fresh = np.concatenate(([True], (np.diff(q) != 0) | (np.diff(c) != 0) | (np.diff(score) != 0)))[: len(q)]
        q, c, score = q[fresh], c[fresh], score[fresh]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        top = rank < self.k
        self.query, self.candidate, self.score = q[top], c[top], score[top]
        full = rank[top] == self.k - 1
        self.least[self.query[full]] = self.score[full]


def _by_length(ids: np.ndarray, vectors: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    lengths = vectors.value_lengths().to_numpy(zero_copy_only=False)
    for n in np.unique(lengths):
        own = np.flatnonzero(lengths == n)
        yield int(n), ids[own], vectors.take(pa.array(own)).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(own), n)


def top_k(vectors: DataFrame, k: int, is_query: Column, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the k best other rows of each row for which ``is_query`` (on ``vec_id``) holds."""
    spark = vectors.sparkSession
    rows = whole_numbers(vectors, id_column, vector_column)
    queries = rows.filter(is_query)
    n_blocks = max(1, -(-queries.count() // QUERY_BLOCK))

    def scanned(block) -> DataFrame:
        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = {n: Best(ids, v, k) for n, ids, v in block.value}
            for batch in batches:
                for n, ids, v in _by_length(batch["vec_id"].to_numpy(), batch["v"]):
                    if n in own:
                        own[n].see(ids, v)
            for best in own.values():
                yield pa.record_batch([pa.array(best.ids[best.query]), pa.array(best.candidate), pa.array(best.score)], ["query_id", "vec_id", "score"])

        return rows.mapInArrow(scan, "query_id bigint, vec_id bigint, score bigint")

    parts = []
    for number in range(n_blocks):
        own = queries.filter(F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)) == number).toArrow().combine_chunks()
        lists = own["v"].combine_chunks() if isinstance(own["v"], pa.ChunkedArray) else own["v"]
        groups = []
        for n, ids, v in _by_length(own["vec_id"].to_numpy(), lists) if len(own) else ():
            # A query row that comes twice is one query.
            _, once = np.unique(np.column_stack((ids, v)), axis=0, return_index=True)
            groups.append((n, ids[once], v[once]))
        parts.append(scanned(spark.sparkContext.broadcast(groups)))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    # A candidate that comes twice counts once.
    found = reduce(DataFrame.unionAll, parts).distinct()
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
