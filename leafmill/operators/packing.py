"""Greedy packing of an ordered sequence into groups: a fold, run in parallel blocks.

A group is closed before an ``allowed`` item when the item is ``hard``, or when the group already
measures at least ``low`` and either the item is ``soft`` or the group measures ``high``. How a block
of items behaves depends only on the size of the group that is open when it starts, so each block
is first summed up as a small step function of that size; the functions of a key are chained in
order; then every block is packed knowing its true start.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def block_function(lengths, softs, hards, allowed, low: int, high: int):
    """A block as steps of the size that is open when it starts.

    Returns (first sizes of each step, size after the block, groups closed, whether the entering size
    is still part of the size after). Sizes over ``high`` behave like ``high``.
    """
    count = len(lengths)

    def closes(at: int, size: int) -> bool:
        return size > 0 and allowed[at] and (hards[at] or (size >= low and (softs[at] or size >= high)))

    # From an item that opens a group: where the next one opens, or the size left at the end.
    known: dict[int, tuple[int, int]] = {}

    def following(at: int) -> tuple[int, int]:
        size, k = 0, at
        while k < count and not closes(k, size):
            size += int(lengths[k])
            k += 1
        return k, size

    def outcome(at: int) -> tuple[int, int]:
        path, k = [], at
        while k < count and k not in known:
            nxt, size = following(k)
            path.append((k, nxt, size))
            k = nxt
        for start, nxt, size in reversed(path):
            known[start] = (size, 0) if nxt >= count else (known[nxt][0], known[nxt][1] + 1)
        return known[at]

    # The larger the entering size, the earlier its group closes.
    opens: list[tuple[int, int]] = []
    smallest, before = high + 1, 0
    for at in range(count):
        if allowed[at]:
            needed = 1 if hards[at] else max(1, (low if softs[at] else max(low, high)) - before)
            if needed < smallest:
                opens.append((needed, at))
                smallest = needed
            if smallest == 1:
                break
        before += int(lengths[at])
    total = int(sum(int(n) for n in lengths))
    after, closed = outcome(0)
    steps = [(0, after, closed, False)]
    if smallest > 1:
        steps.append((1, total, 0, True))
    for size, at in reversed(opens):
        after, closed = outcome(at)
        steps.append((size, after, closed + 1, False))
    return tuple(zip(*steps))


def _table(columns: list[tuple[str, pa.DataType, list]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, t) for _, t, v in columns], [n for n, _, _ in columns])


def pack(
    df: DataFrame, keys: Sequence[str], block: Column, order: Sequence[str], *,
    length: Column, soft: Column, hard: Column, allowed: Column, low: int, high: int, name: str = "group_no",
) -> DataFrame:
    """``df`` with the number (from 0) of each row's group within its key.

    Each step reads its rows in order as they come, sorted by Spark: one block, or nothing but a size
    and a number, is held at a time.
    """
    items = df.withColumns({
        "_block": block, "_length": length.cast("bigint"), "_soft": F.coalesce(soft, F.lit(False)),
        "_hard": F.coalesce(hard, F.lit(False)), "_allowed": F.coalesce(allowed, F.lit(False)),
    })
    group = [*keys, "_block"]
    fields = {f.name: f for f in items.schema.fields}
    steps = T.ArrayType(T.LongType())
    function_schema = T.StructType([fields[c] for c in group] + [
        T.StructField("_from", steps), T.StructField("_after", steps), T.StructField("_closed", steps),
        T.StructField("_adds", T.ArrayType(T.BooleanType())),
    ])
    measures = ["_length", "_soft", "_hard", "_allowed"]
    width = len(group)

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types, current, held = None, None, [[], [], [], []]

        def summed() -> pa.RecordBatch:
            values = [*current, *[list(x) for x in block_function(*held, low, high)]]
            kinds = [*types, pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.bool_())]
            return _table([(n, t, [v]) for n, t, v in zip(function_schema.names, kinds, values)])

        out = []
        for batch in batches:
            types = batch.schema.types[:width]
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if row[:width] != current:
                    if current is not None:
                        out.append(summed())
                    current, held = row[:width], [[], [], [], []]
                for values, value in zip(held, row[width:]):
                    values.append(value)
            if out:
                yield pa.Table.from_batches(out).combine_chunks().to_batches()[0]
                out = []
        if current is not None:
            yield summed()

    slim = items.repartition(*group).sortWithinPartitions(*group, *order).select(*group, *measures)
    functions = slim.mapInArrow(summarise, function_schema)

    start_schema = T.StructType(
        [fields[c] for c in group] + [T.StructField("_size", T.LongType()), T.StructField("_number", T.LongType())]
    )

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, size, number = None, 0, 0
        for batch in batches:
            sizes, numbers = [], []
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if row[: width - 1] != current:
                    current, size, number = row[: width - 1], 0, 0
                sizes.append(size)
                numbers.append(number)
                first, after, closed, adds = row[width:]
                at = bisect_right(first, min(size, high)) - 1
                size, number = (after[at] + size if adds[at] else after[at]), number + closed[at]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:width], pa.array(sizes, pa.int64()), pa.array(numbers, pa.int64())], start_schema.names
            )

    # One small row per block: the chain of a key stays far smaller than the key.
    starts = functions.repartition(*keys).sortWithinPartitions(*group).mapInArrow(chain, start_schema)
    located = items.join(
        starts.select(*[F.col(c).alias(f"_s_{c}") for c in group], "_size", "_number"),
        [F.col(c).eqNullSafe(F.col(f"_s_{c}")) for c in group],
    ).select(*items.columns, "_size", "_number")

    kept = len(df.columns)
    out_schema = T.StructType([*df.schema.fields, T.StructField(name, T.LongType())])
    needed = [*group, *measures, "_size", "_number"]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, size, number = None, 0, 0
        for batch in batches:
            groups = []
            for row in zip(*[batch.column(c).to_pylist() for c in needed]):
                if row[:width] != current:
                    current, size, number = row[:width], row[-2], row[-1]
                item, is_soft, is_hard, may = row[width : width + 4]
                if size > 0 and may and (is_hard or (size >= low and (is_soft or size >= high))):
                    size, number = 0, number + 1
                size += item
                groups.append(number)
            yield pa.RecordBatch.from_arrays([*batch.columns[:kept], pa.array(groups, pa.int64())], out_schema.names)

    ordered = located.repartition(*group).sortWithinPartitions(*group, *order)
    return ordered.mapInArrow(assign, out_schema)
