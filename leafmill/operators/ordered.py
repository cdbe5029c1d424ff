"""Order-dependent columns that stay parallel when one key holds a large share of the rows.

A plain window sends a whole key to one task. Here the rows of a key are cut into blocks by a
value of the ordering itself (for example ``floor(pos / 4096)``), each block is scanned on its
own, and a table with one row per (key, block) carries the running value across blocks. The
result is the same as the plain window; the largest group any task sees is one block, or the
block table of one key.

``block`` and ``order`` are lists of columns that are read ascending: first by ``block``, then by
``order``. Negate a number to read it descending.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.shared import settle  # noqa: F401 - part of this module's interface

BLOCK_ROWS = 4096


def block_of(position: Column | str, rows: int = BLOCK_ROWS) -> Column:
    """The block number of a dense or nearly dense integer position."""
    position = F.col(position) if isinstance(position, str) else position
    return F.floor(position / F.lit(rows)).cast("bigint")


@dataclass(frozen=True)
class Running:
    """One running column: ``kind`` over the rows before (and, if inclusive, at) each row.

    ``sum``, ``count``, ``min``, ``max``; ``last`` is the last non-null value; ``lag`` is the
    previous row's value, null or not.
    """

    kind: str
    value: Column | None = None
    inclusive: bool = True


def _local(spec: Running, window) -> Column:
    if spec.kind in ("sum", "count"):
        return F.coalesce(F.sum(spec.value).over(window), F.lit(0))
    if spec.kind in ("last", "lag"):
        return F.last(spec.value, ignorenulls=True).over(window)
    return getattr(F, spec.kind)(spec.value).over(window)


def _total(spec: Running, order: Sequence[Column]) -> Column:
    if spec.kind in ("sum", "count"):
        return F.sum(spec.value)
    if spec.kind in ("last", "lag"):
        return F.max_by(spec.value, F.when(spec.value.isNotNull(), F.struct(*order)))
    return getattr(F, spec.kind)(spec.value)


def _carry(spec: Running, total: Column, window) -> Column:
    if spec.kind in ("last", "lag"):
        return F.last(total, ignorenulls=True).over(window)
    return getattr(F, "sum" if spec.kind == "count" else spec.kind)(total).over(window)


def _merge(spec: Running, local: Column, carry: Column) -> Column:
    if spec.kind in ("sum", "count"):
        return local + F.coalesce(carry, F.lit(0))
    if spec.kind == "min":
        return F.least(local, carry)
    if spec.kind == "max":
        return F.greatest(local, carry)
    merged = F.coalesce(local, carry)
    return merged["v"] if spec.kind == "lag" else merged


def running(
    df: DataFrame,
    keys: Sequence[str],
    block: Sequence[Column],
    order: Sequence[Column],
    columns: Mapping[str, Running],
) -> DataFrame:
    """``df`` with one more column per entry of ``columns``."""
    specs = {}
    for name, spec in columns.items():
        value = F.lit(1).cast("bigint") if spec.kind == "count" else spec.value
        if spec.kind == "lag":
            specs[name] = Running("lag", F.struct(value.alias("v")), False)
        else:
            specs[name] = Running(spec.kind, value, spec.inclusive)

    blocks = [f"_block{i}" for i in range(len(block))]
    rows = df.withColumns(dict(zip(blocks, block)))
    group = [*keys, *blocks]
    inside = Window.partitionBy(*group).orderBy(*[o.asc_nulls_first() for o in order])
    upto = {True: inside.rowsBetween(Window.unboundedPreceding, 0),
            False: inside.rowsBetween(Window.unboundedPreceding, -1)}
    local = rows.withColumns({f"_local_{n}": _local(s, upto[s.inclusive]) for n, s in specs.items()})

    totals = rows.groupBy(*group).agg(*[_total(s, order).alias(f"_total_{n}") for n, s in specs.items()])
    across = (
        Window.partitionBy(*keys)
        .orderBy(*[F.col(b).asc_nulls_first() for b in blocks])
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    carry = totals.select(
        *[F.col(g).alias(f"_c_{g}") for g in group],
        *[_carry(s, F.col(f"_total_{n}"), across).alias(f"_carry_{n}") for n, s in specs.items()],
    )
    same = reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"_c_{g}")) for g in group])
    joined = local.join(carry, same, "left")
    merged = joined.withColumns(
        {n: _merge(s, F.col(f"_local_{n}"), F.col(f"_carry_{n}")) for n, s in specs.items()}
    )
    return merged.select(*df.columns, *specs)


def number_rows(
    df: DataFrame, keys: Sequence[str], block: Sequence[Column], order: Sequence[Column], name: str
) -> DataFrame:
    """Row numbers from 1 per key."""
    return running(df, keys, block, order, {name: Running("count")})


def number_ranged(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str) -> DataFrame:
    """Row numbers from 1 per key in an order that has no natural blocks, such as that of titles.

    Rows are dealt out by ranges of key and order, so a hot key covers many ranges of about equal size; a range
    is a block. The table is settled: a range must not move between two reads.
    """
    ranged = df.repartitionByRange(*[F.col(k) for k in keys], *order).withColumn("_range", F.spark_partition_id())
    return number_rows(settle(ranged, "ranges"), keys, [F.col("_range")], order, name).select(*df.columns, name)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key. A map-side combined aggregate, so a hot key costs one row per task."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_best"))
    return best.select(*keys, "_best.*").select(*df.columns)


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, name: str = "rank") -> DataFrame:
    """The first ``k`` rows of each key with their rank: Spark limits each group before the shuffle."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(window)).filter(F.col(name) <= k)


def heavy_keys(df: DataFrame, key: str, share: float) -> list:
    """The values of a key that more than ``share`` of the rows have: fewer than ``1 / share`` of them, whatever the size."""
    total = df.count()
    counts = df.groupBy(key).agg(F.count("*").alias("_n")).filter(F.col("_n") > total * share)
    return [r[key] for r in counts.collect() if r[key] is not None]


def salted_left_join(left: DataFrame, right: DataFrame, key: str, share: float = 1 / 256, salts: int = 64) -> DataFrame:
    """``left`` joined to the rows of ``right`` with its key, the work on heavy keys dealt out by a hash of the left row.

    Only the right rows of heavy keys are repeated; without a heavy key this is a plain join. ``left`` is best a written table: it is read three times.
    """
    heavy = heavy_keys(left, key, share)
    if not heavy:
        return left.join(right, key, "left")
    hot = F.coalesce(F.col(key).isin(heavy), F.lit(False))
    dealt = left.withColumn("_salt", F.when(hot, F.pmod(F.xxhash64(*left.columns), F.lit(salts)).cast("int")).otherwise(0))
    spread = right.withColumn("_salt", F.explode(F.when(hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
    return dealt.join(spread, [key, "_salt"], "left").drop("_salt")


def with_group_flag(df: DataFrame, keys: Sequence[str], flag: Column, name: str) -> DataFrame:
    """Whether ``flag`` holds for any row of the key, as a combined aggregate joined back."""
    groups = df.groupBy(*keys).agg(F.bool_or(flag).alias(name))
    renamed = groups.select(*[F.col(k).alias(f"_g_{k}") for k in keys], name)
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_g_{k}")) for k in keys])
    return df.join(renamed, same, "left").drop(*[f"_g_{k}" for k in keys])


def islands(
    df: DataFrame, keys: Sequence[str], block: Column, order: Sequence[Column], value: Column, name: str,
    cut: Callable[[Column, Column], Column] | None = None,
) -> DataFrame:
    """The number (from 0) of each row's run of consecutive rows.

    A run ends where ``cut(previous value, value)`` holds; by default where the values differ, null
    being a value like any other. With a ``cut`` of its own, rows with a null value belong to the run
    before them. One pass like ``running``: cuts are counted inside each block, and the block table
    says whether a block opens with one.
    """
    if cut is None:
        value, cut = F.struct(value.alias("v")), lambda before, now: ~before["v"].eqNullSafe(now["v"])
    rows = df.withColumns({"_block": block, "_v": value})
    group = [*keys, "_block"]
    now = F.col("_v")
    inside = Window.partitionBy(*group).orderBy(*order)
    marked = rows.withColumn("_before", F.last("_v", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, -1)))
    flag = now.isNotNull() & F.col("_before").isNotNull() & F.coalesce(cut(F.col("_before"), now), F.lit(False))
    flagged = marked.withColumn("_cut", flag.cast("bigint"))
    local = flagged.withColumn("_local", F.sum("_cut").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    # A block opens with its first valued row: rows before that one stay in the run that came in.
    seen = F.count("_v").over(inside.rowsBetween(Window.unboundedPreceding, 0)) > 0
    local = local.withColumn("_seen", seen)
    spot = F.when(now.isNotNull(), F.struct(*order))
    totals = flagged.groupBy(*group).agg(
        F.min_by("_v", spot).alias("_head"), F.max_by("_v", spot).alias("_tail"), F.sum("_cut").alias("_cuts")
    )
    across = Window.partitionBy(*keys).orderBy("_block")
    tail = F.last("_tail", ignorenulls=True).over(across.rowsBetween(Window.unboundedPreceding, -1))
    steps = totals.withColumn("_came", tail)
    opens = F.col("_came").isNotNull() & F.col("_head").isNotNull() & F.coalesce(cut(F.col("_came"), F.col("_head")), F.lit(False))
    counted = steps.withColumn("_opens", opens.cast("bigint"))
    before = F.coalesce(F.sum(F.col("_cuts") + F.col("_opens")).over(across.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    carry = counted.select(*[F.col(g).alias(f"_c_{g}") for g in group], before.alias("_carry"), "_opens")
    same = reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"_c_{g}")) for g in group])
    joined = local.join(carry, same, "left")
    number = F.col("_local") + F.col("_carry") + F.when(F.col("_seen"), F.col("_opens")).otherwise(0)
    return joined.select(*df.columns, number.alias(name))
