"""Sources mixed to target weights, with DataFrame functions only.

A source's share of all tokens is raised to an exponent between 0 (all sources alike) and 1 (as they are).
The exponent is bisected, four halvings in each pass over the table of sources, to the flattest mix that
keeps both targets: entropy of the weights at most ``entropy_share`` of its maximum, and no source repeated
more than ``repeats`` times as often as its tokens allow. The weights are then realised: a source's budget is
filled with whole passes over its documents and one partial pass. Each pass is a block permutation: documents
are dealt into blocks of about ``BLOCK_ROWS`` by a hash, a pass orders the blocks by one hash and the documents
of a block by another, and the partial pass ends where the budget does.

Blocks keep a hot source apart: running sums are taken inside blocks and over the table of blocks, never over
a whole source at once. Everything but the exponent's few numbers stays in Spark.

Without ``budget`` it is the least with which every source is used whole at least once.

Defined results: null text has no tokens; null is a source like any other, and so is the empty name; sources
without any token have weight 0 and are left out; rows without tokens stand where their hash puts them; repeated
rows are counted, and taken, as often as they come; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.shared import settle

BLOCK_ROWS = 4096
SEED = "mix-1"
WEIGHT_DIGITS = 6
_PARTS = 16
_PASSES = 8


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[^ \\x09-\\x0D]+")).cast("bigint")


def _hash(*parts: Column | str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(SEED), *[p if isinstance(p, Column) else F.lit(p) for p in parts]))


def exponent(sources: DataFrame, entropy_share: float, repeats: float, budget: int | None) -> float:
    """The least exponent that keeps both targets, or 1 where none does. ``sources``: one row each with ``share``."""
    n, least, most, total = sources.agg(
        F.count(F.lit(1)), F.min("share"), F.max("share"), F.sum("tokens")
    ).first()
    if n < 2:
        return 1.0
    log_share = F.ln("share")

    def kept(exponents: list[float]) -> list[bool]:
        columns = []
        for i, a in enumerate(exponents):
            raised = F.exp(log_share * a)
            columns += [F.sum(raised).alias(f"z{i}"), F.sum(raised * log_share).alias(f"e{i}")]
        row = sources.agg(*columns).first()
        out = []
        for i, a in enumerate(exponents):
            z = row[f"z{i}"]
            entropy = math.log(z) - a * row[f"e{i}"] / z
            # The rarest source is repeated most, the commonest least.
            times = (least / most) ** (a - 1) if budget is None else budget / total * least ** (a - 1) / z
            out.append(entropy <= entropy_share * math.log(n) and times <= repeats)
        return out

    low, high = 0.0, 1.0
    if kept([low])[0]:
        return low
    # Both targets are kept from some exponent on: each pass narrows it down to one of _PARTS parts.
    for _ in range(_PASSES):
        grid = [low + (high - low) * i / _PARTS for i in range(1, _PARTS)]
        fits = [*kept(grid), True]
        first = fits.index(True)
        low, high = low + (high - low) * first / _PARTS, low + (high - low) * (first + 1) / _PARTS
    return high


def weights(sources: DataFrame, power: float) -> DataFrame:
    """``sources`` with their normalised weight."""
    scale = sources.agg(F.sum(F.exp(F.ln("share") * power))).first()[0]
    return sources.withColumn("weight", F.exp(F.ln("share") * power) / (scale or 1.0))


def shown(weight: Column) -> Column:
    """A weight rounded for reading; one too small for that stays as it is. Budgets are never taken from it."""
    return F.when(weight < 10.0**-WEIGHT_DIGITS, weight).otherwise(F.round(weight, WEIGHT_DIGITS))


def mixed(
    docs: DataFrame, entropy_share: float = 0.97, repeats: float = 2.0, budget: int | None = None, tokens: Column | None = None,
    id_column: str = "doc_id", source_column: str = "source",
) -> DataFrame:
    """One row per use of a document: source, weight, pass, block, its order there, and the tokens before it in its pass.

    ``tokens``: a document's token count; words by default.
    """
    tokens = word_count(F.col("text")) if tokens is None else tokens
    named = F.coalesce(F.concat(F.lit("="), F.col(source_column)), F.lit(""))
    counted = settle(docs.select(F.col(id_column).alias("_id"), named.alias("_source"), F.col(source_column).alias("_name"), F.greatest(F.coalesce(tokens, F.lit(0)), F.lit(0)).cast("bigint").alias("n_tokens")), "mix")
    sums = counted.groupBy("_source").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("rows")).filter("tokens > 0")
    total = sums.agg(F.sum("tokens")).first()[0] or 0
    sources = settle(sums.withColumn("share", F.col("tokens") / F.lit(float(total or 1))), "sources")
    weighted = weights(sources, exponent(sources, entropy_share, repeats, budget))
    if budget is None:
        # Tokens per unit of weight at which the scarcest weight still covers its source.
        whole = weighted.agg(F.max(F.col("tokens") / F.col("weight"))).first()[0] or 0
        # A source that comes to its own size but for the error of a float is whole.
        tokens_ = F.lit(float(whole)) * F.col("weight")
        own = tokens_ + F.greatest(F.lit(1e-6), tokens_ * 1e-12)
    else:
        own = F.lit(budget) * F.col("weight")
    plan = weighted.withColumn("_budget", own.cast("bigint"))
    plan = plan.withColumn("_passes", F.floor(F.col("_budget") / F.col("tokens")))
    plan = plan.select(
        "_source", shown(F.col("weight")).alias("weight"), "_passes", (F.col("_budget") - F.col("_passes") * F.col("tokens")).alias("_rest"),
        F.ceil(F.col("rows") / BLOCK_ROWS).alias("_blocks"),
    )
    number = F.conv(F.substring(_hash("block", F.coalesce(F.col("_id").cast("string"), F.lit(""))), 1, 8), 16, 10).cast("bigint")
    dealt = counted.join(plan, "_source").withColumn("block", F.pmod(number, F.col("_blocks")))
    last = F.col("_passes") - F.when(F.col("_rest") > 0, 0).otherwise(1)
    used = dealt.filter(last >= 0).withColumn("pass", F.explode(F.sequence(F.lit(0), last.cast("int"))))
    used = used.withColumn("_order", _hash("row", F.col("pass").cast("string"), F.coalesce(F.col("_id").cast("string"), F.lit(""))))
    inside = Window.partitionBy("_source", "pass", "block").orderBy("_order", "_id", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    local = used.withColumn("_before", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    key = _hash("pass", F.col("pass").cast("string"), F.col("_source"), F.col("block").cast("string"))
    across = Window.partitionBy("_source", "pass").orderBy("_key", "block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = used.groupBy("_source", "pass", "block").agg(F.sum("n_tokens").alias("_sum")).withColumn("_key", key)
    blocks = blocks.select("_source", "pass", "block", F.coalesce(F.sum("_sum").over(across), F.lit(0)).alias("_start"))
    placed = local.join(blocks, ["_source", "pass", "block"]).withColumn("token_start", F.col("_start") + F.col("_before"))
    within = (F.col("pass") < F.col("_passes")) | (F.col("token_start") + F.col("n_tokens") <= F.col("_rest"))
    return placed.filter(within).select(
        F.col("_id").alias(id_column), F.col("_name").alias(source_column), "weight", "pass", "block", "token_start", "n_tokens"
    )


def remixed(docs: DataFrame, entropy_share: float = 0.97, repeats: float = 1.5, budget: int | None = None) -> DataFrame:
    """``docs`` with each document as often as the mix uses it."""
    uses = mixed(docs, entropy_share, repeats, budget).groupBy(F.col("doc_id").alias("_used")).agg(F.count(F.lit(1)).alias("_times"))
    # Rows that repeat an id are counted together and shared out again.
    rows = docs.groupBy(F.col("doc_id").alias("_of")).agg(F.count(F.lit(1)).alias("_rows"))
    times = uses.join(rows, F.col("_used").eqNullSafe(F.col("_of"))).select("_used", F.ceil(F.col("_times") / F.col("_rows")).cast("int").alias("_times"))
    taken = docs.join(times, docs["doc_id"].eqNullSafe(F.col("_used")))
    return taken.withColumn("_use", F.explode(F.sequence(F.lit(1), F.col("_times")))).select(*docs.columns)
