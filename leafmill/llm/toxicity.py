"""Toxicity by two class-conditional Kneser-Ney models, one of toxic and one of ordinary texts.

Expressions are lower-cased words. A word's lower order is its stem (first ``STEM`` bytes): as in
Kneser-Ney smoothing, stems are counted by the number of different words they continue to, not by
occurrences. For class c, with word counts n, word kinds per stem m, kinds per stem in either class k, and
the discounts D and E of each order (Kneser-Ney's n1 / (n1 + 2 n2), of the words or stems counted once and twice),

    P_c(w) = (n_c(w) - D_c) / N_c + left * ((m_c(stem) - E_c)+ / M_c + left' * shared(stem)) / k(stem)

where ``shared`` counts both classes' kinds together and the masses left over by the discounts are the
same for both classes (the larger of the two). So an expression that is rare in one class falls back to its
stem, one that neither class knows falls back to the shared counts, and there the two models agree: it says nothing.

A text's evidence is its length-normalised log-likelihood ratio, over the whole text and over its
strongest 1, 3 and 10 expressions (an insult is as bad in a long text). A logistic calibration weighs them.

Counts cover every word of every labelled row outside the held-out fold, one row per word (by a 64-bit hash) in
a table that grows with the corpus, and one per stem in another. The commonest ``HEAD`` words and stems at most
are broadcast with their ratios, and a bitmap of fixed size that says of any other word whether it may be in the table; the
words that may be are joined to the tables by shuffle, so nothing is dropped or shared between words. Ratios are whole numbers of 1 / ``UNIT``, so sums do not depend on their order.
Fold 4 of 5 sets the calibration: it is scored by the counts of folds 1 to 3, at most ``CALIBRATION_ROWS`` rows of
it; final scores use the counts of 1 to 4.

Labels are broadcast up to ``BROADCAST_LABELS`` rows (16 bytes each), else joined by shuffle.

Defined results: null text is empty; a text without words gets the score of no evidence; a null id is not
labelled and in no fold; several labels of one id count as the largest, null labels not at all; repeated rows
get equal scores; without toxic or without ordinary labels the score is the smoothed share of toxic labels;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm.blobs import bitmap, has
from leafmill.llm.keys import text_key, with_keys
from leafmill.llm.words import SPACE, slices, words
from leafmill.shared import settle

STEM = 5
HEAD = 1 << 20
UNIT = 1 << 20
PEAKS = (1, 3, 10)
FOLDS = 5
CALIBRATION_ROWS = 20_000
BROADCAST_LABELS = 2_000_000
#: Word counts of each model, ordinary and toxic: of folds 1 to 3, and of all four.
MODELS = {"early": ("k0", "k1"), "full": ("k0 + k2", "k1 + k3")}

#: Every ASCII byte that is no letter or digit stands between words.
BREAKS = SPACE.copy()
BREAKS[[b for b in range(128) if not chr(b).isalnum()]] = True


def expressions(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and stem of each word of a text column, and the first word of each text."""
    found = words(pc.utf8_lower(column), separators=BREAKS)
    stem = np.zeros(len(found.start), np.int64)
    size = len(found.data)
    for j in range(STEM):
        at = found.start + j
        byte = found.data[np.minimum(at, size - 1)] if size else found.data
        stem |= np.where(at < found.end, byte.astype(np.int64), 0) << (8 * j)
    return found.hash.view(np.int64), stem, found.first


@dataclass
class Order:
    """What one order of one class comes to: the sum of its counts, how many there are, and how many are 1 and 2."""

    total: int
    kinds: int
    once: int
    twice: int

    @property
    def discount(self) -> float:
        return (self.once + 0.5) / (self.once + 2 * self.twice + 1)

    @property
    def left(self) -> float:
        return self.discount * self.kinds / self.total if self.total else 1.0

    def kept(self, count: str) -> Column:
        return F.greatest(F.col(count) - F.lit(self.discount), F.lit(0.0)) / F.lit(float(max(self.total, 1)))


def orders(table: DataFrame, columns: list[str]) -> dict[str, Order]:
    sums = [[F.sum(c), F.count_if(F.col(c) > 0), F.count_if(F.col(c) == 1), F.count_if(F.col(c) == 2)] for c in columns]
    row = table.agg(*[x for own in sums for x in own]).first()
    return {c: Order(*[row[4 * i + j] or 0 for j in range(4)]) for i, c in enumerate(columns)}


def word_counts(rows: DataFrame) -> DataFrame:
    """One row per word: hash ``h``, stem ``s``, and its counts in four kinds of rows: ordinary and toxic of folds 1 to 3, then of fold 4."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = (batch["_toxic"].to_numpy() + 2 * (batch["_fold"].to_numpy() == FOLDS - 1)).astype(np.int64)
            for at, to in slices(batch["_text"]):
                h, s, first = expressions(batch["_text"].slice(at, to - at))
                own, place, inverse = np.unique(h, return_index=True, return_inverse=True)
                counts = np.bincount(4 * inverse + np.repeat(kinds[at:to], np.diff(first)), minlength=4 * len(own)).reshape(-1, 4)
                yield pa.record_batch([pa.array(own), pa.array(s[place]), *[pa.array(counts[:, k].astype(np.int64)) for k in range(4)]], ["h", "s", "k0", "k1", "k2", "k3"])

    found = rows.mapInArrow(scan, "h bigint, s bigint, k0 bigint, k1 bigint, k2 bigint, k3 bigint")
    return found.groupBy("h", "s").agg(*[F.sum(f"k{k}").alias(f"k{k}") for k in range(4)])


def log_ratios(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """log P_toxic - log P_ordinary by each model, of every word (``h, s, early, full, n``) and of unknown words of every stem (``s, early, full, n``)."""
    sides = [f"{model}{c}" for model in MODELS for c in range(2)]
    counts = counts.select("h", "s", *[F.expr(x).alias(f"{model}{c}") for model, pair in MODELS.items() for c, x in enumerate(pair)])
    stems = counts.groupBy("s").agg(
        *[F.count_if(F.col(x) > 0).alias(f"m_{x}") for x in sides],
        *[F.count_if(F.expr(f"{model}0 + {model}1 > 0")).alias(f"k_{model}") for model in MODELS],
    )
    stems = settle(stems, "stems", free=True)
    high, low = orders(counts, sides), orders(stems, [f"m_{x}" for x in sides] + [f"k_{model}" for model in MODELS])
    for model in MODELS:
        kinds = low[f"k_{model}"]
        left = max(low[f"m_{model}{c}"].left for c in range(2))
        shared = (F.col(f"k_{model}") + 0.5) / F.lit(kinds.total + 0.5 * (kinds.kinds + 1))
        for c in range(2):
            stems = stems.withColumn(f"low_{model}{c}", low[f"m_{model}{c}"].kept(f"m_{model}{c}") + F.lit(left) * shared)
    known = counts.join(stems, "s")
    for model in MODELS:
        left = max(high[f"{model}{c}"].left for c in range(2))
        ordinary, toxic = [high[f"{model}{c}"].kept(f"{model}{c}") + F.lit(left) * F.col(f"low_{model}{c}") / F.greatest(F.col(f"k_{model}"), F.lit(1)) for c in range(2)]
        known = known.withColumn(model, F.round(F.ln(toxic / ordinary) * UNIT).cast("bigint"))
        stems = stems.withColumn(model, F.round(F.ln(F.col(f"low_{model}1") / F.col(f"low_{model}0")) * UNIT).cast("bigint"))
    return known.select("h", "s", *MODELS, F.expr("full0 + full1").alias("n")), stems.select("s", *MODELS, F.col("k_full").alias("n"))


def head(table: DataFrame, key: str) -> tuple[dict[str, np.ndarray], bool]:
    """The commonest rows of a table by ``n``, about ``HEAD`` at most and sorted by ``key``, and whether these are all.

    Of the rows just too rare, those that come first by a hash fill it up: half of all words may occur once.
    """
    power = F.floor(F.log2(F.col("n") + 0.5))
    sizes = sorted(table.groupBy(power.alias("power")).count().collect(), reverse=True)
    least, taken, rare = None, 0, None
    for size in sizes:
        if taken + size["count"] > HEAD:
            part = int(0.99 * (HEAD - taken) / size["count"] * (1 << 20))
            rare = (power == size["power"]) & (F.pmod(F.xxhash64(key), F.lit(1 << 20)) < part)
            break
        least, taken = size["power"], taken + size["count"]
    wanted = F.lit(False) if least is None else power >= least
    common = table.filter(wanted if rare is None else wanted | rare)
    rows = common.select(key, *MODELS).toArrow()
    place = np.argsort(rows[key].to_numpy())
    return {c: rows[c].to_numpy()[place] for c in rows.column_names}, taken == sum(s["count"] for s in sizes)


def _looked_up(rows: dict[str, np.ndarray], key: str, model: str, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ratio of each wanted key, or 0, and whether it is there."""
    keys = rows[key]
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    there = keys[at] == wanted
    return np.where(there, rows[model][at], 0), there


@dataclass
class Lexicon:
    words: DataFrame
    stems: DataFrame
    #: Broadcast rows of each and the bitmap of all words, and whether the rows are all of the table.
    common: object
    whole: tuple[bool, bool]


def lexicon_of(counts: DataFrame) -> Lexicon:
    known, stems = (settle(x, "ratios", free=True) for x in log_ratios(counts))
    (common, all_words), (common_stems, all_stems) = head(known, "h"), head(stems, "s")
    there = None if all_words else bitmap(known, "h")
    return Lexicon(known, stems, counts.sparkSession.sparkContext.broadcast((common, common_stems, there)), (all_words, all_stems))


def _strongest(values: np.ndarray) -> list[int]:
    most = max(PEAKS)
    return np.sort(np.partition(values, len(values) - most)[-most:] if len(values) > most else values)[::-1].tolist()


def described(rows: DataFrame, model: str, lexicon: Lexicon) -> DataFrame:
    """``rows`` with three columns for ``_text``: its number of words ``n``, the ``total`` of their ratios, and the strongest (``top``)."""
    carried = [f for f in rows.schema.fields if f.name != "_text"]
    common, (all_words, all_stems) = lexicon.common, lexicon.whole
    # What an unknown word is worth is known here if all stems are: then the words left over need not meet the table of stems.
    names = [*[f.name for f in carried], "n", "total", "top", "h", "s", "times", *["low"] * all_stems]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, stems, all_known = common.value
        for batch in batches:
            for at, to in slices(batch["_text"]):
                part = batch.slice(at, to - at)
                h, s, first = expressions(part["_text"])
                own, place, inverse = np.unique(h, return_index=True, return_inverse=True)
                value, sure = _looked_up(known, "h", model, own)
                unknown = ~sure if all_words else ~sure & ~has(all_known, own.view(np.uint64))
                lower, there = _looked_up(stems, "s", model, s[place])
                value, sure = np.where(unknown, lower, value), sure | (unknown & (there | all_stems))
                total, top, rest = [], [], [[] for _ in range(3 + all_stems)]
                for low, high in zip(first[:-1], first[1:]):
                    kind = inverse[low:high]
                    given = sure[kind]
                    values = value[kind[given]]
                    total.append(int(values.sum()))
                    top.append(_strongest(values))
                    others, times = np.unique(kind[~given], return_counts=True)
                    for column, x in zip(rest, (own[others], s[place[others]], times, lower[others])):
                        column.append(x.tolist())
                lists = [pa.array(x, pa.list_(pa.int64())) for x in (top, *rest)]
                yield pa.record_batch([*[part[f.name] for f in carried], pa.array(np.diff(first)), pa.array(total, pa.int64()), *lists], names)

    schema = ", ".join([*[f"{f.name} {f.dataType.simpleString()}" for f in carried], "n bigint, total bigint, top array<bigint>, h array<bigint>, s array<bigint>, times array<bigint>", *["low array<bigint>"] * all_stems])
    found = rows.mapInArrow(scan, schema)
    if all_words and all_stems:
        return found.drop("h", "s", "times", "low")
    found = settle(found.withColumn("_row", F.monotonically_increasing_id()), "described", free=True)
    rest = found.select("_row", F.explode(F.arrays_zip(*names[len(carried) + 3 :])).alias("_x")).select("_row", "_x.*")
    rest = rest.join(lexicon.words.select("h", "s", F.col(model).alias("_word")), ["h", "s"], "left")
    if not all_stems:
        rest = rest.join(lexicon.stems.select("s", F.col(model).alias("low")), "s", "left")
    rest = rest.select("_row", F.coalesce("_word", "low", F.lit(0)).alias("value"), "times")
    repeated = F.flatten(F.collect_list(F.array_repeat("value", F.least("times", F.lit(max(PEAKS))).cast("int"))))
    rest = rest.groupBy("_row").agg(F.sum(F.col("value") * F.col("times")).alias("_total"), repeated.alias("_top"))
    joined = found.drop("h", "s", "times", "low").join(rest, "_row", "left")
    top = F.slice(F.sort_array(F.concat("top", F.coalesce("_top", F.array().cast("array<bigint>"))), False), 1, max(PEAKS))
    return joined.withColumn("total", F.col("total") + F.coalesce("_total", F.lit(0))).withColumn("top", top).drop("_row", "_total", "_top")


def evidence(batch: pa.RecordBatch) -> np.ndarray:
    """Per text: the mean ratio, the mean of its strongest expressions, and its log length."""
    n = batch["n"].to_numpy()
    out = np.zeros((len(n), len(PEAKS) + 2))
    out[:, 0] = batch["total"].to_numpy() / UNIT / np.maximum(n, 1)
    for i, top in enumerate(batch["top"].to_pylist()):
        out[i, 1:-1] = [sum(top[:k]) / UNIT / k for k in PEAKS]
    out[:, -1] = np.log1p(n)
    return out


@dataclass
class Calibration:
    centre: np.ndarray
    scale: np.ndarray
    weight: np.ndarray

    def __call__(self, features: np.ndarray) -> np.ndarray:
        x = np.column_stack([np.ones(len(features)), (features - self.centre) / self.scale])
        return 1 / (1 + np.exp(-np.clip(x @ self.weight, -30, 30)))


def calibrated(features: np.ndarray, labels: np.ndarray, ridge: float = 1.0) -> Calibration:
    """Logistic regression by Newton steps."""
    centre, scale = features.mean(0), features.std(0) + 1e-9
    model = Calibration(centre, scale, np.zeros(features.shape[1] + 1))
    x = np.column_stack([np.ones(len(features)), (features - centre) / scale])
    damp = np.diag([1e-6] + [ridge] * features.shape[1])
    for _ in range(50):
        p = model(features)
        slope = x.T @ (labels - p) - damp @ model.weight
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + damp, slope)
        model.weight = model.weight + step
        if np.abs(step).max() < 1e-6:
            break
    return model


def fold(id_column: str) -> Column:
    return F.pmod(F.crc32(F.col(id_column).cast("string").cast("binary")), F.lit(FOLDS))


def labelled(docs: DataFrame, labels: DataFrame, id_column: str, text_column: str, label_column: str) -> DataFrame:
    """``_text, _toxic, _fold`` of the labelled rows outside fold 0."""
    known = labels.filter(F.col(label_column).isNotNull() & F.col(id_column).isNotNull())
    known = known.groupBy(F.col(id_column).alias("_lid")).agg((F.max(label_column) > 0).cast("int").alias("_toxic"))
    known = known.filter(fold("_lid") != 0)
    if labels.count() <= BROADCAST_LABELS:
        known = F.broadcast(known)
    rows = docs.select(F.col(id_column).alias("_id"), F.coalesce(F.col(text_column), F.lit("")).alias("_text"))
    return rows.join(known, F.col("_id") == F.col("_lid")).select("_id", "_text", "_toxic", fold("_id").cast("int").alias("_fold"))


def scores(
    docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic"
) -> DataFrame:
    """Per row of ``docs``: ``held_out`` (fold 0), ``score`` and ``predicted``."""
    return keyed_scores(docs, labels, id_column, text_column, label_column).drop("_copy").withColumnRenamed("_id", id_column)


def keyed_scores(docs: DataFrame, labels: DataFrame, id_column: str, text_column: str, label_column: str) -> DataFrame:
    """``scores`` with the key of each row, ``_id`` and ``_copy``."""
    rows = labelled(docs, labels, id_column, text_column, label_column)
    counts = settle(word_counts(rows), "words", free=True)
    held_out = F.coalesce(fold(id_column) == 0, F.lit(False)).alias("held_out")
    totals = [x or 0 for x in counts.agg(*[F.sum(f"k{k}") for k in range(4)]).first()]
    share = (totals[1] + totals[3] + 1) / (sum(totals) + 2)
    texts_ = docs.select(F.col(id_column).cast("bigint").alias("_id"), F.coalesce(F.col(text_column), F.lit("")).alias("_text"), text_key(text_column).alias("_copy"), held_out)
    model: Calibration | None = None
    if min(totals[0], totals[1], totals[2] + totals[3]) > 0:
        lexicon = lexicon_of(counts)
        late = described(rows.filter(F.col("_fold") == FOLDS - 1).select("_id", "_toxic", "_text"), "early", lexicon)
        sample = late.orderBy(F.xxhash64("_id"), "_id").limit(CALIBRATION_ROWS).toArrow()
        truth = sample["_toxic"].to_numpy()
        if len(truth):
            model = calibrated(evidence(sample), truth)
    if model is None:
        return texts_.select("_id", "_copy", "held_out", F.lit(float(share)).alias("score"), F.lit(int(share >= 0.5)).alias("predicted"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value = model(evidence(batch))
            yield pa.record_batch([batch["_id"], batch["_copy"], batch["held_out"], pa.array(value), pa.array((value >= 0.5).astype(np.int32))], ["_id", "_copy", "held_out", "score", "predicted"])

    return described(texts_, "full", lexicon).mapInArrow(score, "_id bigint, _copy bigint, held_out boolean, score double, predicted int")


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the documents that the models call toxic. A document is judged by its text alone."""
    rejected = keyed_scores(docs, labels, "doc_id", "text", "toxic").filter("predicted = 1").select("_id", "_copy").distinct()
    return with_keys(docs, rejected, "left_anti")
