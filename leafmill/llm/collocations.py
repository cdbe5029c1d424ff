"""Phrase collocations: Rabin-Karp fingerprints of every n-gram, counted with pointers, read back from the text where frequent.

Texts are lower-cased (A-Z), cut into pieces at ``[.,;:!?\\x0A-\\x0D]`` and those into words; a phrase lies within a piece. A
prefix polynomial over the word hashes of a slice of text (numpy, modulo 2^64) gives the fingerprint of any n-gram by one difference and
one product. Each slice sends its distinct fingerprints by their leading bits, as byte strings: 46 bits or more of fingerprint, 32 bits
of a second polynomial with another base and other word hashes, the number of occurrences, and a pointer (row, word) to the first.

A slice of fingerprints is then counted by itself: equal fingerprints whose second values differ are different phrases. Only
those with ``least`` occurrences go on. Words and pairs are counted in one pass; longer phrases in a second, where every pair of
words inside must be frequent. That is asked of a bitmap of fixed size (2^27 bits), which says yes too often at worst.
The frequent phrases' texts are read at their pointers and their fingerprints computed again from the text found there: a
phrase is materialised only with both values equal, and two texts of one fingerprint would show as two phrases.

Scores, on phrases alone: cutting a phrase of frequency a in two gives the frequencies l and r of its parts and ``floor(scale * a / (l +
r))``; the lowest cut counts, ties to the first. A phrase inside a longer one that holds ``inside`` hundredths of its
occurrences is dropped. The ``top`` phrases of each language are ranked by score and frequency, then by text.

Defined results: null text is empty; null language is ``und``; repeated rows count each; ids are not used; a phrase's words are
joined by one space whatever stood between them; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.llm.blobs import bitmap, has, packed, slice_bits, sliced, steps, summed, unpacked
from leafmill.llm.words import SPACE, Words, mixed, powers, slices, text_bytes, words
from leafmill.shared import settle

LONGEST = 4
LEAST = 30
SCALE = 2_000_000
INSIDE = 80
TOP = 2000
SLICE_TEXT = 16 << 20

_U = np.uint64
_SLAB = 1 << 20
#: Odd bases of the polynomials over words, the one over bytes, and their inverses modulo 2^64.
BASES = tuple(_U(b) for b in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB))
INVERSES = tuple(_U(pow(int(b), -1, 1 << 64)) for b in BASES)
_BYTE = np.random.Generator(np.random.PCG64(12)).integers(1, 1 << 63, 256, dtype=np.uint64)

PIECE = np.zeros(256, bool)
PIECE[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
BREAKS = SPACE | PIECE


def byte_hashes(found: Words) -> np.ndarray:
    """A second hash of every word, by a prefix polynomial over its bytes."""
    out = np.empty(len(found.start), np.uint64)
    at = 0
    while at < len(out):
        to = max(at + 1, int(np.searchsorted(found.start, found.start[at] + _SLAB)))
        low, high = found.start[at], found.end[to - 1]
        prefix = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[found.data[low:high]] * powers(BASES[2], high - low), dtype=np.uint64)))
        start, end = found.start[at:to] - low, found.end[at:to] - low
        out[at:to] = (prefix[end] - prefix[start]) * powers(INVERSES[2], int(start[-1]) + 1)[start]
        at = to
    return mixed(out)


class Slice:
    """The words of a slice of texts, with what the fingerprints of all their n-grams are taken from."""

    def __init__(self, texts: pa.Array, langs: pa.Array):
        self.found = words(texts, lower=True, separators=BREAKS)
        data, _ = text_bytes(texts)
        count = len(self.found.start)
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.found.first))
        # Word i and a later word are in one piece if no break and no end of a text lies between them.
        self.piece = np.cumsum(PIECE[data])[self.found.start] + self.doc if count else np.empty(0, np.int64)
        known = langs.dictionary_encode()
        salts = np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in known.dictionary.to_pylist()], np.uint64)
        self.salt = salts[known.indices.to_numpy(zero_copy_only=False)][self.doc] if count else np.empty(0, np.uint64)
        self.prefixes, self.inverse = [], []
        for base, inverse, hashes in zip(BASES, INVERSES, (self.found.hash, byte_hashes(self.found))):
            self.prefixes.append(np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes * powers(base, count), dtype=np.uint64))))
            self.inverse.append(powers(inverse, count))

    def starts(self, n: int) -> np.ndarray:
        """The words that start ``n`` words of one piece."""
        at = np.arange(len(self.piece) - n + 1)
        return at[self.piece[at] == self.piece[at + n - 1]]

    def prints(self, at: np.ndarray, n: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Fingerprint and second value of the ``n`` words from each word of ``at``."""
        first, second = (mixed(((p[at + n] - p[at]) * i[at]) ^ self.salt[at] ^ _U(n)) for p, i in zip(self.prefixes, self.inverse))
        return first & ~_U((1 << (24 - bits)) - 1), second >> _U(32)

    def phrase(self, at: int, n: int) -> str:
        return b" ".join(self.found.data[self.found.start[i] : self.found.end[i]].tobytes() for i in range(at, at + n)).decode()


def identified(prints: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A stable order by both values, and where each new pair of them starts."""
    if not len(prints):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    order = np.argsort(prints, kind="stable")
    same = prints[order][1:] == prints[order][:-1]
    if (same & (second[order][1:] != second[order][:-1])).any():
        order = np.lexsort((second, prints))
        same = (prints[order][1:] == prints[order][:-1]) & (second[order][1:] == second[order][:-1])
    return order, np.flatnonzero(np.concatenate(([True], ~same)))


def frequent(texts: DataFrame, lengths: tuple[int, ...], bits: int, least: int, pairs: np.ndarray | None = None) -> DataFrame:
    """The n-grams of ``lengths`` with ``least`` occurrences: ``n, f, print, second, row, word``; with n = 0, the number f of words of a language.

    ``pairs``: the bitmap that every two consecutive words of an n-gram must pass.
    """
    context = texts.sparkSession.sparkContext
    held = None if pairs is None else context.broadcast(pairs)
    names = ["slice", "n", "lang", "size", "prints", "seconds", "times", "rows", "docs", "words"]
    kinds = pa.schema(list(zip(names, (pa.int32(), pa.int32(), pa.string(), pa.int64(), *[pa.binary()] * 6))))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch["_row"].to_numpy()
            for at, to in slices(batch["_text"]):
                own = Slice(batch["_text"].slice(at, to - at), batch["_lang"].slice(at, to - at))
                out: list[tuple] = []
                if 1 in lengths:
                    each = pa.table({"lang": batch["_lang"].slice(at, to - at), "k": np.diff(own.found.first)}).group_by("lang").aggregate([("k", "sum")])
                    for lang, k in zip(each["lang"].to_pylist(), each["k_sum"].to_pylist()):
                        out.append((int(rows[at]) % (1 << bits), 0, lang, k, *[b""] * 6))
                passed = None
                if held is not None:
                    passed = np.zeros(len(own.doc), bool)
                    two = own.starts(2)
                    passed[two] = has(held.value, own.prints(two, 2, bits)[0])
                for n in lengths:
                    starts = own.starts(n)
                    if passed is not None:
                        starts = starts[np.all([passed[starts + j] for j in range(n - 1)], axis=0)]
                    prints, second = own.prints(starts, n, bits)
                    order, new = identified(prints, second)
                    times = np.diff(np.append(new, len(order)))
                    place = order[new]
                    prints, second, where = prints[place], second[place], starts[place]
                    for s, low, high in sliced(prints, bits):
                        docs, index = np.unique(own.doc[where[low:high]], return_inverse=True)
                        word = where[low:high] - own.found.first[docs[index]]
                        out.append((
                            s, n, None, high - low, packed(steps(prints[low:high], s << (64 - bits)) >> _U(24 - bits)), packed(second[low:high]),
                            packed(times[low:high]), rows[at:to][docs].astype("<i8").tobytes(), packed(index), packed(word),
                        ))
                yield pa.record_batch([pa.array(x, f.type) for x, f in zip(zip(*out), kinds)], kinds) if out else pa.RecordBatch.from_pylist([], kinds)

    result = pa.schema([("n", pa.int32()), ("lang", pa.string()), ("f", pa.int64()), ("print", pa.int64()), ("second", pa.int64()), ("row", pa.int64()), ("word", pa.int64())])

    def count(table: pa.Table) -> pa.Table:
        s, parts = table["slice"][0].as_py(), []
        sums = table.filter(pc.equal(table["n"], 0)).group_by("lang").aggregate([("size", "sum")])
        nothing = pa.array([0] * len(sums), pa.int64())
        parts.append(pa.table([pa.array([0] * len(sums), pa.int32()), sums["lang"], sums["size_sum"], *[nothing] * 4], schema=result))
        for n in lengths:
            rows = table.filter(pc.equal(table["n"], n)).to_pylist()
            if not rows:
                continue
            column = lambda name: [unpacked(r[name], r["size"]) for r in rows]
            prints = np.concatenate([summed(x << _U(24 - bits), s << (64 - bits)) for x in column("prints")])
            row = np.concatenate([np.frombuffer(r["rows"], "<i8")[d.astype(np.int64)] for r, d in zip(rows, column("docs"))])
            second, times, word = (np.concatenate(column(name)) for name in ("seconds", "times", "words"))
            # The pointer is that of the first row, so that pointers gather in few rows.
            first = np.argsort(row, kind="stable")
            order, new = identified(prints[first], second[first])
            order = first[order]
            f = np.add.reduceat(times[order].astype(np.int64), new)
            often = order[new[f >= least]]
            columns = [np.full(len(often), n, np.int32), [None] * len(often), f[f >= least], prints[often].view(np.int64), second[often].astype(np.int64), row[often], word[often].astype(np.int64)]
            parts.append(pa.table([pa.array(x, t.type) for x, t in zip(columns, result)], schema=result))
        return pa.concat_tables(parts)

    found = texts.mapInArrow(scan, "slice int, n int, lang string, size bigint, prints binary, seconds binary, times binary, rows binary, docs binary, words binary")
    return found.groupBy("slice").applyInArrow(count, "n int, lang string, f bigint, print bigint, second bigint, row bigint, word bigint")


def materialised(texts: DataFrame, found: DataFrame, bits: int) -> DataFrame:
    """``lang, n, phrase, f`` of the frequent n-grams, read at their pointers."""
    wanted = found.groupBy("row").agg(F.collect_list(F.struct("n", "word", "f", "print", "second")).alias("_wanted"))
    rows = texts.join(wanted, texts["_row"] == wanted["row"]).select("_text", "_lang", "_wanted")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to in slices(batch["_text"]):
                part = batch.slice(at, to - at)
                own = Slice(part["_text"], part["_lang"])
                lang, n, phrase, f = [], [], [], []
                for i, (name, wanted_) in enumerate(zip(part["_lang"].to_pylist(), part["_wanted"].to_pylist())):
                    for x in wanted_:
                        start = int(own.found.first[i]) + x["word"]
                        prints, second = own.prints(np.array([start]), x["n"], bits)
                        if int(prints.view(np.int64)[0]) != x["print"] or int(second[0]) != x["second"]:
                            raise ValueError("a pointer leads to another phrase: the input changed between two passes")
                        for column, value in zip((lang, n, phrase, f), (name, x["n"], own.phrase(start, x["n"]), x["f"])):
                            column.append(value)
                yield pa.record_batch([pa.array(lang, pa.string()), pa.array(n, pa.int32()), pa.array(phrase, pa.string()), pa.array(f, pa.int64())], ["lang", "n", "phrase", "f"])

    return rows.mapInArrow(read, "lang string, n int, phrase string, f bigint")


def exact(column: str | Column) -> Column:
    return (F.col(column) if isinstance(column, str) else column).cast("decimal(20,0)")


def phrases(docs: DataFrame, text_column: str = "text", lang_column: str = "lang", longest: int = LONGEST, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """All phrases of 1 to ``longest`` words with ``least`` occurrences (``lang, n, phrase, f``), and the words of each language (``lang, n``)."""
    texts = docs.select(F.monotonically_increasing_id().alias("_row"), F.coalesce(F.col(text_column), F.lit("")).alias("_text"), F.coalesce(F.col(lang_column), F.lit("und")).alias("_lang"))
    texts = settle(texts, "texts")
    bits = slice_bits(texts.agg(F.sum(F.octet_length("_text"))).first()[0] or 0, SLICE_TEXT)
    short = settle(frequent(texts, tuple(range(1, min(longest, 2) + 1)), bits, least), "frequent", free=True)
    found = short.filter("n > 0")
    if longest > 2:
        pairs = bitmap(short.filter("n = 2"), "print")
        longer = settle(frequent(texts, tuple(range(3, longest + 1)), bits, least, pairs), "frequent", free=True)
        found = found.unionByName(longer)
    totals = short.filter("n = 0").groupBy("lang").agg(F.sum("f").alias("n"))
    return settle(materialised(texts, found, bits), "phrases", free=True), totals


def parts(column: str, low: int, high: Column) -> Column:
    """Every run of ``low`` words to ``high`` words inside the words of ``column``."""
    size = F.size(column)
    return F.flatten(F.transform(F.sequence(F.lit(low), high), lambda k: F.transform(F.sequence(F.lit(1), size - k + 1), lambda i: F.array_join(F.slice(column, i, k), " "))))


def collocations(
    docs: DataFrame, text_column: str = "text", lang_column: str = "lang", longest: int = LONGEST, least: int = LEAST, top: int = TOP, scale: int = SCALE, inside: int = INSIDE
) -> DataFrame:
    """The ``top`` phrases of 2 to ``longest`` words of each language: ``lang, rank, phrase, a, l, r, n, score``."""
    found, totals = phrases(docs, text_column, lang_column, longest, least)
    own = found.filter("n > 1").withColumn("_w", F.split("phrase", " ")).withColumnRenamed("f", "a")
    counts = found.select("lang", F.col("phrase").alias("_part"), F.col("f"))
    cuts = own.select("lang", "phrase", "a", "_w", F.explode(F.sequence(F.lit(1), F.col("n") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice("_w", F.lit(1), F.col("k")), " ").alias("_first"), F.array_join(F.slice("_w", F.col("k") + 1, F.size("_w")), " ").alias("_rest"))
    for part, name in (("_first", "l"), ("_rest", "r")):
        cuts = cuts.join(counts.withColumnsRenamed({"_part": part, "f": name}), ["lang", part])
    score = F.expr(f"(cast({scale} as decimal(18,0)) * cast(a as decimal(20,0))) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    best = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("_cut"))
    longer = own.filter("n > 2").select("lang", F.explode(parts("_w", 2, F.size("_w") - 1)).alias("phrase"), F.col("a").alias("_longer"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("_longer").alias("_longer"))
    kept = best.join(longer, ["lang", "phrase"], "left").filter(F.col("_longer").isNull() | (exact("_longer") * 100 < exact("a") * inside))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase"))
    ranked = kept.select("lang", "phrase", "a", "_cut.*").withColumn("rank", place).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
