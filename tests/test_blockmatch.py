"""Blocks of one length are found in one step; what stands whole in the other side is not matched at all."""

import time
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from leafmill.functions.blockmatch import matching_blocks, similarity


def test_blocks_of_equal_length_take_one_step():
    # 40,000 words without every eighth: 5,000 blocks, all of seven words.
    a = [f"w{i}" if i % 8 else "and" for i in range(40_000)]
    b = [w for w in a if w != "and"]
    started = time.process_time()
    blocks = matching_blocks(a, b)
    assert time.process_time() - started < 0.5
    assert blocks == [(8 * k + 1, 7 * k, 7) for k in range(5_000)]


def test_gaps_without_runs():
    a, b = "x 1 a b c y 2 d e z 3".split(), "1 x a b c 2 y d e 3 z z".split()
    assert matching_blocks(a, b) == [tuple(m) for m in SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks() if m.size]


def test_whole_sides_stay_in_the_jvm(table):
    rows = [("a b c", "x a b c"), ("a b c a", "b c"), ("ab c", "a b c"), ("a b", "a b"), ("", "a"), ("", ""), ("a x b", "a b")]
    df = table("a string, b string", *rows).select(*[F.filter(F.split(c, " "), lambda w: w != "").alias(c) for c in "ab"])
    ratio = similarity(F.col("a"), F.col("b"))
    got = [r.s for r in df.select(ratio.alias("s")).collect()]
    want = [SequenceMatcher(None, a.split(), b.split(), autojunk=False).ratio() if a and b else float(a == b) for a, b in rows]
    assert got == want
    # Only what neither side holds whole is sent to Python.
    assert "contains" in df.select(ratio)._jdf.queryExecution().optimizedPlan().toString()
