"""The block-wise scans against plain windows, with one key holding most rows and blocks of a few rows."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from leafmill.functions.blockmatch import matching_blocks, ratio
from leafmill.operators.ordered import Running, block_of, first_per_key, islands, number_ranged, number_rows, running, top_per_key
from leafmill.operators.packing import block_function, pack


@pytest.fixture(scope="module")
def hot(spark):
    chance = random.Random(5)
    rows = []
    for key, count in (("hot", 400), ("cold", 30), (None, 25)):
        for pos in range(count):
            value = None if chance.random() < 0.3 else chance.randint(0, 4)
            rows.append((key, pos, value, chance.randint(1, 30), chance.random() < 0.2, chance.random() < 0.05))
    chance.shuffle(rows)
    return spark.createDataFrame(rows, "key string, pos long, value int, size int, soft boolean, hard boolean").cache()


@pytest.mark.parametrize("kind", ["sum", "count", "min", "max", "last"])
@pytest.mark.parametrize("inclusive", [True, False])
def test_running_equals_window(hot, kind, inclusive):
    spec = Running(kind, F.col("value"), inclusive)
    mine = running(hot, ["key"], [block_of("pos", 7)], [F.col("pos")], {"out": spec})
    window = Window.partitionBy("key").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    plain = {
        "sum": F.coalesce(F.sum("value").over(window), F.lit(0)), "count": F.count("*").over(window),
        "min": F.min("value").over(window), "max": F.max("value").over(window), "last": F.last("value", True).over(window),
    }[kind]
    expected = hot.withColumn("out", plain)
    assert sorted(map(str, mine.select("key", "pos", "out").collect())) == sorted(map(str, expected.select("key", "pos", "out").collect()))


def test_lag_keeps_nulls(hot):
    mine = running(hot, ["key"], [block_of("pos", 7)], [F.col("pos")], {"out": Running("lag", F.col("value"))})
    expected = hot.withColumn("out", F.lag("value").over(Window.partitionBy("key").orderBy("pos")))
    assert sorted(map(str, mine.select("key", "pos", "out").collect())) == sorted(map(str, expected.select("key", "pos", "out").collect()))


def test_row_numbers_with_a_descending_block(hot):
    mine = number_rows(hot, ["key"], [-block_of("pos", 7)], [-F.col("pos")], "n")
    expected = hot.withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("pos"))))
    assert sorted(map(str, mine.select("key", "pos", "n").collect())) == sorted(map(str, expected.select("key", "pos", "n").collect()))


@pytest.mark.parametrize("transparent", [False, True])
def test_islands(hot, transparent):
    cut = (lambda a, b: a != b) if transparent else None
    mine = islands(hot, ["key"], block_of("pos", 7), [F.col("pos")], F.col("value"), "run", cut)
    groups = {}
    for r in sorted(hot.collect(), key=lambda r: r.pos):
        groups.setdefault(r.key, []).append(r)
    expected = set()
    for key, rows in groups.items():
        run, before, started = 0, None, False
        for r in rows:
            if transparent:
                if r.value is not None:
                    run += started and r.value != before
                    before, started = r.value, True
            else:
                run += started and r.value != before
                before, started = r.value, True
            expected.add((key, r.pos, run))
    assert {(r.key, r.pos, r.run) for r in mine.collect()} == expected


def _fold(rows, low, high):
    size, number, out = 0, 0, []
    for r in rows:
        if size > 0 and (r.hard or (size >= low and (r.soft or size >= high))):
            size, number = 0, number + 1
        size += r.size
        out.append(number)
    return out


@pytest.mark.parametrize("low,high", [(20, 90), (60, 60), (0, 40)])
def test_pack_equals_fold(hot, low, high):
    mine = pack(
        hot, ["key"], block_of("pos", 7), ["pos"], length=F.col("size"), soft=F.col("soft"), hard=F.col("hard"),
        allowed=F.lit(True), low=low, high=high,
    )
    found = {}
    for r in sorted(mine.collect(), key=lambda r: r.pos):
        found.setdefault(r.key, []).append(r)
    for rows in found.values():
        assert [r.group_no for r in rows] == _fold(rows, low, high)


def test_block_function_matches_simulation():
    chance = random.Random(9)
    for _ in range(300):
        n = chance.randint(1, 30)
        items = [(chance.randint(1, 12), chance.random() < 0.2, chance.random() < 0.05, chance.random() < 0.8) for _ in range(n)]
        low, high = chance.choice([(0, 20), (5, 30), (20, 20)])
        first, after, closed, adds = block_function(*map(list, zip(*items)), low, high)
        for start in range(high + 5):
            size, number = start, 0
            for length, soft, hard, may in items:
                if size > 0 and may and (hard or (size >= low and (soft or size >= high))):
                    size, number = 0, number + 1
                size += length
            at = max(i for i, f in enumerate(first) if f <= min(start, high))
            assert (after[at] + start if adds[at] else after[at], closed[at]) == (size, number)


def test_first_and_top(hot):
    first = {r.key: r.pos for r in first_per_key(hot, ["key"], [F.col("pos")]).collect()}
    assert first == {"hot": 0, "cold": 0, None: 0}
    assert top_per_key(hot, ["key"], [F.col("pos")], 3).count() == 9


def test_matching_blocks_equal_the_standard_library():
    chance = random.Random(1)
    for _ in range(400):
        a = [str(chance.randint(0, chance.choice([2, 4, 15]))) for _ in range(chance.randint(0, 45))]
        b = [w for w in a if chance.random() < 0.8] if chance.random() < 0.6 else [str(chance.randint(0, 5)) for _ in range(chance.randint(0, 45))]
        matcher = SequenceMatcher(None, a, b, autojunk=False)
        assert ratio(a, b) == matcher.ratio()
        mine = {(i + k, j + k) for i, j, n in matching_blocks(a, b) for k in range(n)}
        assert mine == {(m.a + k, m.b + k) for m in matcher.get_matching_blocks() for k in range(m.size)}


def test_number_ranged_equals_window(spark, hot):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        mine = number_ranged(hot, ["key"], [F.col("value"), F.col("pos")], "n").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    window = Window.partitionBy("key").orderBy("value", "pos")
    assert sorted(map(str, mine)) == sorted(map(str, hot.withColumn("n", F.row_number().over(window).cast("bigint")).collect()))


def test_only_heavy_keys_are_salted(spark):
    from leafmill.operators import ordered

    left = spark.createDataFrame([(i, "hot" if i % 3 == 0 else None if i % 31 == 0 else f"k{i % 50}") for i in range(600)], "i int, k string")
    right = spark.createDataFrame([(k, f"v-{k}") for k in ["hot", *[f"k{j}" for j in range(0, 50, 2)], "unused"]], "k string, v string")
    assert ordered.heavy_keys(left, "k", 1 / 10) == ["hot"]
    found = ordered.salted_left_join(left, right, "k", share=1 / 10, salts=8)
    assert sorted(map(tuple, found.select("i", "k", "v").collect()), key=str) == sorted(map(tuple, left.join(right, "k", "left").select("i", "k", "v").collect()), key=str)
    # The right side grows by the heavy key's rows alone.
    dealt = spark.createDataFrame([("hot",), ("k2",)], "k string")
    assert ordered.salted_left_join(left, dealt.withColumn("v", ordered.F.lit(1)), "k", share=1 / 10, salts=8).filter("v = 1").count() == left.filter("k IN ('hot', 'k2')").count()
    assert ordered.heavy_keys(left.limit(0), "k", 1 / 10) == []


def test_titles_sort_by_letters_before_accents(table):
    from leafmill.operators.hits import sort_order

    titles = ["zoo", "Éclair", "eagle", "fig", "Zebra", "apple", "ecole", "école", "Apple"]
    rows = sort_order(table("query_id int, title string, pos int", *[(1, t, i) for i, t in enumerate(titles)]), "title").orderBy("place").collect()
    assert [r.title for r in rows] == ["apple", "Apple", "eagle", "Éclair", "ecole", "école", "fig", "Zebra", "zoo"]
