"""Streams that depend on event time: the same result from one file and from several in any order."""

import os
import random
from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from leafmill.operators.jobs import ORPHAN_NOTE
from leafmill import shared
from leafmill.shared import shared_folder
from leafmill.streaming import jobs, timed

SECOND = 1_000_000
CALLS = "key string, ts_us bigint, event_id bigint, keeps boolean, answers bigint"


def stream(spark, rows, schema, files, seed=1):
    """Rows dealt to so many files in random order, streamed one file at a time."""
    path = shared_folder(spark, "test-stream")
    random.Random(seed).shuffle(rows)
    for i in range(files):
        spark.createDataFrame(rows[i::files], schema).coalesce(1).write.mode("append").parquet(path)
    shape = spark.createDataFrame([], schema).schema
    return spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).parquet(path)


def walked(calls, ttl_s):
    stored, out = {}, []
    for key, ts, event, keeps, answers in sorted(calls, key=lambda c: (c[0], c[1], c[2])):
        at, own = stored.get(key, (None, 0))
        hit = at is not None and ts - at < ttl_s * SECOND
        if not hit and keeps:
            stored[key] = (ts, answers)
        out.append((key, event, hit, own if hit else answers))
    return sorted(out)


@pytest.mark.parametrize("files", [1, 4])
def test_answers_do_not_depend_on_files(spark, files):
    chance = random.Random(9)
    calls = [(chance.choice("abc"), (6000 + chance.randrange(0, 4_000)) * SECOND + i, i, chance.random() < 0.7, chance.randrange(5)) for i in range(400)]
    found = timed.ordered_calls(stream(spark, list(calls), CALLS, files), 300, late_s=8000).collect()
    assert sorted(tuple(r) for r in found) == walked(calls, 300)


def test_an_open_stream_keeps_back_what_may_still_change(spark):
    calls = [("a", (6000 + i * 600) * SECOND, i, True, 1) for i in range(10)]
    found = timed.ordered_calls(stream(spark, list(calls), CALLS, 1), 300, late_s=1200, closes=False).collect()
    ids = {r.event_id for r in found}
    assert ids == set(range(7))  # the newest comes at 11,400 s, so slices up to 10,200 s are due


def test_searches(spark):
    rows = [
        (1, 0, "ab", 10, 3), (2, SECOND, " Stoa ", 10, 3), (3, 2 * SECOND, "stoa", 10, 9), (4, 3 * SECOND, "stoa", 11, 2), (5, 200 * SECOND, "zeno", 10, 0),
        (6, 201 * SECOND, "zeno", 10, 4), (7, 202 * SECOND, "ZENO", 10, 7), (8, 301 * SECOND, "stoa", 10, 1), (9, 500 * SECOND, None, 10, 1),
    ]
    schema = "event_id bigint, ts_us bigint, query string, `limit` int, answers bigint"
    found = timed.cached_searches(stream(spark, list(rows), schema, 3), late_s=1000).collect()
    assert sorted(tuple(r) for r in found) == [
        (1, "short", 0), (2, "miss", 3), (3, "hit", 3), (4, "miss", 2), (5, "miss", 0), (6, "miss", 4), (7, "hit", 4), (8, "miss", 1), (9, "short", 0),
    ]


@pytest.mark.parametrize("files", [1, 5])
def test_reaper(spark, files):
    s = SECOND
    rows = [
        ("a", None, "discovering", 1), ("a", "x", "compiling", 2), ("a", "y", "pending", 3), ("a", "z", "done", 4),
        ("b", None, "processing", 1), ("b", None, "completed", 5), ("b", "x", "pending", 2),
        ("c", None, "processing", 12), ("c", "x", "pending", 13), ("c", "x", "done", 14), ("c", "y", "compiling", 15),
        ("a", "y", "compiling", 16),  # a reaped item of a job that stays failed
        ("d", None, "reviewing", 1), ("d", "x", "pending", 2), ("e", None, "processing", 20), ("e", "x", "pending", 30),
    ]
    events = [(job, item, state, None, t * s, i) for i, (job, item, state, t) in enumerate(rows)]
    schema = "job_id string, item_id string, state string, note string, ts_us bigint, event_id bigint"
    found = timed.reaped(stream(spark, events, schema, files), [20 * s, 10 * s], late_s=1000).collect()
    rows = sorted((r.job_id, r.item_id or "", r.state, r.note, r.restart_us // s) for r in found)
    assert rows == [
        ("a", "", "failed", timed.JOB_NOTE, 10), ("a", "x", "failed", ORPHAN_NOTE, 10), ("a", "y", "failed", ORPHAN_NOTE, 10),
        ("c", "", "failed", timed.JOB_NOTE, 20), ("c", "y", "failed", ORPHAN_NOTE, 20),
    ]


def test_fetched_languages(spark):
    schema = "fetch_id bigint, video_id string, choice string, language string, text string, fetched_at timestamp"
    moment = lambda n: f"2024-01-01 00:{n:02d}:00"
    rows = [
        (1, "v", None, "en", "one two.", 1), (1, "v", None, "en", "one two.", 2), (2, "v", "fr", "fr", "un deux trois", 3), (3, "v", "de", "de", "", 4),
        (4, "w", None, "en", None, 5), (5, "v", None, "en", "one two three.", 6),
    ]
    path = shared_folder(spark, "test-fetches")
    spark.createDataFrame([(*r[:5], moment(r[5])) for r in rows], schema.replace("timestamp", "string")).withColumn("fetched_at", F.col("fetched_at").cast("timestamp")).write.parquet(path)
    fetches = spark.readStream.schema(schema).parquet(path)
    known = jobs.fetched_transcripts(fetches)
    assert {r.key: r.text for r in known.collect()} == {"v": "one two three.", "v#fr": "un deux trois"}
    items = spark.createDataFrame([(1, "v", ["en", "fr", "de"], None), (2, "v", ["en", "fr", "de"], "en"), (3, "v", ["en", "fr", "de"], "fr"), (4, "v", ["en", "fr", "de"], "de"), (5, "v", ["en"], "fr"), (6, "w", ["en"], None)], "id int, video_id string, tracks array<string>, choice string")
    found = {r.id: (r.key, r.language, r.words, r.problem) for r in jobs.with_chosen_language(items, known).collect()}
    assert found == {
        1: ("v", "en", 3, None), 2: ("v", "en", 3, None), 3: ("v#fr", "fr", 3, None), 4: (None, None, None, "no transcript"),
        5: (None, None, None, "language not offered"), 6: (None, None, None, "no transcript"),
    }


def batches_of(spark, schema, *batches):
    """One file a micro-batch, in this order."""
    path = shared_folder(spark, "test-batches")
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        for file in Path(path.removeprefix("file://")).glob("*.parquet"):
            if file.stat().st_mtime > 10**9:
                os.utime(file, (1000 + i, 1000 + i))
    return spark.readStream.schema(spark.createDataFrame([], schema).schema).option("maxFilesPerTrigger", 1).parquet(path)


def no_state_store(name):
    """Not one remote call per row and key: the job keeps tables, no state store."""
    path = [p for _, p in shared._made if f"leafmill-{name}-" in p][-1].removeprefix("file://")
    return Path(f"{path}/progress/offsets").exists() and not Path(f"{path}/progress/state").exists()


def test_late_fetches_are_kept(spark):
    schema = "fetch_id bigint, video_id string, choice string, language string, text string, fetched_at timestamp"
    moment = lambda hour, minute=0: datetime(2024, 1, 1, hour, minute)
    fetches = batches_of(
        spark, schema, [(1, "v", None, "en", "first", moment(10))], [(2, "x", None, "en", "other", moment(11))],
        # Hours behind the newest fetch seen, and another report of a fetch that is known.
        [(3, "w", None, "en", "only", moment(1)), (4, "v", "fr", "fr", "seul", moment(2)), (1, "v", None, "en", "first", moment(10, 30))],
        [(5, "v", None, "en", "newer", moment(10, 20))],
    )
    known = jobs.fetched_transcripts(fetches)
    assert {r.key: r.text for r in known.collect()} == {"v": "newer", "v#fr": "seul", "w": "only", "x": "other"}
    assert no_state_store("fetched")


def test_calls_are_settled_in_one_pass(spark):
    chance = random.Random(4)
    calls = [(f"k{chance.randrange(3000)}", chance.randrange(40_000) * SECOND, i, chance.random() < 0.8, chance.randrange(5)) for i in range(20_000)]
    found = timed.ordered_calls(stream(spark, list(calls), CALLS, 2), 6000, late_s=50_000).collect()
    assert sorted(tuple(r) for r in found) == walked(calls, 6000)
    assert no_state_store("calls")


def test_late_calls_and_answers_kept_between_batches(spark):
    s = SECOND
    calls = batches_of(
        spark, CALLS, [("a", 100 * s, 1, True, 7), ("b", 900 * s, 2, True, 8)], [("a", 350 * s, 3, True, 9), ("a", 500 * s, 4, False, 2), ("a", 500 * s, 5, True, 3), ("c", 399 * s, 6, True, 1)],
        [("a", 5000 * s, 7, True, 4)], [("b", 4000 * s, 8, True, 5), ("a", 4600 * s, 9, True, 6), ("a", 4400 * s, 10, True, 6)])
    # Marks after the batches: 400, 400, 4500 s. Calls 3, 6, 8 and 10 come too late; the answer of call 1 still serves 4 and 5.
    found = timed.ordered_calls(calls, 450, late_s=500).collect()
    assert sorted((r.event_id, r.hit, r.answers) for r in found) == [(1, False, 7), (2, False, 8), (4, True, 7), (5, True, 7), (7, True, 6), (9, False, 6)]


def test_reaper_keeps_the_latest_states_as_a_table(spark):
    s, schema = SECOND, "job_id string, item_id string, state string, note string, ts_us bigint, event_id bigint"
    event = lambda i, job, item, state, t: (job, item, state, None, t * s, i)
    events = batches_of(
        spark, schema, [event(0, "a", None, "processing", 1), event(1, "a", "x", "pending", 2), event(2, "a", "y", "compiling", 12), event(3, "b", "x", "pending", 3)],
        [event(4, "a", None, "processing", 25), event(5, "a", "x", "done", 26), event(6, "b", None, "discovering", 15)], [event(7, "b", "y", "pending", 5)])
    found = timed.reaped(events, [10 * s, 20 * s, 30 * s], late_s=10).collect()
    # The third batch is later than 10 s behind the 26th; item y of job a waits two restarts for its job to run.
    assert sorted((r.job_id, r.item_id or "", r.restart_us // s) for r in found) == [("a", "", 10), ("a", "", 30), ("a", "x", 10), ("a", "y", 30), ("b", "", 20), ("b", "x", 20)]
    assert no_state_store("reaped")
