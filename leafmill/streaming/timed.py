"""Streams whose result depends on the order of events, not on that of files.

A watermark of their own: calls wait in a table until the newest event is ``late_s`` ahead of them, then they are taken in
order of time, all keys of a micro-batch in one sorted pass. A call later than ``late_s`` behind the newest one of the
batches before is left out. Marks and waiting rows belong to a batch's number, so a batch that runs again counts once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmill.operators.jobs import ORPHAN_NOTE
from leafmill.streaming.tables import _delete, _files, append_table, folders, shared_folder, upsert_stream

LATE_S = 3600
JOB_NOTE = "The server restarted while this compilation was still running, so it stopped."
# States of a job that runs, and of an item that is not built yet.
RUNNING = ("discovering", "processing")
UNBUILT = ("pending", "compiling")
# The search cache's time to live and its shortest query.
SEARCH_TTL_S = 300
SHORTEST_QUERY = 3
#: Marks before the first event and after the last one.
START, END = -(2**63), 2**63 - 1


class Marks:
    """The watermark after each micro-batch, in microseconds, as small tables under ``path``."""

    def __init__(self, spark: SparkSession, path: str, late_s: int):
        self.spark, self.path, self.late_us = spark, f"{path}/marks", late_s * 1_000_000

    def after(self, number: int) -> int:
        if number < 0:
            return START
        return self.spark.read.schema("mark BIGINT").parquet(f"{self.path}/batch={number}").first()["mark"]

    def last(self) -> int:
        files, target = _files(self.spark, self.path)
        return self.after(max((int(s.getPath().getName().partition("=")[2]) for s in files.listStatus(target)), default=-1)) if files.exists(target) else START

    def on_time(self, batch: DataFrame, number: int) -> tuple[DataFrame, int]:
        """The rows of a batch that are not too late, and the mark after it."""
        before = self.after(number - 1)
        newest = batch.agg(F.max("ts_us").alias("ts_us")).first()["ts_us"]
        mark = before if newest is None else max(before, newest - self.late_us)
        self.spark.createDataFrame([(mark,)], "mark BIGINT").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/batch={number}")
        return batch.filter(F.col("ts_us") >= before), mark


#: A call that waits (no ``hit`` yet), one that is settled, or an answer that is kept (``hit`` and not ``due``).
CALL = "key STRING, ts_us BIGINT, event_id BIGINT, keeps BOOLEAN, answers BIGINT, hit BOOLEAN, due BOOLEAN"
_CALL = pa.schema([
    ("key", pa.string()), ("ts_us", pa.int64()), ("event_id", pa.int64()), ("keeps", pa.bool_()), ("answers", pa.int64()), ("hit", pa.bool_()), ("due", pa.bool_()),
])


def _answered(rows: DataFrame, ttl_us: int, mark: int) -> DataFrame:
    """Calls before ``mark`` settled in order of time; one stored answer per key, kept while a later call could still hit it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, stored, answers = None, None, 0

        def kept() -> list[tuple]:
            return [(current, stored, None, True, answers, True, False)] if stored is not None and stored + ttl_us > mark else []

        def packed(out: list[tuple]) -> pa.RecordBatch:
            columns = zip(*out) if out else [[]] * len(_CALL)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _CALL.types)], schema=_CALL)

        for batch in batches:
            out: list[tuple] = []
            for key, at, event_id, keeps, own, held in zip(*(c.to_pylist() for c in batch.columns)):
                if key != current:
                    out += kept()
                    current, stored, answers = key, None, 0
                if held:
                    stored, answers = at, own
                elif at >= mark:
                    out.append((key, at, event_id, keeps, own, None, False))
                else:
                    hit = stored is not None and at - stored < ttl_us
                    if not hit and keeps:
                        stored, answers = at, own
                    out.append((key, at, event_id, keeps, answers if hit else own, hit, True))
            yield packed(out)
        yield packed(kept())

    ordered = rows.select("key", "ts_us", "event_id", "keeps", "answers", "hit").repartition("key").sortWithinPartitions("key", "ts_us", "event_id", "keeps", "answers")
    return ordered.mapInArrow(run, CALL)


def ordered_calls(calls: DataFrame, ttl_s: int, late_s: int = LATE_S, closes: bool = True) -> DataFrame:
    """``key, event_id, hit, answers`` of each call (key, ts_us, event_id, keeps, answers), in whatever order files bring them.

    ``keeps``: the call's own answer may be stored; ``answers`` of a hit are those of the stored one. A call within the time to
    live of the stored answer is a hit, else it is billed and may refresh it. ``closes``: the stream is finished, so all calls are due.
    """
    spark = calls.sparkSession
    path = shared_folder(spark, "calls")
    marks = Marks(spark, path, late_s)
    slim = calls.select("key", "ts_us", "event_id", F.col("keeps").cast("boolean").alias("keeps"), F.col("answers").cast("bigint").alias("answers"))

    def part(number: int, due: bool) -> DataFrame:
        files, target = _files(spark, f"{path}/rows/batch={number}/due={str(due).lower()}")
        schema = CALL.removesuffix(", due BOOLEAN")
        return spark.read.schema(schema).parquet(target.toString()) if files.exists(target) else spark.createDataFrame([], schema)

    def settled(rows: DataFrame, number: int, mark: int) -> None:
        _answered(rows, ttl_s * 1_000_000, mark).write.mode("overwrite").partitionBy("due").parquet(f"{path}/rows/batch={number}")
        # What waited before this batch is in its own rows now; the batch may still run again, the one before not.
        _delete(spark, f"{path}/rows/batch={number - 2}/due=false")

    def fold(batch: DataFrame, number: int) -> None:
        fresh, mark = marks.on_time(batch, number)
        settled(part(number - 1, False).unionByName(fresh, allowMissingColumns=True), number, mark)

    query = slim.writeStream.foreachBatch(fold).option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    done = folders(spark, path)
    if closes and done:
        settled(part(done[-1], False), done[-1] + 1, END)
        done.append(done[-1] + 1)
    paths = [f"{path}/rows/batch={n}" for n in done]
    found = spark.read.schema(CALL).option("basePath", f"{path}/rows").parquet(*paths) if paths else spark.createDataFrame([], CALL)
    return found.filter("due").select("key", "event_id", "hit", "answers")


def search_key(query: Column | str, limit: Column | str) -> Column:
    """Searches share an answer if they differ in case and outer white space only; the language is no part of it."""
    query = F.col(query) if isinstance(query, str) else query
    return F.concat(F.lower(F.trim(query)), F.lit("::"), (F.col(limit) if isinstance(limit, str) else limit).cast("string"))


def cached_searches(searches: DataFrame, late_s: int = LATE_S, closes: bool = True) -> DataFrame:
    """``event_id, outcome, answers`` of a stream of searches (event_id, ts_us, query, limit, answers).

    ``short`` queries are answered empty and never asked; a ``hit`` is answered from the cache for five minutes; a ``miss`` is asked, and
    kept only if it found something.
    """
    short = F.length(F.trim(F.coalesce("query", F.lit("")))) < SHORTEST_QUERY
    spark, path = searches.sparkSession, shared_folder(searches.sparkSession, "short")
    append_table(searches.filter(short).select("event_id"), path)
    asked = searches.filter(~short).select(search_key("query", "limit").alias("key"), "ts_us", "event_id", (F.col("answers") > 0).alias("keeps"), "answers")
    found = ordered_calls(asked, SEARCH_TTL_S, late_s, closes).select("event_id", F.when(F.col("hit"), "hit").otherwise("miss").alias("outcome"), "answers")
    skipped = spark.read.schema("event_id BIGINT").parquet(f"{path}/rows").select("event_id", F.lit("short").alias("outcome"), F.lit(0).cast("bigint").alias("answers"))
    return found.unionAll(skipped)


def reaped(events: DataFrame, restarts_us: list[int], late_s: int = LATE_S, closes: bool = True) -> DataFrame:
    """``job_id, item_id, state, note, restart_us`` of the jobs (no item) and items that each restart leaves unfinished.

    ``events`` streams (job_id, item_id, state, note, ts_us, event_id), without item for the status of a job itself. An event at a restart's own instant comes after it.
    At a restart a job that is still running fails, and so do its items that were not built; only later events undo that.
    The stream is kept as a table of the latest state of each job and item before each restart.
    """
    spark, restarts = events.sparkSession, sorted(restarts_us)
    path = shared_folder(spark, "reaped")
    marks = Marks(spark, path, late_s)
    epoch = F.size(F.filter(F.array(*[F.lit(r).cast("bigint") for r in restarts]), lambda r: r <= F.col("ts_us")))
    slim = events.select("job_id", F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), epoch.alias("epoch"), "state", "ts_us", "event_id")
    held = upsert_stream(
        slim, path, ["job_id", "item", "epoch"], ["ts_us", "event_id"], accept=lambda batch, number: marks.on_time(batch, number)[0].filter(F.col("epoch") < len(restarts)))
    mark = END if closes else marks.last()
    item = dict(events.dtypes)["item_id"]
    found = _unfinished(held, restarts, sum(r <= mark for r in restarts))
    return found.select("job_id", F.nullif("item", F.lit("")).cast(item).alias("item_id"), F.lit("failed").alias("state"), "note", "restart_us")


def _unfinished(held: DataFrame, restarts: list[int], due: int) -> DataFrame:
    """``job_id, item, note, restart_us`` at the first ``due`` restarts, from latest states (job_id, item, epoch, state).

    A job runs at a restart if its last status since the restart before says so: else it had failed there. An item that is not built
    fails at the first restart at which its job runs, unless a later state comes before.
    """
    at = F.array(*[F.lit(r).cast("bigint") for r in restarts])
    rows = held.filter(F.col("epoch") < due).withColumn("_next", F.lead("epoch").over(Window.partitionBy("job_id", "item").orderBy("epoch")))
    running = rows.filter((F.col("item") == "") & F.col("state").isin(*RUNNING)).select("job_id", "epoch")
    jobs = running.select("job_id", F.lit("").alias("item"), F.lit(JOB_NOTE).alias("note"), F.get(at, F.col("epoch")).alias("restart_us"))
    stops = running.groupBy(F.col("job_id").alias("_job")).agg(F.collect_set("epoch").alias("_stops"))
    open_items = rows.filter((F.col("item") != "") & F.col("state").isin(*UNBUILT))
    stop = F.array_min(F.filter("_stops", lambda s: s >= F.col("epoch")))
    stopped = open_items.join(stops, F.col("job_id").eqNullSafe(F.col("_job"))).withColumn("_stop", stop).filter("_stop < coalesce(_next, _stop + 1)")
    return jobs.unionAll(stopped.select("job_id", "item", F.lit(ORPHAN_NOTE), F.get(at, F.col("_stop"))))
