"""Streams of tables that are folders of files, as larger tables are."""

import duckdb
import pytest

from leafmill.plans.check import compare, duck

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("folders"))
    for name in ("pages", "documents", "conversations", "events"):
        spark.read.parquet(f"{SMALL}/{name}.parquet").repartition(3).write.parquet(f"{path}/{name}.parquet")
    return path


@pytest.mark.parametrize("name", ["search_batch_stream", "source_progress_stream", "transcript_arrival_stream", "transcript_choice_stream", "item_state_stream", "spend_per_day_stream"])
def test_streams_read_folders(spark, folder, name):
    outcome = compare(spark, duck(SMALL), folder, name)
    assert outcome.startswith("ok"), outcome


@pytest.fixture(scope="module")
def cut(spark, tmp_path_factory):
    """Tables cut by a column, which then stands in the names of folders alone."""
    path = str(tmp_path_factory.mktemp("cut"))
    for name, column in (("documents", "lang"), ("conversations", "turn"), ("events", "event_type")):
        spark.read.parquet(f"{SMALL}/{name}.parquet").write.partitionBy(column).parquet(f"{path}/{name}.parquet")
    return path


@pytest.mark.parametrize("name", ["source_progress_stream", "transcript_arrival_stream", "transcript_choice_stream", "spend_per_day_stream"])
def test_streams_read_folders_cut_by_a_column(spark, cut, name):
    outcome = compare(spark, duck(SMALL), cut, name)
    assert outcome.startswith("ok"), outcome


def test_arrivals_without_a_time(spark, tmp_path):
    rows = [(1, None, "user", "no time"), (2, None, "user", "none"), (2, 1, "user", "a time"), (3, 0, "user", None), (4, 2, "user", "older"), (4, 3, "user", "")]
    spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(2).write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    outcome = compare(spark, con, str(tmp_path), "transcript_arrival_stream")
    assert outcome.startswith("ok"), outcome
