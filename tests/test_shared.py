"""Where intermediate tables lie."""

from types import SimpleNamespace

import pytest

from leafmill import shared


def session(master, setting=None):
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, other=None: setting), sparkContext=SimpleNamespace(master=master, applicationId=f"app-{master}"))


def test_the_clusters_folder_is_used():
    assert shared.shared_base(session("spark://m:7077", "hdfs://n/checkpoints/")) == "hdfs://n/checkpoints"


@pytest.mark.parametrize("master", ["spark://m:7077", "yarn", "local-cluster[2,1,1024]"])
def test_a_cluster_without_one_is_an_error(master):
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.shared_base(session(master))


def test_a_local_session_has_its_own():
    own = shared.shared_base(session("local[4]"))
    assert own.startswith("file:///") and own == shared.shared_base(session("local[4]"))


def test_settled_tables_read_as_before(spark):
    df = spark.range(10).selectExpr("id", "id % 3 AS k", "CAST(NULL AS STRING) AS s")
    assert sorted(map(str, shared.settle(df).collect())) == sorted(map(str, df.collect()))
