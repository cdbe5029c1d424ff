"""Every registered query against its DuckDB SQL on the smallest tables."""

import pytest

from leafmill.plans.catalog import ORACLES, QUERIES
from leafmill.plans.check import compare, duck

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, con, name):
    outcome = compare(spark, con, FOLDER, name)
    assert outcome.startswith("ok"), outcome


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, FOLDER).count() >= 0
