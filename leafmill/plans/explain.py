"""What each query's physical plan holds: ``python -m leafmill.plans.explain SF_DIR [name ...]``."""

from __future__ import annotations

import re
import sys

from leafmill.plans.catalog import QUERIES
from leafmill.session import local_session

# A plan that needs any of these does not scale.
SUSPECT = ("CartesianProduct", "BroadcastNestedLoopJoin", "SinglePartition", "BatchEvalPython")


def summary(df) -> dict:
    plan = df._jdf.queryExecution().executedPlan().toString()
    return {
        "scans": len(re.findall(r"FileScan", plan)), "shuffles": len(re.findall(r"Exchange hashpartitioning|Exchange rangepartitioning|Exchange RoundRobin", plan)),
        "broadcasts": len(re.findall(r"BroadcastExchange", plan)), "python": len(re.findall(r"MapInArrow|MapInPandas|ArrowEvalPython|PythonMapInArrow", plan)),
        "suspect": [s for s in SUSPECT if s in plan],
    }


def main(folder: str, names: list[str]) -> None:
    spark = local_session()
    for name in names or list(QUERIES):
        print(name, summary(QUERIES[name](spark, folder)), flush=True)


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
