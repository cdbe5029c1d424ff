"""Compare registered queries with their oracle SQL: ``python -m leafmill.plans.check SF_DIR [name ...]``."""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time

import duckdb

from leafmill.plans.catalog import ORACLES, QUERIES
from leafmill.plans.fixtures import TABLES
from leafmill.session import local_session


def _plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    if isinstance(value, int):
        return f"{float(value):.9g}" if abs(value) < 10**9 else str(value)
    if isinstance(value, (datetime.datetime, datetime.date)):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(str(_plain(v)) for v in value) + "]"
    return str(value)


def _table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([_plain(r[i]) for i in order] for r in rows), key=repr)


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def compare(spark, con, folder: str, name: str) -> str:
    started = time.time()
    df = QUERIES[name](spark, folder)
    rows = df.collect()
    took = time.time() - started
    if name not in ORACLES:
        return f"rows-only {name} rows={len(rows)} {took:.1f}s"
    started = time.time()
    result = con.execute(ORACLES[name])
    columns = [c[0] for c in result.description]
    expected = _table(columns, result.fetchall())
    duck_took = time.time() - started
    if sorted(columns) != sorted(df.columns):
        return f"FAIL {name} columns {sorted(df.columns)} <> {sorted(columns)}"
    actual = _table(df.columns, rows)
    if actual == expected:
        return f"ok {name} rows={len(rows)} {took:.1f}s (duckdb {duck_took:.1f}s)"
    lines = [f"FAIL {name} rows {len(actual)} <> {len(expected)}; columns {sorted(columns)}"]
    left = [r for r in actual if r not in expected][:3] if len(actual) < 20000 else actual[:3]
    right = [r for r in expected if r not in actual][:3] if len(actual) < 20000 else expected[:3]
    lines += [f"   spark  {str(r)[:600]}" for r in left] + [f"   duckdb {str(r)[:600]}" for r in right]
    return "\n".join(lines)


def main(folder: str, names: list[str]) -> None:
    spark, con = local_session(), duck(folder)
    for name in names or list(QUERIES):
        if name.endswith("*"):
            continue
        try:
            print(compare(spark, con, folder, name), flush=True)
        except Exception as error:  # noqa: BLE001 - one query must not hide the others
            print(f"ERROR {name} {str(error)[:700]}", flush=True)


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
