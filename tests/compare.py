"""Runs registered queries next to their SQL in an in-process DuckDB and compares all rows.

    python tests/compare.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def _cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "<null>"
    return repr(float(v)) if type(v).__name__ in ("float", "Decimal") else repr(v)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def differences(spark_df, con, sql):
    """An empty list when columns and rows agree."""
    have = _rows(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    result = con.execute(sql)
    want = _rows([d[0] for d in result.description], result.fetchall())
    if have[0] != want[0]:
        return [f"columns {have[0]} != {want[0]}"]
    if len(have[1]) != len(want[1]):
        return [f"{len(have[1])} rows, SQL has {len(want[1])}"]
    return [f"{a} != {b}" for a, b in zip(have[1], want[1]) if a != b]


def main() -> int:
    import __spark_entry__ as entry
    from chorale.session import local_session

    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and "/" in args[0] else "/root/testdata/sf0.01"
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con, sql, bad = duck(sf_dir), entry.oracle_sql(), 0
    for name, fn in entry.queries().items():
        if args and name not in args:
            continue
        start = time.time()
        try:
            df = fn(spark, sf_dir)
            diff = differences(df, con, sql[name]) if name in sql else []
            state = "ok" if name in sql else f"rows only ({df.count()})"
        except Exception as e:  # noqa: BLE001 - report and go on
            diff, state = [f"{type(e).__name__}: {str(e)[:600]}"], "error"
        bad += bool(diff)
        print(f"{name:32s} {time.time() - start:6.2f}s {'DIFF ' + str(len(diff)) if diff else state}")
        for line in diff[:3]:
            print("     ", line[:700])
    print("queries with differences:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
