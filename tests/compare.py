"""Compare registered queries with their SQL counterparts in DuckDB.

    python tests/compare.py [--sf 0.01] [name ...]
"""

from __future__ import annotations

import argparse
import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
ROOT = "/root/testdata/sf{sf}"


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, int):
        return value
    return str(value)


def _sorted_rows(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def _kind(value) -> str:
    return type(value).__name__


def compare(spark, con, name: str, queries, oracles, sf_dir: str) -> tuple[bool, str]:
    start = time.time()
    df = queries[name](spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    took = time.time() - start
    if name not in oracles:
        return bool(got), f"rows only: {len(got)} rows, {took:.2f}s"
    cursor = con.execute(oracles[name])
    want_columns = [d[0] for d in cursor.description]
    want = cursor.fetchall()
    if sorted(df.columns) != sorted(want_columns):
        return False, f"columns differ: {sorted(df.columns)} / {sorted(want_columns)}"
    left, right = _sorted_rows(df.columns, got), _sorted_rows(want_columns, want)
    if left != right:
        extra = [x for x in left if x not in set(right)][:2]
        lacking = [x for x in right if x not in set(left)][:2]
        return False, f"{len(left)} / {len(right)} rows; only Spark {extra}; only SQL {lacking}"
    names = sorted(df.columns)
    for i, column in enumerate(names):
        kinds = [{_kind(r[i]) for r in side if r[i] is not None} for side in (left, right)]
        if kinds[0] != kinds[1]:
            return False, f"types of {column} differ: {kinds}"
    return True, f"{len(left)} rows, {took:.2f}s"


def main() -> int:
    import __spark_entry__ as entry
    from tallygrove import get_session

    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="0.01")
    parser.add_argument("names", nargs="*")
    options = parser.parse_args()
    sf_dir = ROOT.format(sf=options.sf)
    spark = get_session("compare", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
                        spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    queries, oracles = entry.queries(), entry.oracle_sql()
    con = connect(sf_dir)
    failed = 0
    for name in options.names or queries:
        try:
            good, note = compare(spark, con, name, queries, oracles, sf_dir)
        except Exception as problem:  # noqa: BLE001 - every query is reported
            good, note = False, f"{type(problem).__name__}: {str(problem)[:600]}"
        failed += not good
        print(("ok   " if good else "FAIL ") + name, note, flush=True)
    print(f"{failed} failed")
    return int(failed > 0)


if __name__ == "__main__":
    sys.exit(main())
