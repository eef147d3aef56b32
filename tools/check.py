"""Run registered queries in Spark and DuckDB and compare the rows.

python tools/check.py [--folder DIR] [--cores N] [name-prefix ...]
"""

from __future__ import annotations

import argparse
import datetime
import os
import sys
import time
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import duckdb  # noqa: E402

from plotweave.registry import spark_queries, sql_queries  # noqa: E402
from plotweave.session import local_session  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet')")
    return con


def plain(value):
    if value is None or isinstance(value, (bool, int, str)):
        return (type(value).__name__, value)
    if isinstance(value, float):
        return ("float", repr(value))
    if isinstance(value, (datetime.date, datetime.datetime)):
        return ("time", str(value))
    if isinstance(value, (list, tuple)):
        return ("list", tuple(plain(v) for v in value))
    return (type(value).__name__, str(value))


def as_counter(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(plain(r[i]) for i in order) for r in rows)


def compare(con, frame, sql):
    """Empty string when equal, else what differs."""
    spark_rows = frame.collect()
    cursor = con.execute(sql)
    sql_rows = cursor.fetchall()
    left_names, left = as_counter(frame.columns, spark_rows)
    right_names, right = as_counter([d[0] for d in cursor.description], sql_rows)
    if left_names != right_names:
        return f"columns {left_names} vs {right_names}", len(spark_rows)
    if left != right:
        extra = list((left - right).items())[:2]
        missing = list((right - left).items())[:2]
        return f"rows {sum(left.values())} vs {sum(right.values())}\n  spark {extra}\n  sql   {missing}", len(spark_rows)
    return "", len(spark_rows)


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--folder", default="/root/testdata/sf0.001")
    parser.add_argument("--cores", default="8")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    spark = local_session(args.cores)
    con = connect(args.folder)
    sqls = sql_queries()
    bad = 0
    for name, run in spark_queries().items():
        if args.names and not any(name.startswith(p) for p in args.names):
            continue
        begin = time.time()
        try:
            frame = run(spark, args.folder)
            if name in sqls:
                problem, count = compare(con, frame, sqls[name])
            else:
                problem, count = "", frame.count()
            kind = "sql" if name in sqls else "rows only"
        except Exception as error:  # report and go on with the next query
            text = str(error)
            problem, count, kind = f"{type(error).__name__}: {text[:900]}", -1, "error"
        bad += bool(problem)
        print(f"{'FAIL' if problem else 'ok  '} {name:44s} {count:8d} rows {time.time() - begin:6.2f}s {kind} {problem}", flush=True)
    print("failed:", bad)
    return bool(bad)


if __name__ == "__main__":
    os._exit(main())
