"""Run registered queries against their DuckDB text. `python tests/oracle_check.py [--sf DIR] [name ...]`."""

from __future__ import annotations

import argparse
import math
import os
import sys
import time
import traceback

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def normal(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "\x00"
    if hasattr(value, "isoformat"):
        text = value.isoformat()
        return text[:-9] if text.endswith("T00:00:00") else text
    if isinstance(value, float):
        return f"{value:.6f}"
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(normal(row[i]) for i in order) for row in rows), [columns[i] for i in order]


def compare(spark, name, run, sql, sf, db):
    started = time.time()
    df = run(spark, sf)
    got, names = rows_of(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - started
    if sql is None:
        return f"{name}: rows only, {len(got)} rows, {took:.1f}s", True
    started = time.time()
    cursor = db.execute(sql)
    want, wanted_names = rows_of([d[0] for d in cursor.description], cursor.fetchall())
    duck = time.time() - started
    if names != wanted_names:
        return f"{name}: COLUMNS {names} != {wanted_names}", False
    if got != want:
        extra = [r for r in got if r not in set(want)][:3]
        lost = [r for r in want if r not in set(got)][:3]
        return f"{name}: DIFFERENT {len(got)} vs {len(want)} rows\n  {names}\n  only spark {extra}\n  only duckdb {lost}", False
    empty = "  (EMPTY)" if not got else ""
    return f"{name}: ok, {len(got)} rows, {took:.1f}s (duckdb {duck:.1f}s){empty}", True


def connect(sf):
    db = duckdb.connect()
    for file in sorted(os.listdir(sf)):
        if file.endswith(".parquet"):
            db.execute(f"create view {file[:-8]} as select * from '{sf}/{file}'")
    return db


def main():
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    import __spark_entry__ as entry
    from staffscope import session
    spark = session.build("local[8]", 8, **{"spark.driver.memory": "12g", "spark.ui.enabled": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    queries, sqls, db = entry.queries(), entry.oracle_sql(), connect(args.sf)
    bad = []
    for name in args.names or queries:
        try:
            line, ok = compare(spark, name, queries[name], sqls.get(name), args.sf, db)
        except Exception as error:
            line, ok = f"{name}: FAILED {type(error).__name__}: {str(error)[:1200]}", False
            if os.environ.get("TRACE"):
                traceback.print_exc()
        print(line, flush=True)
        if not ok:
            bad.append(name)
    print(f"{len(bad)} bad: {bad}" if bad else "all ok")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
