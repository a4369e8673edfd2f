"""Run queries against their SQL: ``python tests/compare.py [folder] [name ...]``."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb
from pyspark.sql import SparkSession

import __spark_entry__ as entry


def cell(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return ""
    if isinstance(value, float):
        return repr(round(value, 6))
    return str(value)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(cell(row[i]) for i in order) for row in rows)


def oracle(folder):
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[:-8]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def compare(spark, con, folder, name):
    """None when equal, else what differs."""
    return compare_frame(entry.queries()[name](spark, folder), con, name)


def compare_frame(df, con, name):
    ours = rows_of(df.columns, [tuple(r) for r in df.collect()])
    text = entry.oracle_sql().get(name)
    if text is None:
        return None
    result = con.execute(text)
    names = [d[0] for d in result.description]
    theirs = rows_of(names, result.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    if ours != theirs:
        extra = [r for r in ours if r not in theirs][:2] if len(ours) < 5000 else ours[:2]
        missing = [r for r in theirs if r not in ours][:2] if len(ours) < 5000 else theirs[:2]
        return f"{len(ours)} rows vs {len(theirs)}: ours {extra} theirs {missing}"
    return None


def main(folder, names):
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false").config("spark.driver.memory", "8g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, failed = oracle(folder), 0
    for name in names or entry.queries():
        started = time.time()
        try:
            problem = compare(spark, con, folder, name)
        except Exception as exc:
            problem = f"{type(exc).__name__}: {str(exc)[:600]}"
        failed += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} {time.time() - started:.2f}s"
              + (f"\n     {problem}" if problem else ""), flush=True)
    print(f"{failed} failed")


if __name__ == "__main__":
    main(sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01", sys.argv[2:])
