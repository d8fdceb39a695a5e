"""Run every registered query on both engines and compare whole results.

    python -m checks.compare [folder] [query ...]
"""

from __future__ import annotations

import sys
import time
from collections import Counter

import duckdb
from pyspark.sql import SparkSession

from checks.duckdb_side import ORACLE_SQL
from checks.spark_side import QUERIES

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")


def differences(spark: SparkSession, folder: str, name: str) -> list[str]:
    """What is unequal: column names, or rows held by one side only."""
    frame = QUERIES[name](spark, folder)
    with duckdb.connect() as db:
        for table in TABLES:
            db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
        result = db.execute(ORACLE_SQL[name])
        theirs_columns = [c[0] for c in result.description]
        theirs = result.fetchall()
    columns = sorted(frame.columns)
    if columns != sorted(theirs_columns):
        return [f"columns {columns} against {sorted(theirs_columns)}"]
    place = [theirs_columns.index(c) for c in columns]
    ours = Counter(tuple(row) for row in frame.select(*columns).collect())
    theirs = Counter(tuple(row[i] for i in place) for row in theirs)
    only = [f"only in Spark: {row}" for row in (ours - theirs)]
    return only + [f"only in SQL: {row}" for row in (theirs - ours)]


def main() -> int:
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    failed = 0
    for name in names:
        began = time.time()
        found = differences(spark, folder, name)
        failed += bool(found)
        print(f"{name}: {'equal' if not found else f'{len(found)} differ'} "
              f"({time.time() - began:.1f} s)", flush=True)
        for line in found[:4]:
            print("   ", line)
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
