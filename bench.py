"""Time the headline queries and print one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

The frames of orders and products are made once; each report is built on them and
run: first all of them once to warm the JVM, then RUNS times, of which the best
counts. Results are collected. The stored_* queries run on orders written in the
store's own layout. Writes are reported apart from the queries and not in their sum:
each runs once to warm up and once timed; the loads read an untidy CSV export of the
same lines and publish the result. Files go to BENCH_TMP, or the temporary folder.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from checks.spark_side import EMPTY_RANGE, RANGE, flatten_summary
from salestide.operators.star import Star
from salestide.plans.refresh import refresh
from salestide.plans.reports import (
    revenue_by_category,
    revenue_by_product,
    revenue_by_region,
    revenue_trends,
    total_revenue,
)
from salestide.plans.summary import revenue_summary
from salestide.schemas import FLAT_HEADER
from salestide.sources import trade_tables
from salestide.sources.store import SalesStore

RUNS = 2


def scratch() -> str:
    return tempfile.mkdtemp(prefix="run-", dir=os.environ.get("BENCH_TMP"))


def session(cpus: str) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def reports(prefix: str, orders: DataFrame, products: DataFrame) -> dict[str, Callable]:
    """The headline reports on given frames, by name."""
    frames = {
        "total": lambda: total_revenue(orders, *RANGE),
        "total_empty_range": lambda: total_revenue(orders, *EMPTY_RANGE),
        "total_one_month": lambda: total_revenue(orders, "1997-03-01", "1997-03-31"),
        "by_product": lambda: revenue_by_product(orders, products, *RANGE),
        "by_product_top5": lambda: revenue_by_product(orders, products, *RANGE, limit=5),
        "by_category": lambda: revenue_by_category(orders, products, *RANGE),
        "by_region": lambda: revenue_by_region(orders, *RANGE),
        "monthly": lambda: revenue_trends(orders, *RANGE),
        "quarterly": lambda: revenue_trends(orders, *RANGE, period="quarterly"),
        "summary": lambda: flatten_summary(revenue_summary(orders, products, *RANGE)),
    }
    return {f"{prefix}{name}": lambda f=f: f().collect() for name, f in frames.items()}


def stored_tables(spark: SparkSession, folder: str) -> SalesStore:
    """The tables in the store's layout, published as one load."""
    store = SalesStore(spark, scratch() + "/warehouse")
    star = Star(
        *(f(spark, folder) for f in (trade_tables.customers, trade_tables.products, trade_tables.orders))
    )
    inserted = store.write_run(1, star)
    store.publish(1, "overwrite", folder, "", {f"{t}_inserted": n for t, n in inserted.items()})
    return store


def write_export(spark: SparkSession, folder: str) -> tuple[str, str]:
    """The export as two CSV folders, one per line status."""
    target = scratch()
    flat = trade_tables.flat_export(spark, folder).repartition(16)
    for status in ("F", "O"):
        flat.where(flat.line_status == status).select(*FLAT_HEADER).write.csv(
            f"{target}/{status}", header=True, escape='"'
        )
    return f"{target}/F", f"{target}/O"


def seconds(action: Callable[[], object]) -> float:
    began = time.perf_counter()
    action()
    return time.perf_counter() - began


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session(os.environ.get("BENCH_CPUS", "8"))
    actions = reports("", trade_tables.orders(spark, folder), trade_tables.products(spark, folder))
    star = stored_tables(spark, folder).star()
    actions |= reports("stored_", star.orders, star.products)
    for action in actions.values():
        action()
    timed = {name: min(seconds(action) for _ in range(RUNS)) for name, action in actions.items()}
    writes = {"write_store": seconds(lambda: stored_tables(spark, folder))}
    first, second = write_export(spark, folder)
    for _ in range(2):
        target = scratch()
        writes["refresh_csv"] = seconds(lambda: refresh(spark, first, target, "overwrite"))
        writes["refresh_csv_append"] = seconds(lambda: refresh(spark, second, target))
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(timed.values()), 3),
                "unit": "sec",
                "queries": {name: round(t, 3) for name, t in timed.items()},
                "writes": {name: round(t, 3) for name, t in writes.items()},
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    sys.stdout.flush()
    spark.stop()


if __name__ == "__main__":
    main()
