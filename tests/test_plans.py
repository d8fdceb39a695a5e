"""Physical plans: what is read, what is shuffled, what is never planned."""

import datetime as dt
import os
import re

import pytest
from conftest import flat_row, write_csv

from salestide.operators.first_wins import POSITION, first_wins, insert_or_ignore
from salestide.plans.refresh import refresh
from salestide.plans.reports import (
    revenue_by_category,
    revenue_by_product,
    revenue_by_region,
    revenue_trends,
    total_revenue,
)
from salestide.plans.summary import revenue_summary
from salestide.sources import trade_tables
from salestide.sources.store import SalesStore

FEBRUARY = ("2024-02-05", "2024-03-10")


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("plans")
    rows = [flat_row(order=str(i), date=f"2024-{i}-07") for i in range(1, 13)]
    refresh(spark, write_csv(folder / "s.csv", rows), str(folder / "warehouse"))
    return SalesStore(spark, str(folder / "warehouse"))


def plan_of(frame) -> str:
    return frame._jdf.queryExecution().explainString(
        frame.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


@pytest.fixture(scope="module")
def plans(store):
    orders, products = store.orders(), store.products()
    return {
        "total": plan_of(total_revenue(orders, *FEBRUARY)),
        "product": plan_of(revenue_by_product(orders, products, *FEBRUARY)),
        "product_top": plan_of(revenue_by_product(orders, products, *FEBRUARY, limit=3)),
        "category": plan_of(revenue_by_category(orders, products, *FEBRUARY)),
        "region": plan_of(revenue_by_region(orders, *FEBRUARY)),
        "trends": plan_of(revenue_trends(orders, *FEBRUARY)),
        "summary": plan_of(revenue_summary(orders, products, *FEBRUARY)),
    }


def orders_scan(plan: str) -> str:
    return next(p for p in plan.split("\n\n") if "Scan parquet" in p and "/orders/" in p)


def test_date_range_reaches_the_scan(plans):
    for plan in plans.values():
        scan = orders_scan(plan)
        assert "(SaleMonth" in re.search(r"PartitionFilters: (.*)", scan)[1]
        assert "GreaterThanOrEqual(DateOfSale,2024-02-05)" in scan
        assert "LessThanOrEqual(DateOfSale,2024-03-10)" in scan


def test_only_the_months_in_range_are_opened(store):
    sold = total_revenue(store.orders(), *FEBRUARY)
    sold.collect()
    scans = sold._jdf.queryExecution().executedPlan().toString()
    assert "SaleMonth" in scans
    months = [r[0] for r in store.orders().where(
        "SaleMonth BETWEEN '2024-02-01' AND '2024-03-01'").select("SaleMonth").collect()]
    assert set(months) == {dt.date(2024, 2, 1), dt.date(2024, 3, 1)}


def test_only_needed_columns_are_read(plans):
    money = {"DateOfSale", "QuantitySold", "UnitPrice", "Discount", "ShippingCost"}
    extra = {
        "total": set(),
        "product": {"ProductID"},
        "product_top": {"ProductID"},
        "category": {"ProductID"},
        "region": {"CustomerID", "Region"},
        "trends": set(),
        "summary": {"ProductID", "Region"},
    }
    for name, plan in plans.items():
        schema = re.search(r"ReadSchema: struct<(.*)>", orders_scan(plan))[1]
        assert set(re.findall(r"(\w+):", schema)) == money | extra[name], name


def test_orders_are_scanned_once(plans):
    for name, plan in plans.items():
        tree = plan.split("\n\n")
        assert sum("Scan parquet" in p and "/orders/" in p for p in tree) == 1, name


def test_no_python_no_nested_loops_no_windows(plans):
    for plan in plans.values():
        for operator in ("Python", "Cartesian", "NestedLoop", "Window"):
            assert operator not in plan


def test_groups_are_reduced_before_every_shuffle(plans):
    for name in ("product", "category", "trends", "summary"):
        tree = plans[name].split("\n\n")[0].splitlines()
        lowest = max(i for i, line in enumerate(tree) if "Exchange (" in line
                     and "BroadcastExchange" not in line)
        assert "HashAggregate" in tree[lowest + 1], name


def test_a_limit_plans_as_top_n(plans):
    assert "TakeOrderedAndProject" in plans["product_top"]
    assert "TakeOrderedAndProject" not in plans["product"]


def test_category_needs_no_distinct_aggregate(plans):
    assert "distinct" not in plans["category"]
    assert "Expand" not in plans["category"]


def test_summary_expands_reduced_rows(plans):
    tree = plans["summary"].split("\n\n")[0].splitlines()
    expand = next(i for i, line in enumerate(tree) if "Expand" in line)
    below = tree[expand:]
    assert sum("HashAggregate" in line for line in below) == 2


def test_first_wins_reduces_before_the_shuffle(spark):
    rows = spark.createDataFrame([("k", "a", 1)], f"k string, a string, {POSITION} int")
    tree = plan_of(first_wins(rows, "k")).split("\n\n")[0].splitlines()
    shuffles = [i for i, line in enumerate(tree) if "Exchange" in line]
    assert len(shuffles) == 1
    assert "SortAggregate" in tree[shuffles[0] + 1]


def test_small_loads_do_not_shuffle_the_store(spark, store):
    schema = f"OrderID string, Region string, {POSITION} int"
    rows = spark.createDataFrame([("1", "N", 1)], schema)
    plan = plan_of(insert_or_ignore(rows, store.orders(), "OrderID", keys_fit_broadcast=True))
    assert "SortMergeJoin" not in plan
    assert plan.count("BroadcastHashJoin LeftAnti") and plan.count("BroadcastHashJoin LeftSemi")
    assert re.search(r"ReadSchema: struct<OrderID:string>", plan)


def test_large_loads_join_on_the_partitioning_they_have(spark, store):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spark.createDataFrame([("1", "N", 1)], f"OrderID string, Region string, {POSITION} int")
        plan = plan_of(insert_or_ignore(rows, store.orders(), "OrderID"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    tree = plan.split("\n\n")[0]
    assert "SortMergeJoin LeftAnti" in tree
    assert len(re.findall(r"[- ]Exchange \(", tree)) == 2


@pytest.fixture(scope="module")
def skewed_tables(spark, tmp_path_factory):
    """Order-line tables in which one part has a third of the lines."""
    folder = tmp_path_factory.mktemp("skewed")
    day = "TIMESTAMP_NTZ '1997-05-05 00:00:00'"
    rows = {
        "lineitem": (60000, "id % 5000, IF(id % 3 = 0, 0, id % 40), 1L, CAST(id % 7 AS int), "
                            "CAST(1 + pmod(xxhash64(id), 50) AS double), 1.0D, "
                            f"pmod(xxhash64(-id), 1000) / 10000D, 0.0D, 'A', 'F', {day}"),
        "orders": (5000, f"id, id % 100, 'F', 1.0D, {day}, 'LOW'"),
        "customer": (100, "id, CONCAT('c', id), CAST(id % 5 AS int), 1.0D, 's'"),
        "nation": (5, "CAST(id AS int), CONCAT('n', id), CAST(id % 2 AS int)"),
        "region": (2, "CAST(id AS int), CONCAT('r', id)"),
        "part": (40, "id, CONCAT('p', id), 'b', 'k', 5, 10.0D"),
    }
    for name, (count, values) in rows.items():
        columns = [c.split()[0] for c in trade_tables.SCHEMAS[name].split(", ")]
        frame = spark.range(count, numPartitions=4).selectExpr(*split_values(values)).toDF(*columns)
        frame.write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def split_values(values: str) -> list[str]:
    """Split at commas outside parentheses."""
    return re.split(r", (?![^(]*\))", values)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no test tables")
def test_lines_are_never_the_broadcast_side(spark):
    orders = trade_tables.orders(spark, "/root/testdata/sf0.1")
    tree = plan_of(total_revenue(orders, "1996-01-01", "1998-12-31")).split("\n\n")[0]
    assert "BroadcastHashJoin" in tree
    assert "BuildLeft" not in tree


def test_hot_join_keys_are_split_at_run_time(spark, skewed_tables):
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "50k",
        # on so little data merging would leave one task, and nothing to split by
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }

    def report():
        return revenue_by_product(
            trade_tables.orders(spark, skewed_tables),
            trade_tables.products(spark, skewed_tables),
            "1997-01-01",
            "1997-12-31",
        )

    expected = report().collect()
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        split = report()
        rows = split.collect()
        plan = split._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin(skew=true) [l_partkey" in plan
    finally:
        for name in settings:
            spark.conf.unset(name)
    assert rows == expected
    assert rows[0].ProductID == "0" and rows[0].total_orders > 20000
    assert sum(r.total_orders for r in rows) == 60000
