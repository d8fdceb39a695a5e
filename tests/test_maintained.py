"""Reports from maintained sums against the same reports over rows."""

import datetime as dt
import random

import pytest
from conftest import flat_row, row_set, rows_of, write_csv

from salestide.operators.cells import split_range
from salestide.plans import maintained, reports, summary
from salestide.plans.refresh import compact, refresh
from salestide.sources.store import SalesStore


def export(path, seed, n=400):
    """Orders over 14 months; a third share product, region and customer."""
    rng, rows = random.Random(seed), []
    for i in range(n):
        hot = rng.random() < 1 / 3
        product = "p0" if hot else f"p{rng.randrange(20)}"
        day = dt.date(2023, 12, 1) + dt.timedelta(days=rng.randrange(420))
        rows.append(flat_row(
            order=f"o{rng.randrange(3 * n)}", product=product, name=f"n{product}",
            category=["", "k1", "k2"][len(product) % 3], customer="c0" if hot else f"c{rng.randrange(30)}",
            date=day.isoformat(), region="r0" if hot else rng.choice(["r0", "r1", ""]),
            quantity=rng.choice(["", "1", "2.5", "7"]), price=f"{rng.randrange(1, 9999) / 100}",
        ))
    return write_csv(path, rows)


RANGES = [
    ("2024-01-01", "2024-12-31"),  # whole months only
    ("2024-01-15", "2024-11-03"),
    ("2024-02-29", "2024-04-01"),
    ("2024-03-05", "2024-03-20"),  # inside of one month
    ("2024-03-20", "2024-04-10"),  # two parts, no whole month
    ("2024-05-01", "2024-05-01"),
    ("2024-06-02", "2024-06-01"),  # empty
    ("0001-01-01", "9999-12-31"),
    ("2031-01-01", "2031-12-31"),
]


def assert_same_reports(store, span, limits=(None,), periods=("monthly",)):
    star, sales = store.star(), store.maintained()
    orders, products = star.orders, star.products
    assert rows_of(maintained.total_revenue(sales, *span)) == rows_of(reports.total_revenue(orders, *span))
    for limit in limits:
        for name in ("revenue_by_product", "revenue_by_category"):
            ours = getattr(maintained, name)(sales, *span, limit)
            theirs = getattr(reports, name)(orders, products, *span, limit)
            assert ours.schema.names == theirs.schema.names and rows_of(ours) == rows_of(theirs)
        ours = maintained.revenue_by_region(sales, *span, limit)
        assert rows_of(ours) == rows_of(reports.revenue_by_region(orders, *span, limit))
    for period in periods:
        ours = maintained.revenue_trends(sales, *span, period)
        assert rows_of(ours) == rows_of(reports.revenue_trends(orders, *span, period))
    ours = maintained.revenue_summary(sales, *span)
    assert rows_of(ours) == rows_of(summary.revenue_summary(orders, products, *span))


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    home = tmp_path_factory.mktemp("maintained")
    for load in range(3):
        refresh(spark, export(home / f"{load}.csv", load), str(home / "w"))
    return SalesStore(spark, str(home / "w"))


@pytest.mark.parametrize("span", RANGES[1:])
def test_equal_to_reports_over_rows(store, span):
    assert_same_reports(store, span)


def test_limits_and_periods(store):
    assert_same_reports(store, RANGES[0], (3, 0), ("quarterly", "yearly"))


def test_every_range_is_cut_into_days_once():
    rng = random.Random(5)
    for _ in range(2000):
        start = dt.date(2023, 11, 1) + dt.timedelta(days=rng.randrange(200))
        end = start + dt.timedelta(days=rng.randrange(-5, 130))
        whole, edges = split_range(start, end)
        days = [d for a, b in [*edges, *([whole] if whole else [])] for d in range(a.toordinal(), b.toordinal() + 1)]
        assert sorted(days) == list(range(start.toordinal(), end.toordinal() + 1))
        if whole:
            assert whole[0].day == 1 and (whole[1] + dt.timedelta(days=1)).day == 1
        assert all((a.year, a.month) == (b.year, b.month) for a, b in edges) or not whole


def test_whole_months_read_no_order_rows(store):
    frame = maintained.total_revenue(store.maintained(), "2024-01-01", "2024-12-31")
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "cells" in plan and "UnitPrice" not in plan
    edges = maintained.total_revenue(store.maintained(), "2024-01-15", "2024-12-31")
    plan = edges._jdf.queryExecution().executedPlan().toString()
    assert "UnitPrice" in plan and "PartitionFilters: [isnotnull(SaleMonth" in plan
    assert set(plan.split("CustomerID")) == {plan}  # not read


def test_runs_without_sums_come_as_rows(spark, tmp_path):
    home = str(tmp_path / "w")
    refresh(spark, export(tmp_path / "1.csv", 1), home)
    store = SalesStore(spark, home)
    # A run as an older version left it: orders that no log line calls summed.
    version = store.next_version()
    other = SalesStore(spark, str(tmp_path / "other"))
    refresh(spark, export(tmp_path / "2.csv", 2), other.root)
    star = other.star()
    known = store.orders().select("OrderID")
    star = type(star)(
        star.customers.where("false"), star.products.where("false"),
        star.orders.join(known, "OrderID", "left_anti").drop("SaleMonth"),
    )
    inserted = store.write_run(version, star)
    store.publish(version, "append", "old", "", {f"{t}_inserted": n for t, n in inserted.items()})
    assert store.maintained().unsummed.count() == inserted["orders"] > 0
    assert_same_reports(store, RANGES[1])
    compact(spark, home)
    sales = store.maintained()
    assert sales.unsummed is None
    whole = maintained.total_revenue(sales, *RANGES[0])
    assert rows_of(whole) == rows_of(reports.total_revenue(store.orders(), *RANGES[0]))


def test_sums_follow_overwrite_and_compaction(spark, tmp_path):
    home = str(tmp_path / "w")
    for load in range(3):
        refresh(spark, export(tmp_path / f"{load}.csv", load, 80), home)
    store, before = SalesStore(spark, home), RANGES[1]
    rows = row_set(maintained.revenue_by_region(store.maintained(), *before))
    assert compact(spark, home) and row_set(maintained.revenue_by_region(store.maintained(), *before)) == rows
    assert store.drop_replaced_runs()
    assert sorted(p.name for p in (tmp_path / "w" / "cells").iterdir()) == ["run=4"]
    refresh(spark, export(tmp_path / "new.csv", 9, 60), home, "overwrite")
    assert_same_reports(store, before)
    assert store.maintained().cells.agg({"total_orders": "sum"}).first()[0] == store.orders().count()


def test_empty_store(spark, tmp_path):
    sales = SalesStore(spark, str(tmp_path / "none")).maintained()
    assert rows_of(maintained.total_revenue(sales, *RANGES[1])) == [(0.0,)]
    assert rows_of(maintained.revenue_by_region(sales, *RANGES[1])) == []
