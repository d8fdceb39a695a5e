"""Flat rows to star rows: every cleaning and rejection rule."""

import datetime as dt
import os
from decimal import Decimal

import pytest
from conftest import flat_row, row_set

from salestide.operators.first_wins import POSITION
from salestide.operators.star import candidates, normalise, orphan_references, type_rows
from salestide.plans.load_report import accepted_keys, keys_of, load_report
from salestide.plans.refresh import keys_fit
from salestide.schemas import FLAT_HEADER
from salestide.sources.trade_tables import flat_export


@pytest.fixture(scope="module")
def typed(spark):
    schema = ", ".join([*(f"`{c}` string" for c in FLAT_HEADER), f"{POSITION} int"])

    def make(rows, **options):
        data = [(*(row[c] for c in FLAT_HEADER), i) for i, row in enumerate(rows)]
        return type_rows(spark.createDataFrame(data, schema).repartition(3), **options)

    return make


def test_row_is_typed(typed):
    star = normalise(typed([flat_row()]))
    assert row_set(star.customers) == {("c1", "Ann", "ann@example.com", "1 Low Rd, Dale")}
    assert row_set(star.products) == {("p1", "Lamp", "Light")}
    assert row_set(star.orders) == {
        ("o1", "p1", "c1", dt.date(2024, 3, 5), 2, Decimal("10.00"), Decimal("0.1000"),
         Decimal("1.50"), "Cash", "North")}


def test_first_row_wins(typed):
    star = normalise(typed([
        flat_row(order="o1", quantity="1", name="None"),
        flat_row(order="o1", quantity="2", name="Lamp"),
    ]))
    assert [r.QuantitySold for r in star.orders.collect()] == [1]
    assert [r.ProductName for r in star.products.collect()] == [None]


def test_rejected_row_does_not_claim_its_key(typed):
    star = normalise(typed([flat_row(date="soon", quantity="1"), flat_row(quantity="2")]))
    assert [r.QuantitySold for r in star.orders.collect()] == [2]


def test_rejected_order_still_adds_customer_and_product(typed):
    star = normalise(typed([flat_row(date="2024-02-30")]))
    assert (star.orders.count(), star.customers.count(), star.products.count()) == (0, 1, 1)


@pytest.mark.parametrize(
    ("missing", "customers", "products"),
    [("order", 1, 1), ("product", 1, 0), ("customer", 0, 1)],
)
def test_missing_key_drops_the_order(typed, missing, customers, products):
    star = normalise(typed([flat_row(**{missing: "NA"})]))
    assert star.orders.count() == 0
    assert (star.customers.count(), star.products.count()) == (customers, products)


def test_keys_stay_as_written(typed):
    star = normalise(typed([flat_row(order=k) for k in ("007", "7", "1002", "1002.0", "")]))
    assert {r.OrderID for r in star.orders.collect()} == {"007", "7", "1002", "1002.0"}


def test_missing_tokens_in_any_column(typed):
    star = normalise(typed([flat_row(region="NA", category="n/a", address="null")]))
    assert star.orders.first().Region is None
    assert star.products.first().Category is None
    assert star.customers.first().CustomerAddress is None
    kept = normalise(typed([flat_row(region="NA")], na_tokens=("",)))
    assert kept.orders.first().Region == "NA"


def test_unreadable_numbers_become_null_and_the_row_stays(typed):
    rows = [flat_row(order="a", price="abc"), flat_row(order="b", quantity="2.5"),
            flat_row(order="c", quantity="2.0", price="1.005")]
    got = {r.OrderID: (r.UnitPrice, r.QuantitySold) for r in normalise(typed(rows)).orders.collect()}
    assert got == {"a": (None, 2), "b": (Decimal("10.00"), Decimal("2.5")), "c": (Decimal("1.005"), 2)}


def test_date_forms_can_be_passed_in(typed):
    star = normalise(typed([flat_row(date="05/03/2024")], date_formats=("dd/MM/yyyy",)))
    assert star.orders.first().DateOfSale == dt.date(2024, 3, 5)


def test_stored_rows_win(typed):
    stored = normalise(typed([flat_row(name="Old"), flat_row(order="o2", product="p2")]))
    added = normalise(
        typed([flat_row(name="New"), flat_row(order="o3", product="p3")]), stored)
    assert {r.OrderID for r in added.orders.collect()} == {"o3"}
    assert {r.ProductID for r in added.products.collect()} == {"p3"}
    assert added.customers.count() == 0


def test_load_report(typed):
    stored = normalise(typed([flat_row(order="o1")]))
    rows = typed([
        flat_row(order="o1"),
        flat_row(order="o2", customer="c2", price="1.00005"),
        flat_row(order="o2", product="p2", quantity="x"),
        flat_row(order="o3", date="soon"),
        flat_row(order="o4", date=""),
        flat_row(order="", date="soon"),
        flat_row(product=""),
        flat_row(customer="", discount="ten"),
    ])
    got = {r.metric: r["rows"] for r in load_report(rows, keys_of(stored)).collect()}
    assert got == {
        "rows_read": 8,
        "customers_without_key": 1,
        "products_without_key": 1,
        "orders_without_key": 3,
        "orders_without_date": 2,
        "customers_accepted": 7,
        "products_accepted": 7,
        "orders_accepted": 3,
        "unreadable_DateOfSale": 2,
        "unreadable_QuantitySold": 1,
        "unreadable_UnitPrice": 0,
        "unreadable_Discount": 1,
        "unreadable_ShippingCost": 0,
        "rounded_QuantitySold": 0,
        "rounded_UnitPrice": 1,
        "rounded_Discount": 0,
        "rounded_ShippingCost": 0,
        "customers_inserted": 1,
        "customers_ignored": 6,
        "products_inserted": 1,
        "products_ignored": 6,
        "orders_inserted": 1,
        "orders_ignored": 2,
    }


def test_candidates_keep_repeats(typed):
    assert candidates(typed([flat_row()] * 3)).orders.count() == 3


def test_orphan_references(make_orders, make_products, make_customers):
    orders = make_orders([
        ("1", "A", "c1", "2024-01-01", 1, "1", "0", "0", "N"),
        ("2", "A", "c2", "2024-01-01", 1, "1", "0", "0", "N"),
        ("3", "B", "c2", "2024-01-01", 1, "1", "0", "0", "N"),
        ("4", None, "c1", "2024-01-01", 1, "1", "0", "0", "N"),
    ])
    lost = orphan_references(
        orders, make_products([("B", "b", "k")]), make_customers([("c1", "n", "e", "a")]))
    assert row_set(lost) == {("ProductID", "A", 2), ("CustomerID", "c2", 2)}


def test_load_report_of_a_first_load(typed):
    rows = typed([flat_row(order="o1"), flat_row(order="o1"), flat_row(order="o2")])
    got = {r.metric: r["rows"] for r in load_report(rows).collect()}
    assert (got["orders_inserted"], got["orders_ignored"], got["customers_inserted"]) == (2, 1, 1)


def test_load_report_of_nothing(typed):
    rows = typed([flat_row()]).where("false")
    got = {r.metric: r["rows"] for r in load_report(rows).collect()}
    assert set(got.values()) == {0} and len(got) == 23


@pytest.mark.parametrize("threshold, fits", [("-1", False), ("1k", True), ("100", False)])
def test_keys_fit_by_the_sessions_threshold(spark, typed, threshold, fits):
    rows = typed([flat_row(order=f"o{i % 3}") for i in range(100)])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        assert keys_fit(spark, rows)["orders"] is fits
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_load_report_scans_each_side_once(typed, spark):
    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    new, old = (type_rows(flat_export(spark, folder)) for _ in range(2))
    plan = load_report(new, accepted_keys(old))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("lineitem.parquet") == 2
