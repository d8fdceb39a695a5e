"""Reports on small tables with values worked out by hand."""

import pytest
from conftest import rows_of

from salestide.plans.reports import (
    result_rows,
    revenue_by_category,
    revenue_by_product,
    revenue_by_region,
    revenue_trends,
    total_revenue,
)
from salestide.plans.summary import revenue_summary

YEAR = ("2024-01-01", "2024-12-31")

# revenue: a1 95, a2 185, b1 30.5, b2 61, x1 12, d1 none (no price), old 100
ORDERS = [
    ("a1", "A", "c1", "2024-01-01", 1, "100.00", "0.1", "5.00", "North"),
    ("a2", "A", "c2", "2024-02-29", 2, "100.00", "0.1", "5.00", "South"),
    ("b1", "B", "c1", "2024-04-10", 3, "10.00", "0", "0.50", "North"),
    ("b2", "B", "c1", "2024-12-31", 6, "10.00", "0", "1.00", None),
    ("x1", "X", "c3", "2024-04-30", 1, "12.00", "0", "0.00", "South"),
    ("d1", "D", "c3", "2024-07-01", 4, None, "0", "1.00", "East"),
    ("old", "A", "c9", "2023-12-31", 1, "100.00", "0", "0.00", "North"),
]
PRODUCTS = [
    ("A", "Desk", "Wood"),
    ("B", "Lamp", None),
    ("C", "Sofa", "Wood"),
    ("D", "Dish", "Clay"),
]


@pytest.fixture(scope="module")
def orders(make_orders):
    return make_orders(ORDERS)


@pytest.fixture(scope="module")
def products(make_products):
    return make_products(PRODUCTS)


def test_total(orders):
    assert rows_of(total_revenue(orders, *YEAR)) == [(383.5,)]


def test_total_counts_orders_without_product_row(orders):
    assert rows_of(total_revenue(orders, "2024-04-30", "2024-04-30")) == [(12.0,)]


@pytest.mark.parametrize("dates", [("2031-01-01", "2031-12-31"), YEAR[::-1]])
def test_empty_range(orders, products, dates):
    assert rows_of(total_revenue(orders, *dates)) == [(0.0,)]
    assert rows_of(revenue_by_product(orders, products, *dates)) == []
    assert rows_of(revenue_by_category(orders, products, *dates)) == []
    assert rows_of(revenue_by_region(orders, *dates)) == []
    assert rows_of(revenue_trends(orders, *dates)) == []
    assert rows_of(revenue_summary(orders, products, *dates)) == [(0.0, None, None, None)]


def test_by_product(orders, products):
    report = revenue_by_product(orders, products, *YEAR)
    assert report.columns == [
        "ProductID", "ProductName", "revenue", "total_quantity_sold", "total_orders"]
    assert rows_of(report) == [
        ("A", "Desk", 280.0, 3, 2),
        ("B", "Lamp", 91.5, 9, 2),
        ("D", "Dish", None, 4, 1),
    ]


def test_by_category(orders, products):
    report = revenue_by_category(orders, products, *YEAR)
    assert report.columns == [
        "Category", "revenue", "total_quantity_sold", "unique_products", "total_orders"]
    assert rows_of(report) == [
        ("Wood", 280.0, 3, 1, 2),
        (None, 91.5, 9, 1, 2),
        ("Clay", None, 4, 1, 1),
    ]


def test_by_region(orders):
    report = revenue_by_region(orders, *YEAR)
    assert report.columns == [
        "Region", "revenue", "total_quantity_sold", "unique_customers", "total_orders"]
    assert rows_of(report) == [
        ("South", 197.0, 3, 2, 2),
        ("North", 125.5, 4, 1, 2),
        (None, 61.0, 6, 1, 1),
        ("East", None, 4, 1, 1),
    ]


def test_trends(orders):
    assert rows_of(revenue_trends(orders, *YEAR)) == [
        ("2024-01", 95.0, 1, 1),
        ("2024-02", 185.0, 2, 1),
        ("2024-04", 42.5, 4, 2),
        ("2024-07", None, 4, 1),
        ("2024-12", 61.0, 6, 1),
    ]
    assert rows_of(revenue_trends(orders, *YEAR, period="quarterly")) == [
        ("2024-Q1", 280.0, 3, 2),
        ("2024-Q2", 42.5, 4, 2),
        ("2024-Q3", None, 4, 1),
        ("2024-Q4", 61.0, 6, 1),
    ]
    assert rows_of(revenue_trends(orders, "2023-01-01", "2024-12-31", "yearly")) == [
        ("2023", 100.0, 1, 1),
        ("2024", 383.5, 17, 6),
    ]


def test_summary(orders, products):
    assert rows_of(revenue_summary(orders, products, *YEAR)) == [
        (383.5, ("Desk", 280.0), ("Wood", 280.0), ("South", 197.0))]


def test_summary_groups_can_be_missing_values(orders, products):
    one_day = ("2024-12-31", "2024-12-31")
    assert rows_of(revenue_summary(orders, products, *one_day)) == [
        (61.0, ("Lamp", 61.0), (None, 61.0), (None, 61.0))]


def test_summary_of_orphans_has_a_region_only(orders, products):
    one_day = ("2024-04-30", "2024-04-30")
    assert rows_of(revenue_summary(orders, products, *one_day)) == [
        (12.0, None, None, ("South", 12.0))]


def test_summary_of_unpriced_orders_names_them(orders, products):
    one_day = ("2024-07-01", "2024-07-01")
    assert rows_of(revenue_summary(orders, products, *one_day)) == [
        (0.0, ("Dish", None), ("Clay", None), ("East", None))]


@pytest.mark.parametrize(("limit", "rows"), [(None, 3), (0, 3), (-1, 3), (2, 2), (99, 3)])
def test_limit(orders, products, limit, rows):
    every = rows_of(revenue_by_product(orders, products, *YEAR))
    report = revenue_by_product(orders, products, *YEAR, limit=limit)
    assert rows_of(report) == every[:rows]
    assert result_rows(report).first()[0] == rows


def test_ties_go_to_the_smaller_key(make_orders, make_products):
    sold = [(k, k, "c", "2024-01-01", 1, "7.00", "0", "0", r)
            for k, r in (("b", "W"), ("a", "V"), ("c", None))]
    orders = make_orders(sold)
    products = make_products([(k, k.upper(), t) for k, t in (("a", "z"), ("b", "y"), ("c", None))])
    assert [r[0] for r in rows_of(revenue_by_product(orders, products, *YEAR))] == ["a", "b", "c"]
    assert [r[0] for r in rows_of(revenue_by_product(orders, products, *YEAR, 2))] == ["a", "b"]
    assert [r[0] for r in rows_of(revenue_by_region(orders, *YEAR))] == [None, "V", "W"]
    assert rows_of(revenue_summary(orders, products, *YEAR)) == [
        (21.0, ("A", 7.0), (None, 7.0), (None, 7.0))]


def test_range_applies_before_ranking(orders, products):
    assert rows_of(revenue_by_product(orders, products, "2024-03-01", "2024-12-31", 1)) == [
        ("B", "Lamp", 91.5, 9, 2)]


def test_rows_without_order_id_are_not_counted(spark, make_orders):
    rows = make_orders(ORDERS[:2]).drop("OrderID")
    orders = rows.selectExpr("IF(Region = 'North', NULL, 'o') AS OrderID", "*")
    assert rows_of(revenue_trends(orders, *YEAR, "yearly")) == [("2024", 280.0, 3, 1)]


@pytest.mark.parametrize(
    "call",
    [
        lambda o, p: total_revenue(o, "invalid-date", "2024-12-31"),
        lambda o, p: revenue_by_product(o, p, "2024-01-01", "31/12/2024"),
        lambda o, p: revenue_by_region(o, None, None),
        lambda o, p: revenue_trends(o, *YEAR, period="weekly"),
        lambda o, p: revenue_by_category(o, p, *YEAR, limit="many"),
    ],
)
def test_bad_parameters(orders, products, call):
    with pytest.raises(ValueError):
        call(orders, products)
