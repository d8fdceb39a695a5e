"""Revenue reports over a closed date range: total, breakdowns, trends.

Every function takes DataFrames and returns a lazy DataFrame. Amounts are summed
and ranked as exact decimals and become doubles in the last projection.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salestide.functions.dates import in_range, period_label, period_start
from salestide.functions.money import as_amount, total_revenue_expr
from salestide.operators.grouping import measures, per_product, with_catalog
from salestide.operators.ranking import rank_by_revenue
from salestide.params import PERIODS, check_choice, check_limit, check_range

Date = dt.date | str


def total_revenue(orders: DataFrame, start_date: Date, end_date: Date) -> DataFrame:
    """One row; 0.0 when nothing was sold."""
    start, end = check_range(start_date, end_date)
    total = F.coalesce(as_amount(total_revenue_expr()), F.lit(0.0))
    return in_range(orders, start, end).agg(total.alias("total_revenue"))


def revenue_by_product(
    orders: DataFrame,
    products: DataFrame,
    start_date: Date,
    end_date: Date,
    limit: int | None = None,
) -> DataFrame:
    """Per product id and name, best first. Orders without a product row are left out."""
    start, end = check_range(start_date, end_date)
    return ranked_products(per_product(in_range(orders, start, end)), products, limit)


def ranked_products(sums: DataFrame, products: DataFrame, limit: int | None = None) -> DataFrame:
    """The product report, from the measures of each product id."""
    sold = with_catalog(sums, products, "ProductName")
    return rank_by_revenue(sold, "ProductID", limit).select(
        "ProductID",
        "ProductName",
        as_amount("revenue").alias("revenue"),
        as_amount("total_quantity_sold").alias("total_quantity_sold"),
        "total_orders",
    )


def revenue_by_category(
    orders: DataFrame,
    products: DataFrame,
    start_date: Date,
    end_date: Date,
    limit: int | None = None,
) -> DataFrame:
    """Per category, best first; a missing category is a group of its own.

    After the per-product step each row is one product, so the distinct count
    of products sold is a plain count: no distinct aggregate over the orders.
    """
    start, end = check_range(start_date, end_date)
    return ranked_categories(per_product(in_range(orders, start, end)), products, limit)


def ranked_categories(sums: DataFrame, products: DataFrame, limit: int | None = None) -> DataFrame:
    """The category report, from the measures of each product id."""
    sold = with_catalog(sums, products, "Category")
    categories = sold.groupBy("Category").agg(
        F.sum("revenue").alias("revenue"),
        F.sum("total_quantity_sold").alias("total_quantity_sold"),
        F.count("*").alias("unique_products"),
        F.sum("total_orders").alias("total_orders"),
    )
    return rank_by_revenue(categories, "Category", limit).select(
        "Category",
        as_amount("revenue").alias("revenue"),
        as_amount("total_quantity_sold").alias("total_quantity_sold"),
        "unique_products",
        "total_orders",
    )


def revenue_by_region(
    orders: DataFrame, start_date: Date, end_date: Date, limit: int | None = None
) -> DataFrame:
    """Per region of the order, best first; a missing region is a group of its own.

    The exact distinct count shuffles pre-aggregated (region, customer) pairs,
    so a hot region or customer is spread and reduced before it moves.
    """
    start, end = check_range(start_date, end_date)
    sold = in_range(orders, start, end)
    regions = sold.groupBy("Region").agg(
        *measures(sold), F.count_distinct("CustomerID").alias("unique_customers")
    )
    return ranked_regions(regions, limit)


def ranked_regions(regions: DataFrame, limit: int | None = None) -> DataFrame:
    """The region report, from the measures and customers of each region."""
    return rank_by_revenue(regions, "Region", limit).select(
        "Region",
        as_amount("revenue").alias("revenue"),
        as_amount("total_quantity_sold").alias("total_quantity_sold"),
        "unique_customers",
        "total_orders",
    )


def revenue_trends(
    orders: DataFrame, start_date: Date, end_date: Date, period: str = "monthly"
) -> DataFrame:
    """Per month, quarter or year in time order. Periods without sales are absent.

    Grouped by the period's first day; the text label is made once per group.
    """
    check_choice(period, PERIODS, "period")
    start, end = check_range(start_date, end_date)
    sold = in_range(orders, start, end)
    periods = sold.groupBy(period_start("DateOfSale", period).alias("first_day")).agg(
        *measures(sold)
    )
    return labelled_periods(periods, period)


def labelled_periods(periods: DataFrame, period: str) -> DataFrame:
    """The trend report, from the measures of each period's first day."""
    return periods.orderBy("first_day").select(
        period_label("first_day", period).alias("period"),
        as_amount("revenue").alias("revenue"),
        as_amount("total_quantity_sold").alias("total_quantity_sold"),
        "total_orders",
    )


def result_rows(report: DataFrame, limit: int | None = None) -> DataFrame:
    """Number of rows a report returns, after its limit."""
    limit = check_limit(limit)
    report = report if limit is None else report.limit(limit)
    return report.agg(F.count("*").alias("result_rows"))
