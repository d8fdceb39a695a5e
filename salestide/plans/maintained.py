"""The revenue reports from maintained sums: same results, less to read.

Each takes ``SalesStore.maintained()`` where the reports over rows take the tables.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salestide.functions.dates import period_start
from salestide.functions.money import as_amount
from salestide.operators.cells import Maintained, buyers_in, cells_in
from salestide.params import PERIODS, check_choice, check_range
from salestide.plans.reports import labelled_periods, ranked_categories, ranked_products, ranked_regions
from salestide.plans.summary import summarised
from salestide.schemas import SALE_MONTH

Date = dt.date | str

MEASURES = ("revenue", "total_quantity_sold", "total_orders")


def _sums() -> list[Column]:
    return [F.sum(name).alias(name) for name in MEASURES]


def total_revenue(sales: Maintained, start_date: Date, end_date: Date) -> DataFrame:
    cells = cells_in(sales, *check_range(start_date, end_date))
    return cells.agg(F.coalesce(as_amount(F.sum("revenue")), F.lit(0.0)).alias("total_revenue"))


def revenue_by_product(
    sales: Maintained, start_date: Date, end_date: Date, limit: int | None = None
) -> DataFrame:
    cells = cells_in(sales, *check_range(start_date, end_date))
    return ranked_products(cells.groupBy("ProductID").agg(*_sums()), sales.products, limit)


def revenue_by_category(
    sales: Maintained, start_date: Date, end_date: Date, limit: int | None = None
) -> DataFrame:
    cells = cells_in(sales, *check_range(start_date, end_date))
    return ranked_categories(cells.groupBy("ProductID").agg(*_sums()), sales.products, limit)


def revenue_by_region(
    sales: Maintained, start_date: Date, end_date: Date, limit: int | None = None
) -> DataFrame:
    """Customers are counted from the buyers kept, each once however many months they
    bought in; the counts are joined by region, null included, so nothing is hot."""
    span = check_range(start_date, end_date)
    sums = cells_in(sales, *span).groupBy("Region").agg(*_sums())
    buyers = buyers_in(sales, *span).groupBy("Region").agg(
        F.count_distinct("CustomerID").alias("unique_customers")
    )
    buyers = buyers.withColumnRenamed("Region", "_region")
    joined = sums.join(buyers, F.col("Region").eqNullSafe(F.col("_region"))).drop("_region")
    return ranked_regions(joined, limit)


def revenue_trends(
    sales: Maintained, start_date: Date, end_date: Date, period: str = "monthly"
) -> DataFrame:
    check_choice(period, PERIODS, "period")
    cells = cells_in(sales, *check_range(start_date, end_date))
    first_day = period_start(SALE_MONTH, period).alias("first_day")
    return labelled_periods(cells.groupBy(first_day).agg(*_sums()), period)


def revenue_summary(sales: Maintained, start_date: Date, end_date: Date) -> DataFrame:
    cells = cells_in(sales, *check_range(start_date, end_date))
    return summarised(
        cells.groupBy("ProductID", "Region").agg(F.sum("revenue").alias("cell_revenue")), sales.products
    )
