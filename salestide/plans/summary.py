"""Total revenue with the best product, category and region, in one scan."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salestide.functions.dates import in_range
from salestide.functions.money import as_amount, total_revenue_expr
from salestide.operators.ranking import best_group
from salestide.params import check_range

Date = dt.date | str


def revenue_summary(
    orders: DataFrame, products: DataFrame, start_date: Date, end_date: Date
) -> DataFrame:
    """One row: total_revenue, and structs top_product, top_category, top_region.

    Orders are reduced once to (product, region), which is small and keeps no
    hot rows. The three breakdowns are grouping sets over that, so orders are
    scanned and shuffled once instead of four times.

    The catalog join is a left join with a match flag: orders without a product
    row count for the total and for regions but form no product or category
    group, while a catalog product with a missing category does form one. The
    best groups are null when no order qualifies.
    """
    start, end = check_range(start_date, end_date)
    cells = (
        in_range(orders, start, end)
        .groupBy("ProductID", "Region")
        .agg(total_revenue_expr().alias("cell_revenue"))
    )
    return summarised(cells, products)


def summarised(cells: DataFrame, products: DataFrame) -> DataFrame:
    """The summary, from ``cell_revenue`` of each (ProductID, Region)."""
    catalog = products.select("ProductID", "ProductName", "Category", F.lit(True).alias("listed"))
    matched = cells.join(catalog, "ProductID", "left").select(
        "*", F.coalesce("listed", F.lit(False)).alias("in_catalog")
    )

    product, name, category = F.col("ProductID"), F.col("ProductName"), F.col("Category")
    region, flag = F.col("Region"), F.col("in_catalog")
    groups = matched.groupingSets(
        [(product, name, flag), (category, flag), (region,)],
        product,
        name,
        category,
        region,
        flag,
    ).agg(
        F.sum("cell_revenue").alias("revenue"),
        F.grouping(product).alias("not_product"),
        F.grouping(category).alias("not_category"),
        F.grouping(region).alias("not_region"),
    )

    revenue, listed = F.col("revenue"), F.col("in_catalog")
    is_product = (F.col("not_product") == 0) & listed
    is_category = (F.col("not_category") == 0) & listed
    is_region = F.col("not_region") == 0
    amount = as_amount("revenue").alias("revenue")
    total = as_amount(F.sum(F.when(is_region, revenue)))
    return groups.agg(
        F.coalesce(total, F.lit(0.0)).alias("total_revenue"),
        best_group(F.struct("ProductName", amount), revenue, F.col("ProductID"), is_product).alias(
            "top_product"
        ),
        best_group(F.struct("Category", amount), revenue, F.col("Category"), is_category).alias(
            "top_category"
        ),
        best_group(F.struct("Region", amount), revenue, F.col("Region"), is_region).alias(
            "top_region"
        ),
    )
