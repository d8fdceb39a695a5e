"""Revenue aggregates per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salestide.functions.money import total_revenue_expr


def count_orders(orders: DataFrame) -> Column:
    """Number of rows with an order id.

    When the loader vouches for the key there is nothing to test, and the
    order id, the widest column of the fact table, need not be read at all.
    """
    is_key = orders.schema["OrderID"].metadata.get("primary_key", False)
    return F.count("*") if is_key else F.count("OrderID")


def measures(orders: DataFrame) -> list[Column]:
    """The three measures every grouped report shares; revenue still exact."""
    return [
        total_revenue_expr().alias("revenue"),
        F.sum("QuantitySold").alias("total_quantity_sold"),
        count_orders(orders).alias("total_orders"),
    ]


def per_product(orders: DataFrame) -> DataFrame:
    """One row per product id, before any join.

    Joining after this step means a hot product enters the join as one row, and
    the catalog is matched against the number of products, not of orders.
    """
    return orders.groupBy("ProductID").agg(*measures(orders))


def with_catalog(sold: DataFrame, products: DataFrame, *columns: str) -> DataFrame:
    """Inner join of per-product rows with the catalog; orphans fall out.

    Both sides have one row per product id. No hint: Spark broadcasts the
    catalog when its size is under the configured threshold and otherwise joins
    on the partitioning the aggregate already has.
    """
    return sold.join(products.select("ProductID", *columns), "ProductID", "inner")
