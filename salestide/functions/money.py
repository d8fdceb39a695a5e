"""Exact money arithmetic as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from salestide.schemas import DISCOUNT, PRICE, QUANTITY, SHIPPING


def revenue_expr() -> Column:
    """Revenue of one order row, decimal(38,13); null when any input is null.

    The casts are no-ops on frames that follow the declared schema. On wider
    inputs they fail loudly on overflow instead of losing scale silently.
    """
    gross = F.col("UnitPrice").cast(PRICE) * F.col("QuantitySold").cast(QUANTITY)
    kept = F.lit(1) - F.col("Discount").cast(DISCOUNT)
    return gross * kept + F.col("ShippingCost").cast(SHIPPING)


def total_revenue_expr() -> Column:
    """Sum of row revenue as decimal(38,13): the same in any row order."""
    return F.sum(revenue_expr())


def as_amount(column: Column | str) -> Column:
    """Exact decimal to double. Used once, on final output."""
    column = F.col(column) if isinstance(column, str) else column
    return column.cast("double")
