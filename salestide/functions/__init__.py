"""Column expressions. Built-in functions only, so all of it stays in the JVM."""

from salestide.functions.cleaning import (
    NA_TOKENS,
    na_to_null,
    parse_amount,
)
from salestide.functions.dates import (
    DEFAULT_DATE_FORMATS,
    in_range,
    parse_sale_date,
    period_label,
    period_start,
    sale_month,
)
from salestide.functions.money import as_amount, revenue_expr, total_revenue_expr

__all__ = [
    "DEFAULT_DATE_FORMATS",
    "NA_TOKENS",
    "as_amount",
    "in_range",
    "na_to_null",
    "parse_amount",
    "parse_sale_date",
    "period_label",
    "period_start",
    "revenue_expr",
    "sale_month",
    "total_revenue_expr",
]
