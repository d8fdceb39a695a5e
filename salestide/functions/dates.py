"""Date parsing, the closed range filter, and period buckets and labels."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from salestide.schemas import SALE_MONTH

DEFAULT_DATE_FORMATS = ("yyyy-M-d",)
_ISO_DATE = r"^(?!0000)[0-9]{4}-[0-9]{2}-[0-9]{2}\z"

# Per period, the truncation unit and the label pattern
# (2024-02, 2024-Q1, 2024).
_PERIOD_UNITS = {"monthly": "month", "quarterly": "quarter", "yearly": "year"}
_PERIOD_LABELS = {"monthly": "yyyy-MM", "quarterly": "yyyy-'Q'q", "yearly": "yyyy"}


def parse_sale_date(
    text: Column | str, formats: Sequence[str] = DEFAULT_DATE_FORMATS
) -> Column:
    """Text to date, null when no format fits. A time part or a day that does
    not exist makes the text unparseable. Formats are tried in order."""
    text = F.col(text) if isinstance(text, str) else text
    parsed = [_parsed_date(text, fmt) for fmt in formats]
    return parsed[0] if len(parsed) == 1 else F.coalesce(*parsed)


def _parsed_date(text: Column, fmt: str) -> Column:
    """Full ISO dates, nearly all texts of an export, are read without a formatter."""
    parsed = F.try_to_timestamp(text, F.lit(fmt)).cast("date")
    if fmt != "yyyy-M-d":
        return parsed
    return F.when(text.rlike(_ISO_DATE), text.try_cast("date")).otherwise(parsed)


def sale_month(date: Column | str) -> Column:
    """First day of the month: the partition value of stored orders."""
    return F.trunc(date, "month")


def date_value(date: dt.date) -> Column:
    """A date as literal. It goes by ISO text, as years before 1000 need their zeros."""
    return F.lit(date.isoformat()).cast("date")


def in_range(orders: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    """Orders sold from start to end, both days included.

    ``DateOfSale`` stays bare so that the filter is pushed into the scan. When
    the frame carries the month partition column, that is bounded too, so whole
    partitions are skipped before any file is opened.
    """
    sold_on = F.col("DateOfSale")
    if not isinstance(orders.schema["DateOfSale"].dataType, T.DateType):
        sold_on = sold_on.cast("date")
    kept = sold_on.between(date_value(start), date_value(end))
    if SALE_MONTH in orders.columns:
        first, last = (date_value(date.replace(day=1)) for date in (start, end))
        months = F.col(SALE_MONTH).between(first, last)
        kept = months & kept
    return orders.where(kept)


def period_start(date: Column | str, period: str) -> Column:
    """First day of the month, quarter or year: a 4-byte grouping key."""
    return F.trunc(date, _PERIOD_UNITS[period])


def period_label(first_day: Column | str, period: str) -> Column:
    """Text label of a period. Labels sort like the periods themselves."""
    return F.date_format(first_day, _PERIOD_LABELS[period])
