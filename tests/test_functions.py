import datetime as dt
from decimal import Context, Decimal, localcontext

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from salestide.functions import (
    NA_TOKENS,
    in_range,
    na_to_null,
    parse_amount,
    parse_sale_date,
    period_label,
    period_start,
    revenue_expr,
)
from salestide.functions.cleaning import is_rounded, is_unreadable, or_too_large
from salestide.schemas import PRICE, QUANTITY


@pytest.fixture
def evaluate(spark):
    """Apply a Column function to a list of texts, in order."""

    def apply(texts, function):
        frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
        return [row[0] for row in frame.orderBy("i").select(function(F.col("t"))).collect()]

    return apply


def test_only_the_expected_date_form_parses(evaluate):
    texts = ["2024-1-5", "2024-01-05", "2024-02-30", "20240106", "01/02/2024",
             "2024-01-03 10:00:00", "2024-01", "soon", "", None]
    assert evaluate(texts, parse_sale_date) == [dt.date(2024, 1, 5)] * 2 + [None] * 8


def test_other_date_forms_can_be_named(evaluate):
    formats = ("dd/MM/yyyy", "yyyy-M-d")
    assert evaluate(
        ["01/02/2024", "2024-1-5"], lambda c: parse_sale_date(c, formats)
    ) == [dt.date(2024, 2, 1), dt.date(2024, 1, 5)]


def test_missing_value_tokens(evaluate):
    kept = ["North", "na", "Nan", " NA", "0", "none"]
    assert evaluate([*NA_TOKENS, None, *kept], na_to_null) == [None] * (len(NA_TOKENS) + 1) + kept
    assert evaluate(["NA", ""], lambda c: na_to_null(c, ())) == ["NA", ""]


def test_quantities_may_be_fractions(evaluate):
    texts = ["3", "2.0", " 4 ", "1e2", "-1", "2.5", "abc", "999999999.999", "1d", "inf", None]
    assert evaluate(texts, lambda c: or_too_large(c, QUANTITY, "QuantitySold")) == [
        3, 2, 4, 100, -1, Decimal("2.5"), None, Decimal("999999999.999"), None, None, None]


@pytest.mark.parametrize("text", ["10000000000", "-1e20", "1e400"])
def test_a_number_too_large_for_its_column_is_an_error(evaluate, text):
    with pytest.raises(Exception, match="QuantitySold has a number that does not fit"):
        evaluate([text], lambda c: or_too_large(c, QUANTITY, "QuantitySold"))


def test_amounts_round_half_up_and_never_fail(evaluate):
    texts = ["1.5", "0.00005", "0.0000499999999999999999", "-0.00005", "abc", "1e20", None]
    got = evaluate(texts, lambda c: parse_amount(c, PRICE))
    assert got == [Decimal("1.50"), Decimal("0.0001"), Decimal("0.00"), Decimal("-0.0001"),
                   None, None, None]


def test_quality_flags(evaluate):
    texts = ["1.50", "1.00005", "abc", None]
    assert evaluate(texts, lambda c: is_unreadable(c, parse_amount(c, PRICE))) == [
        False, False, True, False]
    assert evaluate(texts, lambda c: is_rounded(c, parse_amount(c, PRICE))) == [
        False, True, False, False]


def test_revenue_is_exact_and_typed(make_orders):
    orders = make_orders([("o", "p", "c", "2024-01-01", 3, "59.99", "0.2", "5", "N")])
    frame = orders.select(revenue_expr().alias("r"), F.sum(revenue_expr()).over(
        Window.partitionBy()).alias("s"))
    assert frame.schema["r"].dataType == T.DecimalType(38, 13)
    assert frame.schema["s"].dataType == T.DecimalType(38, 13)
    assert frame.first().r == Decimal("148.976")


@pytest.mark.parametrize("hole", [4, 5, 6, 7])
def test_revenue_is_null_when_any_part_is(make_orders, hole):
    row = ["o", "p", "c", "2024-01-01", 3, "59.99", "0.2", "5", "N"]
    row[hole] = None
    assert make_orders([row]).select(revenue_expr()).first()[0] is None


def test_widest_values_keep_their_scale(make_orders):
    row = ("o", "p", "c", "2024-01-01", "999999999.999", "9999999999.9999", "-99.999999",
           "9999999999.9999", "N")
    with localcontext(Context(prec=60)):
        expected = (Decimal("9999999999.9999") * Decimal("999999999.999") * Decimal("100.999999")
                    + Decimal("9999999999.9999"))
    assert make_orders([row]).select(revenue_expr()).first()[0] == expected


@pytest.mark.parametrize(
    ("quantity", "price", "discount", "revenue"),
    [("2.5", "10", "0", "26"), ("1", "1.899", "0", "2.899"), ("3", "1", "0.33333", "3.00001"),
     ("1", "10", "10", "-89"), ("1", "2345678901.0001", "0", "2345678902.0001")],
)
def test_no_revenue_is_lost_to_widths(make_orders, quantity, price, discount, revenue):
    row = ("o", "p", "c", "2024-01-01", quantity, price, discount, "1", "N")
    assert make_orders([row]).select(revenue_expr()).first()[0] == Decimal(revenue)


def test_range_includes_both_ends(make_orders):
    days = ["2024-01-31", "2024-02-01", "2024-02-29", "2024-03-01"]
    orders = make_orders([(d, "p", "c", d, 1, "1", "0", "0", "N") for d in days])
    kept = in_range(orders, dt.date(2024, 2, 1), dt.date(2024, 2, 29))
    assert {r.OrderID for r in kept.collect()} == {"2024-02-01", "2024-02-29"}


def test_range_on_timestamps_goes_by_day(make_orders):
    orders = make_orders([("o", "p", "c", "2024-12-31", 1, "1", "0", "0", "N")])
    late = orders.withColumn("DateOfSale", F.lit(dt.datetime(2024, 12, 31, 10)))
    assert in_range(late, dt.date(2024, 12, 1), dt.date(2024, 12, 31)).count() == 1


@pytest.mark.parametrize(
    ("period", "labels"),
    [
        ("monthly", ["2023-12", "2024-01", "2024-06", "2024-10"]),
        ("quarterly", ["2023-Q4", "2024-Q1", "2024-Q2", "2024-Q4"]),
        ("yearly", ["2023", "2024", "2024", "2024"]),
    ],
)
def test_period_labels(evaluate, period, labels):
    days = ["2023-12-31", "2024-01-01", "2024-06-30", "2024-10-01"]
    assert evaluate(
        days, lambda c: period_label(period_start(c.cast("date"), period), period)
    ) == labels
