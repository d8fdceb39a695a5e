"""Flat export rows to the three star tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salestide.functions.cleaning import (
    NA_TOKENS,
    all_na_to_null,
    is_rounded,
    is_too_large,
    is_unreadable,
    or_too_large,
    parse_amount,
)
from salestide.functions.dates import DEFAULT_DATE_FORMATS, parse_sale_date
from salestide.operators.first_wins import POSITION, StoredKeys, insert_or_ignore
from salestide.schemas import (
    DISCOUNT,
    FLAT_HEADER,
    FLAT_TO_CUSTOMERS,
    FLAT_TO_ORDERS,
    FLAT_TO_PRODUCTS,
    PRICE,
    QUANTITY,
    SHIPPING,
)

AMOUNTS = {"QuantitySold": QUANTITY, "UnitPrice": PRICE, "Discount": DISCOUNT, "ShippingCost": SHIPPING}

# Columns that say what went wrong with a row; they feed the load report.
UNREADABLE = ("DateOfSale", *AMOUNTS)
ROUNDED = tuple(AMOUNTS)

# With quarantine: the row enters no table; why it is set aside; its cells as written.
REFUSED, REASONS, CELLS, SURPLUS = "refused", "reasons", "cells", "_surplus"

ORDER_KEYS = ("OrderID", "ProductID", "CustomerID")

KEYS = {"customers": "CustomerID", "products": "ProductID", "orders": "OrderID"}


@dataclass(frozen=True)
class Star:
    customers: DataFrame
    products: DataFrame
    orders: DataFrame


def require_names(names: Sequence[str]) -> None:
    missing = [name for name in FLAT_HEADER if name not in names]
    if missing:
        raise ValueError(f"flat export lacks the column(s): {', '.join(missing)}")


def require_columns(flat: DataFrame) -> None:
    require_names(flat.columns)


def type_rows(
    flat: DataFrame,
    *,
    na_tokens: Sequence[str] = NA_TOKENS,
    date_formats: Sequence[str] = DEFAULT_DATE_FORMATS,
    quarantine: bool = False,
) -> DataFrame:
    """All-text export rows plus a position, to typed rows under model names.

    Keys stay text as written. Nothing is dropped: a value that cannot be read
    is null and flagged, one with more decimals than its column is rounded and
    flagged, and a number too large for its column is an error.

    With ``quarantine`` that number is no error: the row is refused, and so is one with
    surplus cells (a column ``_surplus`` of ``flat``, if there is one). Refused rows and
    those that give no order come with the reasons and their cells as written.
    """
    require_columns(flat)
    names = {**FLAT_TO_CUSTOMERS, **FLAT_TO_PRODUCTS, **FLAT_TO_ORDERS}
    aside = []
    if quarantine:
        surplus = F.col(SURPLUS) if SURPLUS in flat.columns else F.lit(None).cast("string")
        aside = [surplus.alias(SURPLUS), F.struct(*(F.col(f"`{h}`") for h in FLAT_HEADER)).alias(CELLS)]
    cleaned = all_na_to_null([F.col(f"`{header}`") for header in names], na_tokens)
    text = flat.select(
        *(value.alias(name) for value, name in zip(cleaned, names.values(), strict=True)),
        POSITION,
        *aside,
    )
    parsed = {"DateOfSale": parse_sale_date("DateOfSale", date_formats)}
    parsed |= {name: parse_amount(F.col(name), kind) for name, kind in AMOUNTS.items()}
    untouched = [c for c in text.columns if c not in parsed and c not in (SURPLUS, CELLS)]
    amounts = {n: parsed[n] if quarantine else or_too_large(F.col(n), k, n) for n, k in AMOUNTS.items()}
    if quarantine:
        reasons = _reasons(parsed)
        refused = F.exists(F.slice(reasons, 1, 1 + len(AMOUNTS)), lambda r: r.isNotNull())
        found = F.filter(reasons, lambda r: r.isNotNull())
        aside = [
            refused.alias(REFUSED),
            found.alias(REASONS),
            F.when(F.size(found) > 0, F.col(CELLS)).alias(CELLS),
        ]
    return text.select(
        *untouched,
        parsed["DateOfSale"].alias("DateOfSale"),
        *(amount.alias(name) for name, amount in amounts.items()),
        *aside,
        *(is_unreadable(F.col(c), parsed[c]).alias(f"unreadable_{c}") for c in UNREADABLE),
        *(is_rounded(F.col(c), parsed[c], AMOUNTS[c]).alias(f"rounded_{c}") for c in ROUNDED),
    )


def _reasons(parsed: Mapping[str, Column]) -> Column:
    """What is wrong with a row: first what refuses it, then what leaves it without an
    order; null in the place of each test that it passes."""
    tests = [
        F.when(F.col(SURPLUS).isNotNull(), F.concat(F.lit("cells beyond the header: "), F.col(SURPLUS))),
        *(
            F.when(is_too_large(F.col(name), parsed[name]), F.concat(F.lit(f"{name} is too large: "), F.col(name)))
            for name in AMOUNTS
        ),
        *(F.when(F.col(name).isNull(), F.lit(f"no {name}")) for name in ORDER_KEYS),
        F.when(F.col("DateOfSale").isNull(), F.lit("no DateOfSale")).when(
            parsed["DateOfSale"].isNull(), F.concat(F.lit("DateOfSale is unreadable: "), F.col("DateOfSale"))
        ),
    ]
    return F.array(*tests)


def rejected_rows(typed: DataFrame) -> DataFrame:
    """Of rows typed with ``quarantine``, those that gave no order: place, reasons and
    cells as written."""
    return typed.where(F.size(REASONS) > 0).select(
        POSITION, F.array_join(REASONS, "; ").alias(REASONS), f"{CELLS}.*"
    )


def with_values(rows: DataFrame, *columns: str) -> DataFrame:
    """Rows that have all the columns; each test reaches the scan by itself."""
    for column in columns:
        rows = rows.where(F.col(column).isNotNull())
    return rows


def candidates(typed: DataFrame) -> Star:
    """Rows that may enter each table, still with repeats.

    Dimension rows do not depend on the order being valid. Order rows are
    filtered before keys are claimed, so a rejected row never takes a key.
    """
    if REFUSED in typed.columns:
        typed = typed.where(~F.col(REFUSED))
    customers = typed.select(*FLAT_TO_CUSTOMERS.values(), POSITION)
    products = typed.select(*FLAT_TO_PRODUCTS.values(), POSITION)
    orders = typed.select(*FLAT_TO_ORDERS.values(), POSITION)
    return Star(
        with_values(customers, "CustomerID"),
        with_values(products, "ProductID"),
        with_values(orders, *ORDER_KEYS, "DateOfSale"),
    )


def normalise(
    typed: DataFrame,
    stored: Star | None = None,
    keys_fit_broadcast: Mapping[str, bool] | None = None,
    stored_keys: Mapping[str, StoredKeys] | None = None,
) -> Star:
    """The rows a load adds to each table, given what is stored already.

    No stored tables means an overwrite or a first load.
    """
    fits = keys_fit_broadcast or {}
    incoming = candidates(typed)
    return Star(
        **{
            table: insert_or_ignore(
                getattr(incoming, table),
                getattr(stored, table) if stored else None,
                key,
                keys_fit_broadcast=fits.get(table, False),
                stored_keys=(stored_keys or {}).get(table),
            )
            for table, key in KEYS.items()
        }
    )


def merged(stored: Star | None, added: Star) -> Star:
    """Table contents after a load: stored rows and added rows."""
    if stored is None:
        return added
    return Star(
        **{t: getattr(stored, t).unionByName(getattr(added, t)) for t in KEYS},
    )


def orphan_references(orders: DataFrame, products: DataFrame, customers: DataFrame) -> DataFrame:
    """Product and customer ids used by orders but absent from the dimensions,
    with the number of orders each. The foreign keys are declared, not enforced.

    References are counted before the look-up, so a hot id is looked up once.
    """

    def lost(key: str, dimension: DataFrame) -> DataFrame:
        used = with_values(orders, key).groupBy(key).agg(F.count("*").alias("orders"))
        return used.join(dimension.select(key), key, "left_anti").select(
            F.lit(key).alias("reference"), F.col(key).alias("missing_key"), "orders"
        )

    return lost("ProductID", products).unionByName(lost("CustomerID", customers))
