from __future__ import annotations

import csv
import datetime as dt
import sys
from decimal import Decimal
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from salestide.schemas import CUSTOMERS, FLAT_HEADER, ORDERS, PRODUCTS  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(autouse=True)
def no_views_left(request):
    """The session is shared: the store's views of one test are not there in the next."""
    yield
    if "spark" in request.fixturenames:
        for view in ("Customers", "Products", "Orders"):
            request.getfixturevalue("spark").catalog.dropTempView(view)


def order(order_id, product, customer, day, quantity, price, discount, shipping, region):
    """One Orders row from short values; money is given as text."""
    amounts = (None if x is None else Decimal(x) for x in (quantity, price, discount, shipping))
    return (order_id, product, customer, dt.date.fromisoformat(day), *amounts, "Cash", region)


@pytest.fixture(scope="session")
def make_orders(spark):
    return lambda rows: spark.createDataFrame([order(*row) for row in rows], ORDERS)


@pytest.fixture(scope="session")
def make_products(spark):
    return lambda rows: spark.createDataFrame(rows, PRODUCTS)


@pytest.fixture(scope="session")
def make_customers(spark):
    return lambda rows: spark.createDataFrame(rows, CUSTOMERS)


def flat_row(**values) -> dict[str, str]:
    """An export row; give only what matters, by lower-case name without 'of'."""
    defaults = {
        "Order ID": "o1",
        "Product ID": "p1",
        "Customer ID": "c1",
        "Product Name": "Lamp",
        "Category": "Light",
        "Region": "North",
        "Date of Sale": "2024-03-05",
        "Quantity Sold": "2",
        "Unit Price": "10.00",
        "Discount": "0.1",
        "Shipping Cost": "1.50",
        "Payment Method": "Cash",
        "Customer Name": "Ann",
        "Customer Email": "ann@example.com",
        "Customer Address": "1 Low Rd, Dale",
    }
    short = {
        "order": "Order ID",
        "product": "Product ID",
        "customer": "Customer ID",
        "name": "Product Name",
        "category": "Category",
        "region": "Region",
        "date": "Date of Sale",
        "quantity": "Quantity Sold",
        "price": "Unit Price",
        "discount": "Discount",
        "shipping": "Shipping Cost",
        "customer_name": "Customer Name",
        "address": "Customer Address",
    }
    return defaults | {short[k]: v for k, v in values.items()}


def write_csv(path: Path, rows: list[dict[str, str]], header=FLAT_HEADER) -> str:
    path.parent.mkdir(parents=True, exist_ok=True)
    with path.open("w", newline="", encoding="utf-8") as out:
        writer = csv.DictWriter(out, header, extrasaction="ignore", lineterminator="\n")
        writer.writeheader()
        writer.writerows(rows)
    return str(path)


def rows_of(frame) -> list[tuple]:
    return [tuple(row) for row in frame.collect()]


def row_set(frame) -> set[tuple]:
    rows = rows_of(frame)
    assert len(rows) == len(set(rows))
    return set(rows)
