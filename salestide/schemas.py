"""Declared schemas of the flat export and of the three star tables.

Decimal widths are part of the contract: with these types a row's revenue and any sum
of it are decimal(38,13), so no scale is lost and 25 digits are left before the point.
Do not widen them without redoing that arithmetic.
"""

from __future__ import annotations

from pyspark.sql import types as T

PRICE = T.DecimalType(14, 4)
DISCOUNT = T.DecimalType(8, 6)
SHIPPING = T.DecimalType(14, 4)
QUANTITY = T.DecimalType(12, 3)

# Marks a column whose values the loader guarantees to be unique and not null.
# Parquet reads come back nullable, so the promise travels as metadata.
KEY = {"primary_key": True}


def _text(name: str) -> T.StructField:
    return T.StructField(name, T.StringType())


def _key(name: str) -> T.StructField:
    return T.StructField(name, T.StringType(), nullable=False, metadata=KEY)


# The header names of the flat export, and where each one goes.
FLAT_TO_CUSTOMERS = {
    "Customer ID": "CustomerID",
    "Customer Name": "CustomerName",
    "Customer Email": "CustomerEmail",
    "Customer Address": "CustomerAddress",
}
FLAT_TO_PRODUCTS = {
    "Product ID": "ProductID",
    "Product Name": "ProductName",
    "Category": "Category",
}
FLAT_TO_ORDERS = {
    "Order ID": "OrderID",
    "Product ID": "ProductID",
    "Customer ID": "CustomerID",
    "Date of Sale": "DateOfSale",
    "Quantity Sold": "QuantitySold",
    "Unit Price": "UnitPrice",
    "Discount": "Discount",
    "Shipping Cost": "ShippingCost",
    "Payment Method": "PaymentMethod",
    "Region": "Region",
}
FLAT_HEADER = (
    "Order ID",
    "Product ID",
    "Customer ID",
    "Product Name",
    "Category",
    "Region",
    "Date of Sale",
    "Quantity Sold",
    "Unit Price",
    "Discount",
    "Shipping Cost",
    "Payment Method",
    "Customer Name",
    "Customer Email",
    "Customer Address",
)

CUSTOMERS = T.StructType(
    [_key("CustomerID"), _text("CustomerName"), _text("CustomerEmail"), _text("CustomerAddress")]
)

PRODUCTS = T.StructType([_key("ProductID"), _text("ProductName"), _text("Category")])

ORDERS = T.StructType(
    [
        _key("OrderID"),
        _text("ProductID"),
        _text("CustomerID"),
        T.StructField("DateOfSale", T.DateType()),
        T.StructField("QuantitySold", QUANTITY),
        T.StructField("UnitPrice", PRICE),
        T.StructField("Discount", DISCOUNT),
        T.StructField("ShippingCost", SHIPPING),
        _text("PaymentMethod"),
        _text("Region"),
    ]
)

# Partition column of stored Orders: first day of the sale month.
SALE_MONTH = "SaleMonth"
STORED_ORDERS = T.StructType([*ORDERS.fields, T.StructField(SALE_MONTH, T.DateType())])

# Maintained sums of stored orders, one row for each month, product and region of a run;
# and its buyers: each customer once for each month and region.
CELLS = T.StructType(
    [
        _text("ProductID"),
        _text("Region"),
        T.StructField("revenue", T.DecimalType(38, 13)),
        T.StructField("total_quantity_sold", T.DecimalType(22, 3)),
        T.StructField("total_orders", T.LongType()),
        T.StructField(SALE_MONTH, T.DateType()),
    ]
)
BUYERS = T.StructType([_text("Region"), _text("CustomerID"), T.StructField(SALE_MONTH, T.DateType())])

# Rows set aside by a load: where they stood, why, and their cells as written.
REJECTED = T.StructType(
    [
        T.StructField("file", T.StringType()),
        T.StructField("record", T.LongType()),
        T.StructField("reasons", T.StringType()),
        *(T.StructField(name, T.StringType()) for name in FLAT_HEADER),
    ]
)
