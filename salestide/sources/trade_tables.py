"""Sales model views over order-line tables kept as Parquet files.

The source tables are lineitem, orders, customer, nation, region and part. All
joins are inner on full foreign keys and carry no hints: Spark broadcasts a
side it knows to be under the threshold, and splits skewed shuffle partitions
of the others at run time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from salestide.operators.first_wins import POSITION
from salestide.schemas import DISCOUNT, PRICE, QUANTITY, SHIPPING

# Declared, so that reading a table starts no job to infer its schema.
SCHEMAS = {
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
    "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
    "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, "
    "c_mktsegment string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "region": "r_regionkey int, r_name string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
    "p_retailprice double",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}.parquet")


def line_id(*parts: Column | str) -> Column:
    return F.concat_ws("-", *parts)


def products(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select(
        F.col("p_partkey").cast("string").alias("ProductID"),
        F.col("p_name").alias("ProductName"),
        F.col("p_type").alias("Category"),
    )


def customers(spark: SparkSession, folder: str) -> DataFrame:
    """The source has no email or address column; those stay null."""
    return table(spark, folder, "customer").select(
        F.col("c_custkey").cast("string").alias("CustomerID"),
        F.col("c_name").alias("CustomerName"),
        F.lit(None).cast("string").alias("CustomerEmail"),
        F.lit(None).cast("string").alias("CustomerAddress"),
    )


def joined_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines with their order, customer, region and part.

    Nations are put to the customers and customers to the orders before the lines come
    in, so the lines, the largest table, pass two joins at most that shuffle them. Parts
    come first: what the second leaves is dealt by order, as who groups by order needs it.
    """
    nations = table(spark, folder, "nation").join(
        table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    customers = nations.join(table(spark, folder, "customer"), F.col("c_nationkey") == F.col("n_nationkey"))
    placed = customers.join(table(spark, folder, "orders"), F.col("o_custkey") == F.col("c_custkey"))
    return (
        table(spark, folder, "lineitem")
        .join(table(spark, folder, "part"), F.col("l_partkey") == F.col("p_partkey"))
        .join(placed, F.col("l_orderkey") == F.col("o_orderkey"))
    )


def orders(spark: SparkSession, folder: str) -> DataFrame:
    """One order per source line; the id is unique at every size."""
    return joined_lines(spark, folder).select(
        line_id(
            "l_orderkey", "l_linenumber", "l_partkey", F.col("l_shipdate").cast("date")
        ).alias("OrderID"),
        F.col("l_partkey").cast("string").alias("ProductID"),
        F.col("o_custkey").cast("string").alias("CustomerID"),
        F.col("o_orderdate").cast("date").alias("DateOfSale"),
        F.col("l_quantity").cast(QUANTITY).alias("QuantitySold"),
        F.col("p_retailprice").cast(PRICE).alias("UnitPrice"),
        F.col("l_discount").cast(DISCOUNT).alias("Discount"),
        F.col("p_size").cast(SHIPPING).alias("ShippingCost"),
        F.col("o_orderpriority").alias("PaymentMethod"),
        F.col("r_name").alias("Region"),
    )


def flat_export(spark: SparkSession, folder: str) -> DataFrame:
    """The order lines as an untidy flat export: all text, header names, position.

    The order id is deliberately coarse, so ids repeat; names carry the line
    number, so it shows which row won. Missing, misspelt and unreadable values
    are put in by fixed rules on the source columns.
    """
    size, quantity, date = F.col("p_size"), F.col("l_quantity"), F.col("o_orderdate").cast("date")
    whole = quantity.cast("bigint").cast("string")
    price = F.col("p_retailprice").cast("decimal(12,2)").cast("string")
    line = F.col("l_linenumber").cast("string")
    columns = {
        "Order ID": F.when(quantity == 50, "").otherwise(line_id("l_orderkey", "l_linenumber")),
        "Product ID": F.when(quantity == 13, "NULL").otherwise(F.col("l_partkey").cast("string")),
        "Customer ID": F.when(F.col("n_name") == "NATION_7", "None").otherwise(
            F.col("o_custkey").cast("string")
        ),
        "Product Name": F.when(F.col("l_linenumber") == 1, "N/A").otherwise(
            F.concat_ws(" / ", "p_name", line)
        ),
        "Category": F.when(size == 1, "nan").otherwise(F.col("p_type")),
        "Region": F.when(F.col("n_name") == "NATION_3", "NA").otherwise(F.col("r_name")),
        "Date of Sale": F.when(size == 50, F.date_format(date, "dd/MM/yyyy"))
        .when(size == 49, F.date_format(date, "yyyyMMdd"))
        .when(size == 48, F.concat(F.year(date).cast("string"), F.lit("-02-30")))
        .when(size == 47, F.concat(date.cast("string"), F.lit(" 10:00:00")))
        .when(size == 46, "")
        .when(F.col("o_orderstatus") == "P", F.date_format(date, "yyyy-M-d"))
        .otherwise(date.cast("string")),
        "Quantity Sold": F.when(quantity == 17, F.concat(whole, F.lit(".5")))
        .when(F.col("l_returnflag") == "A", F.concat(whole, F.lit(".0")))
        .otherwise(whole),
        "Unit Price": F.when(size == 45, "abc")
        .when(size == 44, F.concat(price, F.lit("5")))
        .otherwise(price),
        "Discount": F.when(
            (F.col("l_linenumber") == 7) & (F.col("l_returnflag") == "R"), "n/a"
        ).otherwise(F.col("l_discount").cast("decimal(5,4)").cast("string")),
        "Shipping Cost": F.concat(size.cast("string"), F.lit(".00")),
        "Payment Method": F.col("o_orderpriority"),
        "Customer Name": F.concat_ws(" / ", "c_name", line),
        "Customer Email": F.when(F.col("c_mktsegment") == "MACHINERY", "<NA>").otherwise(
            F.concat(F.lower("c_name"), F.lit("@example.com"))
        ),
        "Customer Address": F.concat_ws(", ", "n_name", "r_name"),
    }
    return joined_lines(spark, folder).select(
        *(column.alias(name) for name, column in columns.items()),
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate").alias(POSITION),
        F.col("l_linestatus").alias("line_status"),
        # Beside the position, since Spark doesn't see how rows are dealt through a struct.
        F.col("l_orderkey").alias("order_key"),
    )
