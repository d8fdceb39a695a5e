"""The registered queries: each takes (spark, folder of Parquet tables)."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from salestide.functions import as_amount, in_range, revenue_expr
from salestide.operators.star import (
    SURPLUS,
    Star,
    candidates,
    merged,
    normalise,
    orphan_references,
    rejected_rows,
    type_rows,
)
from salestide.params import check_range
from salestide.plans import maintained
from salestide.plans.load_report import accepted_keys, quality_columns
from salestide.plans.load_report import load_report as load_report_plan
from salestide.plans.refresh import compact, keys_fit, load_rows
from salestide.plans.reports import (
    result_rows,
    revenue_by_category,
    revenue_by_product,
    revenue_by_region,
    revenue_trends,
    total_revenue,
)
from salestide.plans.summary import revenue_summary
from salestide.schemas import FLAT_HEADER
from salestide.sources import trade_tables
from salestide.sources.shuffle_files import freed_shuffles
from salestide.sources.spanning_csv import parsed_records, records_of
from salestide.sources.store import SalesStore
from salestide.streaming.landing import refresh_from_landing

Query = Callable[[SparkSession, str], DataFrame]

RANGE = ("1996-01-01", "1998-12-31")
EMPTY_RANGE = ("2031-01-01", "2031-12-31")
MID_MONTH = ("1996-02-10", "1998-05-17")


# -- reports on the full tables ---------------------------------------------


def _report(plan, *args, products=False, dates=RANGE, **kwargs) -> Query:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        frames = [trade_tables.orders(spark, folder)]
        if products:
            frames.append(trade_tables.products(spark, folder))
        return plan(*frames, *dates, *args, **kwargs)

    return query


def flatten_summary(summary: DataFrame) -> DataFrame:
    return summary.select(
        "total_revenue",
        F.col("top_product.ProductName").alias("top_product"),
        F.col("top_product.revenue").alias("top_product_revenue"),
        F.col("top_category.Category").alias("top_category"),
        F.col("top_category.revenue").alias("top_category_revenue"),
        F.col("top_region.Region").alias("top_region"),
        F.col("top_region.revenue").alias("top_region_revenue"),
    )


def _flat_summary(orders: DataFrame, products: DataFrame, start: str, end: str) -> DataFrame:
    return flatten_summary(revenue_summary(orders, products, start, end))


def order_revenue(spark: SparkSession, folder: str) -> DataFrame:
    orders = in_range(trade_tables.orders(spark, folder), *check_range(*RANGE))
    return orders.select("OrderID", as_amount(revenue_expr()).alias("revenue"))


def report_sizes(spark: SparkSession, folder: str) -> DataFrame:
    orders, products = trade_tables.orders(spark, folder), trade_tables.products(spark, folder)
    by_product = revenue_by_product(orders, products, *RANGE)
    return (
        result_rows(by_product)
        .withColumn("report", F.lit("all products"))
        .unionByName(result_rows(by_product, 5).withColumn("report", F.lit("top 5 products")))
    )


# -- reports on a catalog with gaps ------------------------------------------


def gappy_products(spark: SparkSession, folder: str) -> DataFrame:
    """Parts of the smallest sizes are not listed, one brand has no category."""
    part = trade_tables.table(spark, folder, "part").where("p_size > 5")
    category = F.when(F.col("p_brand") != "Brand#7", F.col("p_type"))
    return part.select(
        F.col("p_partkey").cast("string").alias("ProductID"),
        F.col("p_name").alias("ProductName"),
        F.when(F.col("p_type") != "LARGE", category).alias("Category"),
    )


def orphan_orders_kept_in_total(spark: SparkSession, folder: str) -> DataFrame:
    orders, listed = trade_tables.orders(spark, folder), gappy_products(spark, folder)
    total = total_revenue(orders, *RANGE).select(
        F.lit("total").alias("report"), F.col("total_revenue").alias("revenue")
    )
    by_region = revenue_by_region(orders, *RANGE).select(
        F.concat(F.lit("region "), "Region").alias("report"), "revenue"
    )
    by_category = revenue_by_category(orders, listed, *RANGE).select(
        F.concat(F.lit("category "), F.coalesce("Category", F.lit("(none)"))).alias("report"),
        "revenue",
    )
    return total.unionByName(by_region).unionByName(by_category)


def revenue_by_product_with_gaps(spark: SparkSession, folder: str) -> DataFrame:
    orders = trade_tables.orders(spark, folder)
    return revenue_by_product(orders, gappy_products(spark, folder), *RANGE)


def revenue_summary_with_gaps(spark: SparkSession, folder: str) -> DataFrame:
    orders = trade_tables.orders(spark, folder)
    return _flat_summary(orders, gappy_products(spark, folder), *RANGE)


def unlisted_references(spark: SparkSession, folder: str) -> DataFrame:
    solvent = (
        trade_tables.table(spark, folder, "customer")
        .where("c_acctbal >= 0")
        .select(F.col("c_custkey").cast("string").alias("CustomerID"))
    )
    return orphan_references(
        trade_tables.orders(spark, folder), gappy_products(spark, folder), solvent
    )


# -- ingest -------------------------------------------------------------------


def _typed(spark: SparkSession, folder: str, status: str | None = None) -> DataFrame:
    flat = trade_tables.flat_export(spark, folder)
    return type_rows(flat if status is None else flat.where(F.col("line_status") == status))


def plain(rows: DataFrame) -> DataFrame:
    """Dates as ISO text and decimals as doubles, for comparison across engines."""
    exact = {"QuantitySold", "UnitPrice", "Discount", "ShippingCost"}
    return rows.select(
        *(
            F.date_format(c, "yyyy-MM-dd").alias(c)
            if c == "DateOfSale"
            else as_amount(c).alias(c)
            if c in exact
            else F.col(c)
            for c in rows.columns
        )
    )


def _ingested(table: str) -> Query:
    return lambda spark, folder: plain(getattr(normalise(_typed(spark, folder)), table))


def parsed_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Every export row with its columns renamed, cleaned and typed, before any
    row is dropped; the position is spelled out to tell rows apart."""
    return _placed(_typed(spark, folder))


def _place() -> Column:
    return F.concat_ws(
        "-",
        "_position.l_orderkey",
        "_position.l_linenumber",
        "_position.l_partkey",
        F.col("_position.l_shipdate").cast("date"),
    )


def _placed(typed: DataFrame) -> DataFrame:
    names = [c for c in typed.columns if c[0].isupper()]
    return plain(typed.select(_place().alias("place"), *names))


def csv_records(spark: SparkSession, folder: str) -> DataFrame:
    """The export written out as CSV lines and put together from them again.

    Each source order is a file of its own, split at every other line number. By fixed
    rules on the source columns some fields are quoted, hold doubled quotes, commas and
    line breaks, or are unquoted with a quote inside; those marks are taken off again,
    so the rows must be those of ``parsed_rows``.
    """
    flat = trade_tables.flat_export(spark, folder)
    line, size = F.col("_position.l_linenumber"), F.length("`Product Name`")

    def written(name: str) -> Column:
        value = F.col(f"`{name}`")
        quoted = F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))
        if name == "Product Name":
            broken = F.concat(F.lit('"'), value, F.lit('~\n""~,\n\n"'))
            return (
                F.when(line % 4 == 0, broken)
                .when((line % 4 == 1) & (size > 0), F.concat(value, F.lit('~"~')))
                .otherwise(quoted)
            )
        return quoted if name in ("Customer Address", "Region") else value

    record = F.concat_ws(",", *[F.coalesce(written(c), F.lit("")) for c in FLAT_HEADER])
    where = F.struct(line.alias("l"), F.col("_position.l_partkey").alias("p"), F.col("_position.l_shipdate").alias("d"))
    numbered = flat.select(
        F.col("order_key").alias("file"), F.split(record, "\n").alias("parts"), where.alias("where")
    )
    order = Window.partitionBy("file").orderBy("where")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    numbered = numbered.withColumn("lines_before", F.coalesce(F.sum(F.size("parts")).over(earlier), F.lit(0)))
    lines = numbered.select("file", "lines_before", F.posexplode("parts").alias("part", "value"))
    # Splits of three lines, so that records begin and end in different ones.
    lines = lines.withColumn("row", (F.col("lines_before") + F.col("part") + 1).cast("bigint"))
    lines = lines.withColumn("block", F.floor(F.col("row") / 3)).select("value", "file", "block", "row")
    header = T.StructType([T.StructField(c, T.StringType()) for c in FLAT_HEADER])
    read = parsed_records(records_of(lines), header, {"escape": '"', "multiLine": True})
    bare = F.regexp_replace("`Product Name`", '~(\n"~,\n\n|"~)$', "")
    read = read.withColumn("Product Name", bare)
    # In an array for each file, so that rows are looked up where their file's lines lie.
    places = flat.groupBy(F.col("order_key").alias("file")).agg(
        F.sort_array(F.collect_list(F.struct(where.alias("where"), "_position"))).alias("places")
    )
    read = read.join(places, "file").where(F.col("record") <= F.size("places"))
    position = F.element_at("places", F.col("record").cast("int"))["_position"].alias("_position")
    return _placed(type_rows(read.select(*FLAT_HEADER, position)))


def accepted_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Orders that pass the key and date checks, repeats included."""
    orders = candidates(_typed(spark, folder)).orders
    return plain(orders.drop("_position"))


def after_refresh(spark: SparkSession, folder: str, mode: str) -> Star:
    """Lines of status F were loaded first, lines of status O are the new export."""
    stored = normalise(_typed(spark, folder, "F")) if mode == "append" else None
    return merged(stored, normalise(_typed(spark, folder, "O"), stored))


def _refreshed(table: str, mode: str) -> Query:
    return lambda spark, folder: plain(getattr(after_refresh(spark, folder, mode), table))


def small_load_append(spark: SparkSession, folder: str) -> DataFrame:
    """Orders after a load whose measured keys are few enough to be broadcast."""
    stored = normalise(_typed(spark, folder, "F"))
    typed = _typed(spark, folder, "O")
    fits = keys_fit(spark, typed)
    return plain(merged(stored, normalise(typed, stored, fits)).orders)


def load_report(spark: SparkSession, folder: str) -> DataFrame:
    """Counts of the second of two loads, in append mode."""
    return load_report_plan(_typed(spark, folder, "O"), accepted_keys(_typed(spark, folder, "F")))


# -- the stored tables --------------------------------------------------------


def _scratch(spark: SparkSession) -> str:
    """A fresh folder that the driver and all executors see: the cluster's own, or, on
    one machine, a temporary one."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors see")
    return f"{shared or tempfile.mkdtemp(prefix='sales-')}/check-{uuid.uuid4().hex}"


@contextmanager
def _without_broadcast(spark: SparkSession) -> Iterator[None]:
    """In here no load counts as small, so keys are indexed. Joins go by hash, not by
    sorting, where each shuffled partition of a side is measured to be small."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64m",
    }
    before = {name: spark.conf.get(name) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def _two_loads(spark: SparkSession, folder: str) -> SalesStore:
    store = SalesStore(spark, _scratch(spark))
    flat = trade_tables.flat_export(spark, folder)
    with _without_broadcast(spark):
        for status in ("F", "O"):
            load_rows(flat.where(F.col("line_status") == status), store.root, source=status)
    return store


def append_by_key_index(spark: SparkSession, folder: str) -> DataFrame:
    """Orders after two loads into stored tables; the second finds the keys of the first
    in the key index."""
    return plain(_two_loads(spark, folder).orders().drop("SaleMonth"))


def compacted_orders(spark: SparkSession, folder: str) -> DataFrame:
    """The same when both loads were put together afterwards."""
    store = _two_loads(spark, folder)
    compact(spark, store.root)
    store.drop_replaced_runs()
    return plain(store.orders().drop("SaleMonth"))


def _maintained(plan, *args) -> Query:
    """A report from the sums that two loads keep, over a range that begins and ends
    inside of months."""

    def query(spark: SparkSession, folder: str) -> DataFrame:
        return plan(_two_loads(spark, folder).maintained(), *MID_MONTH, *args)

    return query


def _maintained_summary(sales, start: str, end: str) -> DataFrame:
    return flatten_summary(maintained.revenue_summary(sales, start, end))


def landed_orders(spark: SparkSession, folder: str) -> DataFrame:
    """The export as CSV files in a landing folder, taken in by the stream. Each row is
    an order of its own, so that the order of files doesn't matter; some product names
    hold line breaks, quotes and commas. The files are compressed, as plain text they took
    more disk than all else of the load; and small, as each is one split then."""
    home = _scratch(spark)
    name = F.concat(F.col("`Product Name`"), F.lit('\n"x", y'))
    broken = F.when(F.col("_position.l_linenumber") % 3 == 0, name).otherwise(F.col("`Product Name`"))
    flat = trade_tables.flat_export(spark, folder)
    flat = flat.withColumn("Product Name", broken).withColumn("Order ID", _place())
    csv = flat.select(*FLAT_HEADER).write.options(header=True, escape='"', quoteAll=True)
    csv = csv.options(compression="gzip", maxRecordsPerFile=250_000)
    with freed_shuffles(spark):
        csv.csv(f"{home}/landing")
    query = refresh_from_landing(spark, f"{home}/landing", f"{home}/store", f"{home}/stream")
    query.awaitTermination()
    return plain(SalesStore(spark, f"{home}/store").orders().drop("SaleMonth"))


# -- quarantine ---------------------------------------------------------------


def _set_aside(spark: SparkSession, folder: str) -> DataFrame:
    """Typed rows of an export in which some prices are too large for their column and
    some lines hold cells beyond the header."""
    price, line = F.col("`Unit Price`"), F.col("_position.l_linenumber")
    flat = trade_tables.flat_export(spark, folder)
    flat = flat.withColumn(
        "Unit Price", F.when(F.col("`Shipping Cost`") == "43.00", "99999999999.00").otherwise(price)
    ).withColumn(SURPLUS, F.when(line == 6, ",,extra"))
    return type_rows(flat, quarantine=True)


def quarantined_rows(spark: SparkSession, folder: str) -> DataFrame:
    rejected = rejected_rows(_set_aside(spark, folder))
    return rejected.select(
        _place().alias("place"), "reasons", F.col("`Unit Price`").alias("price"), F.col("`Order ID`").alias("order_id")
    )


def orders_beside_quarantine(spark: SparkSession, folder: str) -> DataFrame:
    return plain(candidates(_set_aside(spark, folder)).orders.drop("_position"))


def quarantine_balance(spark: SparkSession, folder: str) -> DataFrame:
    """Rows read are orders accepted and rows rejected."""
    return _set_aside(spark, folder).agg(*quality_columns(quarantine=True)).select(
        "rows_read", "orders_accepted", "rows_rejected", "rows_refused", "customers_accepted", "products_accepted"
    )


def _after_ingest(plan, products: bool) -> Query:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        star = normalise(_typed(spark, folder))
        frames = [star.orders, star.products] if products else [star.orders]
        return plan(*frames, *RANGE)

    return query


QUERIES: dict[str, Query] = {
    "total_revenue": _report(total_revenue),
    "total_revenue_empty_range": _report(total_revenue, dates=EMPTY_RANGE),
    "revenue_by_product": _report(revenue_by_product, products=True),
    "revenue_by_product_top5": _report(revenue_by_product, products=True, limit=5),
    "revenue_by_category": _report(revenue_by_category, products=True),
    "revenue_by_category_top3": _report(revenue_by_category, products=True, limit=3),
    "revenue_by_region": _report(revenue_by_region),
    "revenue_by_region_top2": _report(revenue_by_region, limit=2),
    "trends_monthly": _report(revenue_trends),
    "trends_quarterly": _report(revenue_trends, "quarterly"),
    "trends_yearly": _report(revenue_trends, "yearly"),
    "revenue_summary": _report(_flat_summary, products=True),
    "order_revenue": order_revenue,
    "report_sizes": report_sizes,
    "orphan_orders_kept_in_total": orphan_orders_kept_in_total,
    "revenue_by_product_with_gaps": revenue_by_product_with_gaps,
    "revenue_summary_with_gaps": revenue_summary_with_gaps,
    "unlisted_references": unlisted_references,
    "parsed_rows": parsed_rows,
    "csv_records": csv_records,
    "accepted_orders": accepted_orders,
    "ingest_customers": _ingested("customers"),
    "ingest_products": _ingested("products"),
    "ingest_orders": _ingested("orders"),
    "refresh_append": _refreshed("orders", "append"),
    "refresh_append_customers": _refreshed("customers", "append"),
    "refresh_append_products": _refreshed("products", "append"),
    "refresh_overwrite": _refreshed("orders", "overwrite"),
    "refresh_append_small_load": small_load_append,
    "load_report": load_report,
    "append_by_key_index": append_by_key_index,
    "compacted_orders": compacted_orders,
    "maintained_total": _maintained(maintained.total_revenue),
    "maintained_by_product": _maintained(maintained.revenue_by_product),
    "maintained_by_category": _maintained(maintained.revenue_by_category),
    "maintained_by_region": _maintained(maintained.revenue_by_region),
    "maintained_trends_monthly": _maintained(maintained.revenue_trends),
    "maintained_trends_yearly": _maintained(maintained.revenue_trends, "yearly"),
    "maintained_summary": _maintained(_maintained_summary),
    "landed_orders": landed_orders,
    "quarantined_rows": quarantined_rows,
    "orders_beside_quarantine": orders_beside_quarantine,
    "quarantine_balance": quarantine_balance,
    "revenue_by_category_after_ingest": _after_ingest(revenue_by_category, products=True),
    "revenue_by_region_after_ingest": _after_ingest(revenue_by_region, products=False),
    "revenue_summary_after_ingest": _after_ingest(_flat_summary, products=True),
}
