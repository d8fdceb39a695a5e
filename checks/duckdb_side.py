"""The same questions in SQL for DuckDB, stated from the source tables.

Written as plain join-then-group SQL, independent of how the Spark side plans
them. Sums are exact decimals, cast to DOUBLE last.
"""

from __future__ import annotations

RANGE = "DateOfSale BETWEEN DATE '1996-01-01' AND DATE '1998-12-31'"
EMPTY = "DateOfSale BETWEEN DATE '2031-01-01' AND DATE '2031-12-31'"

ROW = (
    "(UnitPrice * QuantitySold * (1 - Discount) + ShippingCost)"
)
SUM = f"SUM(CAST({ROW} AS DECIMAL(38,6)))"

LINES = """
lines AS (
  SELECT *
  FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey
  JOIN part ON l_partkey = p_partkey
)"""

FACT = f"""{LINES},
sales AS (
  SELECT CONCAT_WS('-', l_orderkey, l_linenumber, l_partkey, CAST(l_shipdate AS DATE)) AS OrderID,
         CAST(l_partkey AS VARCHAR) AS ProductID,
         CAST(o_custkey AS VARCHAR) AS CustomerID,
         CAST(o_orderdate AS DATE) AS DateOfSale,
         CAST(l_quantity AS DECIMAL(12,3)) AS QuantitySold,
         CAST(p_retailprice AS DECIMAL(14,4)) AS UnitPrice,
         CAST(l_discount AS DECIMAL(8,6)) AS Discount,
         CAST(p_size AS DECIMAL(14,4)) AS ShippingCost,
         r_name AS Region
  FROM lines
)"""

CATALOG = """
catalog AS (
  SELECT CAST(p_partkey AS VARCHAR) AS ProductID, p_name AS ProductName, p_type AS Category
  FROM part
)"""

GAPPY = """
catalog AS (
  SELECT CAST(p_partkey AS VARCHAR) AS ProductID, p_name AS ProductName,
         CASE WHEN p_type <> 'LARGE' AND p_brand <> 'Brand#7' THEN p_type END AS Category
  FROM part
  WHERE p_size > 5
)"""

# The untidy export and its reading, before any row is dropped.
TOKENS = (
    "('', '#N/A', '#N/A N/A', '#NA', '-1.#IND', '-1.#QNAN', '-NaN', '-nan', '1.#IND', "
    "'1.#QNAN', '<NA>', 'N/A', 'NA', 'NULL', 'NaN', 'None', 'n/a', 'nan', 'null')"
)
EXPORT = f"""{LINES},
export AS (
  SELECT CASE WHEN l_quantity = 50 THEN ''
              ELSE CONCAT_WS('-', l_orderkey, l_linenumber) END AS OrderID,
         CASE WHEN l_quantity = 13 THEN 'NULL' ELSE CAST(l_partkey AS VARCHAR) END AS ProductID,
         CASE WHEN n_name = 'NATION_7' THEN 'None' ELSE CAST(o_custkey AS VARCHAR) END AS CustomerID,
         CASE WHEN l_linenumber = 1 THEN 'N/A'
              ELSE p_name || ' / ' || l_linenumber END AS ProductName,
         CASE WHEN p_size = 1 THEN 'nan' ELSE p_type END AS Category,
         CASE WHEN n_name = 'NATION_3' THEN 'NA' ELSE r_name END AS Region,
         CASE WHEN p_size = 50 THEN STRFTIME(o_orderdate, '%d/%m/%Y')
              WHEN p_size = 49 THEN STRFTIME(o_orderdate, '%Y%m%d')
              WHEN p_size = 48 THEN STRFTIME(o_orderdate, '%Y-02-30')
              WHEN p_size = 47 THEN STRFTIME(o_orderdate, '%Y-%m-%d 10:00:00')
              WHEN p_size = 46 THEN ''
              WHEN o_orderstatus = 'P'
                THEN CONCAT_WS('-', YEAR(o_orderdate), MONTH(o_orderdate), DAY(o_orderdate))
              ELSE STRFTIME(o_orderdate, '%Y-%m-%d') END AS DateText,
         CAST(CAST(l_quantity AS BIGINT) AS VARCHAR)
           || CASE WHEN l_quantity = 17 THEN '.5'
                   WHEN l_returnflag = 'A' THEN '.0' ELSE '' END AS QuantityText,
         CASE WHEN p_size = 45 THEN 'abc'
              ELSE CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS VARCHAR)
                   || CASE WHEN p_size = 44 THEN '5' ELSE '' END END AS PriceText,
         CASE WHEN l_linenumber = 7 AND l_returnflag = 'R' THEN 'n/a'
              ELSE CAST(CAST(l_discount AS DECIMAL(5,4)) AS VARCHAR) END AS DiscountText,
         p_size || '.00' AS ShippingText,
         o_orderpriority AS PaymentMethod,
         c_name || ' / ' || l_linenumber AS CustomerName,
         CASE WHEN c_mktsegment = 'MACHINERY' THEN '<NA>'
              ELSE LOWER(c_name) || '@example.com' END AS CustomerEmail,
         n_name || ', ' || r_name AS CustomerAddress,
         l_linestatus AS line_status,
         l_orderkey, l_linenumber, l_partkey, l_shipdate
  FROM lines
),
blanked AS (
  SELECT line_status, l_orderkey, l_linenumber, l_partkey, l_shipdate,
         {", ".join(
             f"CASE WHEN {c} NOT IN {TOKENS} THEN {c} END AS {c}"
             for c in (
                 "OrderID", "ProductID", "CustomerID", "ProductName", "Category", "Region",
                 "DateText", "QuantityText", "PriceText", "DiscountText", "ShippingText",
                 "PaymentMethod", "CustomerName", "CustomerEmail", "CustomerAddress",
             )
         )}
  FROM export
),
typed AS (
  SELECT *,
         CASE WHEN REGEXP_FULL_MATCH(DateText, '[0-9]{{4}}-[0-9]{{1,2}}-[0-9]{{1,2}}')
              THEN TRY_CAST(DateText AS DATE) END AS DateOfSale,
         CAST(TRY_CAST(QuantityText AS DECIMAL(38,18)) AS DECIMAL(12,3)) AS QuantitySold,
         CAST(TRY_CAST(PriceText AS DECIMAL(38,18)) AS DECIMAL(14,4)) AS UnitPrice,
         CAST(TRY_CAST(DiscountText AS DECIMAL(38,18)) AS DECIMAL(8,6)) AS Discount,
         CAST(TRY_CAST(ShippingText AS DECIMAL(38,18)) AS DECIMAL(14,4)) AS ShippingCost
  FROM blanked
),
accepted AS (
  SELECT * FROM typed
  WHERE OrderID IS NOT NULL AND ProductID IS NOT NULL AND CustomerID IS NOT NULL
    AND DateOfSale IS NOT NULL
)"""

PLACE = "l_orderkey, l_linenumber, l_partkey, l_shipdate"
ORDER_COLUMNS = """OrderID, ProductID, CustomerID,
       STRFTIME(DateOfSale, '%Y-%m-%d') AS DateOfSale,
       CAST(QuantitySold AS DOUBLE) AS QuantitySold,
       CAST(UnitPrice AS DOUBLE) AS UnitPrice, CAST(Discount AS DOUBLE) AS Discount,
       CAST(ShippingCost AS DOUBLE) AS ShippingCost, PaymentMethod, Region"""
CUSTOMER_COLUMNS = "CustomerID, CustomerName, CustomerEmail, CustomerAddress"
PRODUCT_COLUMNS = "ProductID, ProductName, Category"


def first_rows(source: str, key: str, order: str = PLACE, where: str = "TRUE") -> str:
    return f"""(SELECT * FROM {source} WHERE {key} IS NOT NULL AND {where}
   QUALIFY ROW_NUMBER() OVER (PARTITION BY {key} ORDER BY {order}) = 1)"""


MEASURES = f"""CAST({SUM} AS DOUBLE) AS revenue,
       CAST(SUM(QuantitySold) AS DOUBLE) AS total_quantity_sold,
       COUNT(OrderID) AS total_orders"""


def by_product(ctes: str, limit: str = "") -> str:
    return f"""WITH {ctes}
SELECT ProductID, ProductName, {MEASURES}
FROM sales JOIN catalog USING (ProductID) WHERE {RANGE}
GROUP BY ProductID, ProductName
ORDER BY {SUM} DESC NULLS LAST, ProductID NULLS FIRST {limit}"""


def by_category(ctes: str, limit: str = "") -> str:
    return f"""WITH {ctes}
SELECT Category, {MEASURES}, COUNT(DISTINCT ProductID) AS unique_products
FROM sales JOIN catalog USING (ProductID) WHERE {RANGE}
GROUP BY Category
ORDER BY {SUM} DESC NULLS LAST, Category NULLS FIRST {limit}"""


def by_region(ctes: str, limit: str = "") -> str:
    return f"""WITH {ctes}
SELECT Region, {MEASURES}, COUNT(DISTINCT CustomerID) AS unique_customers
FROM sales WHERE {RANGE}
GROUP BY Region
ORDER BY {SUM} DESC NULLS LAST, Region NULLS FIRST {limit}"""


def trend(label: str, ctes: str = "") -> str:
    return f"""WITH {ctes or FACT}
SELECT {label} AS period, {MEASURES}
FROM sales WHERE {RANGE} GROUP BY 1 ORDER BY 1"""


def summary(ctes: str) -> str:
    """Four separate queries put side by side."""

    def top(columns: str, source: str, group: str, key: str) -> str:
        return f"""(SELECT {columns}, CAST({SUM} AS DOUBLE) AS revenue FROM {source}
   WHERE {RANGE} GROUP BY {group}
   ORDER BY {SUM} DESC NULLS LAST, {key} NULLS FIRST LIMIT 1)"""

    joined = "sales JOIN catalog USING (ProductID)"
    return f"""WITH {ctes}
SELECT total_revenue,
       p.ProductName AS top_product, p.revenue AS top_product_revenue,
       c.Category AS top_category, c.revenue AS top_category_revenue,
       r.Region AS top_region, r.revenue AS top_region_revenue
FROM (SELECT COALESCE(CAST({SUM} AS DOUBLE), 0.0) AS total_revenue FROM sales WHERE {RANGE}) t
LEFT JOIN {top("ProductName", joined, "ProductID, ProductName", "ProductID")} p ON TRUE
LEFT JOIN {top("Category", joined, "Category", "Category")} c ON TRUE
LEFT JOIN {top("Region", "sales", "Region", "Region")} r ON TRUE"""


INGESTED = f"""{EXPORT},
sales AS (
  SELECT OrderID, ProductID, CustomerID, Region, DateOfSale, QuantitySold, UnitPrice, Discount,
         ShippingCost
  FROM {first_rows("accepted", "OrderID")}),
catalog AS (SELECT {PRODUCT_COLUMNS} FROM {first_rows("typed", "ProductID")})"""

STORED_FIRST = f"line_status, {PLACE}"  # F sorts before O
NEW_ONLY = "line_status = 'O'"

# Both loads stored one after the other, and a range that cuts months.
MID_MONTH = "DateOfSale BETWEEN DATE '1996-02-10' AND DATE '1998-05-17'"
STORED = f"""{EXPORT},
sales AS (
  SELECT OrderID, ProductID, CustomerID, Region, DateOfSale, QuantitySold, UnitPrice, Discount,
         ShippingCost
  FROM {first_rows("accepted", "OrderID", STORED_FIRST)}),
catalog AS (SELECT {PRODUCT_COLUMNS} FROM {first_rows("typed", "ProductID", STORED_FIRST)})"""


def of_stored(query: str) -> str:
    return query.replace(RANGE, MID_MONTH)



# The export with numbers too large and cells beyond the header, by the same rules.
NO_KEYS = "(OrderID IS NULL OR ProductID IS NULL OR CustomerID IS NULL)"
ASIDE = f"""{EXPORT},
aside AS (
  SELECT *, l_linenumber = 6 AS surplus, ShippingText = '43.00' AS too_large,
         l_linenumber = 6 OR ShippingText = '43.00' AS refused,
         {NO_KEYS} OR DateOfSale IS NULL AS no_order
  FROM typed
)"""


def load_counts() -> str:
    no_keys = "(OrderID IS NULL OR ProductID IS NULL OR CustomerID IS NULL)"
    counts = {
        "rows_read": "TRUE",
        "customers_without_key": "CustomerID IS NULL",
        "products_without_key": "ProductID IS NULL",
        "orders_without_key": no_keys,
        "orders_without_date": f"NOT {no_keys} AND DateOfSale IS NULL",
        "customers_accepted": "CustomerID IS NOT NULL",
        "products_accepted": "ProductID IS NOT NULL",
        "orders_accepted": f"NOT {no_keys} AND DateOfSale IS NOT NULL",
        "unreadable_DateOfSale": "DateText IS NOT NULL AND DateOfSale IS NULL",
        "unreadable_QuantitySold": "QuantityText IS NOT NULL AND QuantitySold IS NULL",
        "unreadable_UnitPrice": "PriceText IS NOT NULL AND UnitPrice IS NULL",
        "unreadable_Discount": "DiscountText IS NOT NULL AND Discount IS NULL",
        "unreadable_ShippingCost": "ShippingText IS NOT NULL AND ShippingCost IS NULL",
        "rounded_QuantitySold": "TRY_CAST(QuantityText AS DECIMAL(38,18)) <> QuantitySold",
        "rounded_UnitPrice": "TRY_CAST(PriceText AS DECIMAL(38,18)) <> UnitPrice",
        "rounded_Discount": "TRY_CAST(DiscountText AS DECIMAL(38,18)) <> Discount",
        "rounded_ShippingCost": "TRY_CAST(ShippingText AS DECIMAL(38,18)) <> ShippingCost",
    }
    parts = [
        f"SELECT '{name}' AS metric, COUNT(*) AS rows FROM typed WHERE {NEW_ONLY} AND {test}"
        for name, test in counts.items()
    ]
    for table, source, key in (
        ("customers", "typed", "CustomerID"),
        ("products", "typed", "ProductID"),
        ("orders", "accepted", "OrderID"),
    ):
        new_keys = (
            f"SELECT COUNT(DISTINCT {key}) FROM {source} WHERE {NEW_ONLY} AND {key} NOT IN "
            f"(SELECT {key} FROM {source} WHERE line_status = 'F' AND {key} IS NOT NULL)"
        )
        all_rows = f"SELECT COUNT({key}) FROM {source} WHERE {NEW_ONLY}"
        parts.append(f"SELECT '{table}_inserted', ({new_keys})")
        parts.append(f"SELECT '{table}_ignored', ({all_rows}) - ({new_keys})")
    return f"WITH {EXPORT}\n" + "\nUNION ALL ".join(parts)


ORACLE_SQL: dict[str, str] = {
    "total_revenue": f"""WITH {FACT}
SELECT COALESCE(CAST({SUM} AS DOUBLE), 0.0) AS total_revenue FROM sales WHERE {RANGE}""",
    "total_revenue_empty_range": f"""WITH {FACT}
SELECT COALESCE(CAST({SUM} AS DOUBLE), 0.0) AS total_revenue FROM sales WHERE {EMPTY}""",
    "revenue_by_product": by_product(f"{FACT}, {CATALOG}"),
    "revenue_by_product_top5": by_product(f"{FACT}, {CATALOG}", "LIMIT 5"),
    "revenue_by_category": by_category(f"{FACT}, {CATALOG}"),
    "revenue_by_category_top3": by_category(f"{FACT}, {CATALOG}", "LIMIT 3"),
    "revenue_by_region": by_region(FACT),
    "revenue_by_region_top2": by_region(FACT, "LIMIT 2"),
    "trends_monthly": trend("STRFTIME(DateOfSale, '%Y-%m')"),
    "trends_quarterly": trend("YEAR(DateOfSale) || '-Q' || QUARTER(DateOfSale)"),
    "trends_yearly": trend("STRFTIME(DateOfSale, '%Y')"),
    "revenue_summary": summary(f"{FACT}, {CATALOG}"),
    "order_revenue": f"""WITH {FACT}
SELECT OrderID, CAST(CAST({ROW} AS DECIMAL(38,6)) AS DOUBLE) AS revenue
FROM sales WHERE {RANGE}""",
    "report_sizes": f"""WITH {FACT}, {CATALOG}, sold AS (
  SELECT DISTINCT ProductID FROM sales JOIN catalog USING (ProductID) WHERE {RANGE})
SELECT 'all products' AS report, COUNT(*) AS result_rows FROM sold
UNION ALL SELECT 'top 5 products', LEAST(COUNT(*), 5) FROM sold""",
    "orphan_orders_kept_in_total": f"""WITH {FACT}, {GAPPY}
SELECT 'total' AS report, CAST({SUM} AS DOUBLE) AS revenue FROM sales WHERE {RANGE}
UNION ALL
SELECT 'region ' || Region, CAST({SUM} AS DOUBLE) FROM sales WHERE {RANGE} GROUP BY Region
UNION ALL
SELECT 'category ' || COALESCE(Category, '(none)'), CAST({SUM} AS DOUBLE)
FROM sales JOIN catalog USING (ProductID) WHERE {RANGE} GROUP BY Category""",
    "revenue_by_product_with_gaps": by_product(f"{FACT}, {GAPPY}"),
    "revenue_summary_with_gaps": summary(f"{FACT}, {GAPPY}"),
    "unlisted_references": f"""WITH {FACT}, {GAPPY}
SELECT 'ProductID' AS reference, ProductID AS missing_key, COUNT(*) AS orders
FROM sales WHERE ProductID NOT IN (SELECT ProductID FROM catalog) GROUP BY ProductID
UNION ALL
SELECT 'CustomerID', CustomerID, COUNT(*)
FROM sales
WHERE CustomerID NOT IN (SELECT CAST(c_custkey AS VARCHAR) FROM customer WHERE c_acctbal >= 0)
GROUP BY CustomerID""",
    "parsed_rows": f"""WITH {EXPORT}
SELECT CONCAT_WS('-', l_orderkey, l_linenumber, l_partkey, CAST(l_shipdate AS DATE)) AS place,
       CustomerName, CustomerEmail, CustomerAddress, ProductName, Category, {ORDER_COLUMNS}
FROM typed""",
    "csv_records": f"""WITH {EXPORT}
SELECT CONCAT_WS('-', l_orderkey, l_linenumber, l_partkey, CAST(l_shipdate AS DATE)) AS place,
       CustomerName, CustomerEmail, CustomerAddress, ProductName, Category, {ORDER_COLUMNS}
FROM typed""",
    "accepted_orders": f"WITH {EXPORT}\nSELECT {ORDER_COLUMNS} FROM accepted",
    "ingest_customers": f"WITH {EXPORT}\nSELECT {CUSTOMER_COLUMNS} FROM {first_rows('typed', 'CustomerID')}",
    "ingest_products": f"WITH {EXPORT}\nSELECT {PRODUCT_COLUMNS} FROM {first_rows('typed', 'ProductID')}",
    "ingest_orders": f"WITH {EXPORT}\nSELECT {ORDER_COLUMNS} FROM {first_rows('accepted', 'OrderID')}",
    "refresh_append": f"WITH {EXPORT}\nSELECT {ORDER_COLUMNS} FROM "
    + first_rows("accepted", "OrderID", STORED_FIRST),
    "refresh_append_customers": f"WITH {EXPORT}\nSELECT {CUSTOMER_COLUMNS} FROM "
    + first_rows("typed", "CustomerID", STORED_FIRST),
    "refresh_append_products": f"WITH {EXPORT}\nSELECT {PRODUCT_COLUMNS} FROM "
    + first_rows("typed", "ProductID", STORED_FIRST),
    "refresh_overwrite": f"WITH {EXPORT}\nSELECT {ORDER_COLUMNS} FROM "
    + first_rows("accepted", "OrderID", where=NEW_ONLY),
    "refresh_append_small_load": f"WITH {EXPORT}\nSELECT {ORDER_COLUMNS} FROM "
    + first_rows("accepted", "OrderID", STORED_FIRST),
    "load_report": load_counts(),
    "append_by_key_index": f"WITH {EXPORT}\nSELECT {ORDER_COLUMNS} FROM "
    + first_rows("accepted", "OrderID", STORED_FIRST),
    "compacted_orders": f"WITH {EXPORT}\nSELECT {ORDER_COLUMNS} FROM "
    + first_rows("accepted", "OrderID", STORED_FIRST),
    "maintained_total": of_stored(f"""WITH {STORED}
SELECT COALESCE(CAST({SUM} AS DOUBLE), 0.0) AS total_revenue FROM sales WHERE {RANGE}"""),
    "maintained_by_product": of_stored(by_product(STORED)),
    "maintained_by_category": of_stored(by_category(STORED)),
    "maintained_by_region": of_stored(by_region(STORED)),
    "maintained_trends_monthly": of_stored(trend("STRFTIME(DateOfSale, '%Y-%m')", STORED)),
    "maintained_trends_yearly": of_stored(trend("STRFTIME(DateOfSale, '%Y')", STORED)),
    "maintained_summary": of_stored(summary(STORED)),
    "landed_orders": f"""WITH {EXPORT}
SELECT {ORDER_COLUMNS} FROM (
  SELECT * REPLACE (CONCAT_WS('-', l_orderkey, l_linenumber, l_partkey, CAST(l_shipdate AS DATE)) AS OrderID)
  FROM typed WHERE ProductID IS NOT NULL AND CustomerID IS NOT NULL AND DateOfSale IS NOT NULL)""",
    "quarantined_rows": f"""WITH {ASIDE}
SELECT CONCAT_WS('-', a.l_orderkey, a.l_linenumber, a.l_partkey, CAST(a.l_shipdate AS DATE)) AS place,
       CONCAT_WS('; ',
         CASE WHEN surplus THEN 'cells beyond the header: ,,extra' END,
         CASE WHEN too_large THEN 'UnitPrice is too large: 99999999999.00' END,
         CASE WHEN a.OrderID IS NULL THEN 'no OrderID' END,
         CASE WHEN a.ProductID IS NULL THEN 'no ProductID' END,
         CASE WHEN a.CustomerID IS NULL THEN 'no CustomerID' END,
         CASE WHEN a.DateText IS NULL THEN 'no DateOfSale'
              WHEN a.DateOfSale IS NULL THEN 'DateOfSale is unreadable: ' || a.DateText END) AS reasons,
       CASE WHEN too_large THEN '99999999999.00' ELSE a.PriceText END AS price,
       CASE WHEN a.OrderID IS NULL THEN '' ELSE a.OrderID END AS order_id
FROM aside a WHERE refused OR no_order""",
    "orders_beside_quarantine": f"WITH {ASIDE}\nSELECT {ORDER_COLUMNS} FROM aside WHERE NOT refused AND NOT no_order",
    "quarantine_balance": f"""WITH {ASIDE}
SELECT COUNT(*) AS rows_read, COUNT(*) FILTER (NOT refused AND NOT no_order) AS orders_accepted,
       COUNT(*) FILTER (refused OR no_order) AS rows_rejected, COUNT(*) FILTER (refused) AS rows_refused,
       COUNT(*) FILTER (NOT refused AND CustomerID IS NOT NULL) AS customers_accepted,
       COUNT(*) FILTER (NOT refused AND ProductID IS NOT NULL) AS products_accepted
FROM aside""",
    "revenue_by_category_after_ingest": by_category(INGESTED),
    "revenue_by_region_after_ingest": by_region(INGESTED),
    "revenue_summary_after_ingest": summary(INGESTED),
}
