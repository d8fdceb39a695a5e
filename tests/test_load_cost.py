"""What a load does once, and no oftener: joins over the lines, texts parsed, lines read."""

from __future__ import annotations

from pathlib import Path

import pyarrow.parquet as pq
import pytest
from conftest import flat_row, write_csv
from pyspark.sql import functions as F

import salestide.plans.refresh as loading
from checks.spark_side import _without_broadcast
from salestide.functions.cleaning import NA_TOKENS, all_na_to_null, is_rounded, na_to_null, parse_amount
from salestide.functions.dates import parse_sale_date
from salestide.operators.first_wins import POSITION
from salestide.operators.star import type_rows
from salestide.schemas import DISCOUNT, FLAT_HEADER, PRICE
from salestide.sources import trade_tables
from salestide.sources.flat_csv import read_flat

KEY_INDEX = {"CustomerID", "ProductID", "OrderID"}


def joins_above(plan, column: str) -> int | None:
    """Joins between the plan's top and the relation with this column."""
    children = plan.children()
    if not children.size():
        return 0 if f"{column}#" in plan.output().toString() else None
    for k in range(children.size()):
        below = joins_above(children.apply(k), column)
        if below is not None:
            return below + (plan.nodeName() == "Join")
    return None


def test_lines_pass_two_joins(spark, tmp_path):
    for name, schema in trade_tables.SCHEMAS.items():
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    plan = trade_tables.flat_export(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan()
    analysed = trade_tables.flat_export(spark, str(tmp_path))._jdf.queryExecution().analyzed()
    assert joins_above(analysed, "l_orderkey") == 2
    assert joins_above(plan, "l_orderkey") in (2, None)  # None: known to be empty


def test_texts_are_not_cleaned_in_the_generated_method(spark):
    rows = spark.range(3).select(F.concat(F.lit("N"), F.when(F.col("id") == 1, "A").otherwise("B")).alias("t"))
    cleaned = rows.select(na_to_null(F.col("t")).alias("t"))
    assert sorted(r.t or "" for r in cleaned.collect()) == ["", "NB", "NB"]
    text = cleaned._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple")
    )
    top = next(line for line in text.splitlines() if "forall" in line)
    assert not top.lstrip(" +-").startswith("*")


def test_one_lambda_cleans_a_row_outside_the_generated_method(spark):
    texts = [F.concat(F.col(f"`{h}`"), F.lit("")).alias(h) for h in FLAT_HEADER]
    made = spark.createDataFrame([flat_row()]).select(*texts, F.struct(F.lit(1).alias("n")).alias(POSITION))
    rows = type_rows(made.repartition(1))
    assert [(r.OrderID, r.Region) for r in rows.collect()] == [("o1", "North")]
    simple = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple")
    plan = rows._jdf.queryExecution().explainString(simple).splitlines()
    cleaning = next(line for line in plan if "INSET" in line)
    assert cleaning.count("forall") == 1, cleaning
    assert not cleaning.lstrip(" +-").startswith("*")


@pytest.mark.parametrize("tokens", [NA_TOKENS, ("x",), ("x", None), ()])
def test_texts_cleaned_at_once_are_those_cleaned_by_themselves(spark, tokens):
    given = [*NA_TOKENS, None, "x", " NA", "na ", "0", "N/A\n", "naïve"]
    rows = spark.createDataFrame([(t, given[-1 - i]) for i, t in enumerate(given)], "a string, b string")
    texts = [F.col("a"), F.col("b"), F.upper("a")]
    together = rows.select(*(t.alias(str(n)) for n, t in enumerate(all_na_to_null(texts, tokens)))).collect()
    alone = rows.select(*(na_to_null(t, tokens).alias(str(n)) for n, t in enumerate(texts))).collect()
    assert together == alone


def dictionaries(folder) -> dict[str, bool]:
    """For each column of a folder's files, has it a dictionary anywhere?"""
    found: dict[str, bool] = {}
    for path in Path(folder).rglob("*.parquet"):
        groups = pq.read_metadata(path)
        for g in range(groups.num_row_groups):
            for c in range(groups.num_columns):
                column = groups.row_group(g).column(c)
                name = column.path_in_schema
                found[name] = found.get(name, False) or column.has_dictionary_page
    return found


def test_no_dictionaries_for_staged_rows_and_keys(spark, tmp_path, monkeypatch):
    staged, delete = {}, loading.delete_tree

    def looked_at(session, path):
        staged.update(dictionaries(path))
        delete(session, path)

    monkeypatch.setattr(loading, "delete_tree", looked_at)
    home = str(tmp_path / "w")
    # Enough rows for dictionaries to be worth it to a writer that may.
    rows = [flat_row(order=f"o{i}", product=f"p{i % 40}", customer=f"c{i % 30}") for i in range(400)]
    with _without_broadcast(spark):
        loading.refresh(spark, write_csv(tmp_path / "a.csv", rows), home)
    assert "ProductName" in staged and not any(staged.values()), staged
    orders, keys = dictionaries(f"{home}/orders"), dictionaries(f"{home}/keys")
    assert not orders["OrderID"] and orders["Region"] and orders["ProductID"]
    assert set(keys) == KEY_INDEX and not any(keys.values()), keys
    assert not dictionaries(f"{home}/customers")["CustomerID"]


def test_quick_ways_agree_with_the_full_ones(spark):
    texts = [
        "2024-01-05", "0999-12-31", "0000-01-01", "2023-02-29", "2024-02-29", "2024-13-01", "2024-1-5", "2024-01-05 ",
        " 2024-01-05", "2024-01-05\n", "12024-01-05", "٢٠٢٤-01-05", "20240105", "", None,
    ]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    plain = F.try_to_timestamp("t", F.lit("yyyy-M-d")).cast("date")
    got = frame.select("t", parse_sale_date("t").cast("string").alias("ours"), plain.cast("string").alias("full")).collect()
    assert all(r.ours == r.full for r in got), got
    assert got[0].ours == "2024-01-05"

    numbers = ["1", "1.", "1.12345", "1.1234", "1.12340", "00000000000000000001.1", "1e-5", "1E3", "+1.5", "-1.00001",
               "999999999999999", "999999999999999.99999", ".5", "abc", "", "1.1234567", "1\n", None]
    frame = spark.createDataFrame([(t,) for t in numbers], "t string")
    for kind in (PRICE, DISCOUNT):
        parsed = parse_amount(F.col("t"), kind)
        full = F.coalesce(F.col("t").try_cast("decimal(38,18)") != parsed, F.lit(False))
        for r in frame.select("t", is_rounded(F.col("t"), parsed, kind).alias("ours"), full.alias("full")).collect():
            assert r.ours == r.full, r


def test_spanning_lines_are_read_once_for_the_records(spark, tmp_path):
    path = tmp_path / "a.csv"
    row = ",".join(['"a\nb"', *["x"] * (len(FLAT_HEADER) - 1)])
    path.write_text(",".join(FLAT_HEADER) + "\n" + row + "\n")
    rows = read_flat(spark, str(path))
    assert [r["Order ID"] for r in rows.collect()] == ["a\nb"]
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    # Records on one line and on several are two branches over the same shuffled lines.
    assert plan.count("] text") == 2, plan
