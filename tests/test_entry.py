"""The registered queries against their SQL, on whole tables."""

import os
import subprocess
import sys

import pytest

import __spark_entry__ as spark_entry
from checks.compare import differences
from checks.spark_side import QUERIES

FOLDER = os.environ.get("CHECK_FOLDER", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def test_every_query_has_sql():
    """Every query on sales; those on texts have tests of their own in tests/llm."""
    assert set(QUERIES) <= set(spark_entry.queries())
    assert set(QUERIES) <= set(spark_entry.oracle_sql()) <= set(spark_entry.queries())


def test_entry(spark):
    result = spark_entry.entry(spark)
    assert result.columns[:2] == ["ProductID", "ProductName"]
    assert result.count() > 0


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, name):
    assert differences(spark, FOLDER, name) == []


def test_sales_queries_stand_alone():
    """Without the text operators, or a library that they need, the others remain."""
    code = (
        "import sys; sys.modules['xxhash'] = sys.modules['tokenizers'] = None; sys.modules['salestide.llm'] = None\n"
        "import __spark_entry__ as e; from checks.spark_side import QUERIES\n"
        "assert set(e.queries()) == set(QUERIES) == set(e.oracle_sql())"
    )
    root = os.path.dirname(spark_entry.__file__)
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True, timeout=120)
