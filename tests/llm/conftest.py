from __future__ import annotations

import pytest

from salestide.llm.tables import ship_code


@pytest.fixture(scope="session", autouse=True)
def _shipped(spark):
    ship_code(spark)


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

LONG = " ".join(f"word{i % 997}x{i % 31}" for i in range(8_000))

# Nulls in every column, empty and blank texts, a very long one, ties, repeated rows.
AWKWARD = [
    (1, None, "en", "a", None),
    (2, "", "en", "a", 0),
    (3, " \t\n ", None, "a", 4),
    (4, "One line of text that is quite ordinary, ended by a full stop.", "en", None, 10),
    (5, "One line of text that is quite ordinary, ended by a full stop.", "en", None, 10),
    (6, LONG, "de", "b", len(LONG)),
    (7, LONG + "!", "de", "b", len(LONG) + 1),
    (8, LONG, "fr", "b", len(LONG)),
    (8, LONG, "fr", "b", len(LONG)),
    (9, "漢字 Ünïcödé ΑΣ İx \U0001f600 a\x1cb é", "xx", "ü", 5),
    (10, "12345 67890 !!! ???", "en", "a", 3),
    (None, "no key here", "en", "a", 3),
]


@pytest.fixture(scope="session")
def awkward(spark):
    return spark.createDataFrame(AWKWARD, SCHEMA).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


CLASHING = ["_key", "_sha", "_id", "_text", "name", "size", "quality", "secrets", "fp", "ids", "key", "n", "_rank"]


@pytest.fixture(scope="session")
def clashing(awkward):
    """The awkward rows with columns named like the operators' own."""
    from pyspark.sql import functions as F

    return awkward.select("*", *[F.lit(7).alias(c) for c in CLASHING])


SAMPLE = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sample(spark):
    return spark.read.parquet(f"{SAMPLE}/documents.parquet")
