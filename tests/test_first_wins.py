import random

import pytest
from conftest import row_set
from pyspark.sql import functions as F

from salestide.operators.first_wins import POSITION, first_wins, insert_or_ignore


@pytest.fixture(scope="module")
def make_rows(spark):
    schema = f"k string, a string, b bigint, {POSITION} struct<f: string, n: bigint>"
    return lambda rows: spark.createDataFrame(rows, schema)


def test_first_row_is_kept_whole_even_with_nulls(make_rows):
    rows = make_rows([
        ("k1", "late", 1, ("f", 9)),
        ("k1", None, None, ("f", 2)),
        ("k2", "x", 5, ("g", 0)),
        ("k2", "y", 6, ("f", 7)),
    ])
    assert row_set(first_wins(rows, "k")) == {("k1", None, None), ("k2", "y", 6)}


def test_hot_key_against_brute_force(make_rows):
    rng = random.Random(5)
    keys = ["hot" if rng.random() < 1 / 3 else f"k{rng.randrange(300)}" for _ in range(3000)]
    data = [(k, f"a{i}", i, ("f", i)) for i, k in enumerate(keys)]
    expected = {}
    for k, a, b, _ in data:
        expected.setdefault(k, (k, a, b))
    rng.shuffle(data)
    assert row_set(first_wins(make_rows(data).repartition(6), "k")) == set(expected.values())


@pytest.mark.parametrize("small", [True, False])
def test_insert_or_ignore(make_rows, small):
    rng = random.Random(6)
    stored_keys = {f"k{i}" for i in range(0, 300, 3)}
    stored = make_rows([(k, "old", 0, ("s", 0)) for k in stored_keys]).drop(POSITION)
    data = [(f"k{rng.randrange(300)}", f"a{i}", i, ("f", i)) for i in range(1500)]
    expected = {}
    for k, a, b, _ in data:
        if k not in stored_keys:
            expected.setdefault(k, (k, a, b))
    added = insert_or_ignore(make_rows(data), stored, "k", keys_fit_broadcast=small)
    assert row_set(added.select("k", "a", "b")) == set(expected.values())
    assert added.filter(F.col("k").isNull()).count() == 0
