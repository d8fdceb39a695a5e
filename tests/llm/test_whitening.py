"""Whitening against a dense eigenvalue decomposition."""

import math

import numpy as np
import pytest

from salestide.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int"


def dense(vectors):
    x = np.floor(64 * np.array(vectors, np.float32).astype(np.float64)).astype(np.int64) + 1_000_000
    n, sums = len(x), x.sum(0)
    centred = x - sums / n
    values, parts = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(values)[::-1]
    deviation = [sum((n * int(v) - int(s)) ** 2 for v, s in zip(row, sums)) for row in x]
    return centred, values[order], parts[:, order], deviation


def check(rows, vectors, keep=32):
    centred, values, parts, deviation = dense(vectors)
    k = min(keep, int((np.sqrt(np.maximum(values, 0)) > 1e-7 * np.sqrt(values[0])).sum()))
    got = sorted((r.vec_id, r.component, r) for r in rows)
    assert [(v, c) for v, c, _ in got] == [(v, c + 1) for v in range(len(vectors)) for c in range(k)]
    white = np.array([r.whitened for *_, r in got]).reshape(-1, k)
    assert all(r.n == len(vectors) and r.deviation == deviation[r.vec_id] and r.identity_error < 1e-8 for *_, r in got)
    assert np.allclose([r.explained for *_, r in got[:k]], values[:k] / values.sum(), rtol=1e-9)
    assert np.abs(white.T @ white / len(white) - np.eye(k)).max() < 1e-8
    return white, centred @ parts[:, :k] / np.sqrt(values[:k])


def frame(spark, vectors):
    return spark.createDataFrame([(i, [float(c) for c in v], 0) for i, v in enumerate(vectors)], SCHEMA)


@pytest.mark.parametrize("width", [3, 40])
def test_like_the_dense_decomposition(spark, width):
    rng = np.random.default_rng(width)
    turn = np.linalg.qr(rng.standard_normal((width, width)))[0]
    vectors = rng.standard_normal((150, width)) * np.linspace(1, 9, width) @ turn + 5
    got, want = check(whitening.whitened(frame(spark, vectors)).collect(), vectors)
    assert np.allclose(np.abs(got), np.abs(want), atol=1e-7)
    assert np.allclose(got * np.sign((got * want).sum(0)), want, atol=1e-7)


def test_sample_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    vectors = [r.embedding for r in table.orderBy("vec_id").collect()]
    got, want = check(whitening.whitened(table).collect(), vectors)
    assert np.allclose(got * np.sign((got * want).sum(0)), want, atol=1e-6)


def test_equal_deviations_and_flat_directions(spark):
    """Repeated eigenvalues end the chain early; constant and dependent entries are no components."""
    cube = [[a, b, c, 7.0, a] for a in (-1.0, 1.0) for b in (-1.0, 1.0) for c in (-1.0, 1.0)]
    white, _ = check(whitening.whitened(frame(spark, cube)).collect(), cube)
    assert white.shape == (8, 3)


def test_large_spread_of_deviations(spark):
    rng = np.random.default_rng(8)
    vectors = rng.standard_normal((80, 6)) * 10.0 ** np.arange(-1, 5)
    check(whitening.whitened(frame(spark, vectors)).collect(), vectors)


def test_unfit_vectors_are_left_out(spark):
    nan, inf = float("nan"), float("inf")
    good = [[1.0, 2.0], [2.0, -1.0], [0.5, 0.25], [0.5, 0.25]]
    bad = [None, [nan, 1.0], [1.0, inf], [-inf, 1.0], [None, 1.0], [], [1.0, 2.0, 3.0], [1e30, 1.0]]
    rows = [(i, v, 0) for i, v in enumerate(good)] + [(100 + i, v, None) for i, v in enumerate(bad)]
    got = whitening.whitened(spark.createDataFrame(rows, SCHEMA)).collect()
    check(got, good)


def test_keys_may_repeat_and_be_null(spark):
    rows = spark.createDataFrame([(None, [1.0, 0.0], 1), (None, [1.0, 0.0], 1), (3, [0.0, 2.0], 1)], SCHEMA)
    got = whitening.whitened(rows).collect()
    assert sorted(str(r.vec_id) for r in got) == ["3", "None", "None"]
    assert all(math.isclose(abs(r.whitened), math.sqrt(2) if r.vec_id == 3 else math.sqrt(0.5)) for r in got)


def test_nothing_to_whiten(spark):
    for rows in ([], [(1, None, 0)], [(1, [1.0, 2.0], 0)], [(1, [2.0], 0), (2, [2.0], 0)], [(1, [], 0), (2, [], 0)]):
        assert whitening.whitened(spark.createDataFrame(rows, SCHEMA)).count() == 0


def test_clashing_names(spark):
    from pyspark.sql import functions as F

    plain = frame(spark, [[1.0, 2.0], [3.0, 1.0], [0.0, 5.0]])
    odd = plain.select("*", *[F.lit(1).alias(c) for c in ("_key", "x", "component", "n", "place")])
    for got, want in zip(*(sorted(whitening.whitened(t).collect()) for t in (odd, plain)), strict=True):
        assert got[:4] == want[:4] and math.isclose(got.whitened, want.whitened, rel_tol=1e-12)


def test_deviation_beyond_a_long_is_null():
    far = np.array([[10**9, 0], [0, 0]])
    assert whitening._exact_squares(far, 2, [10**9, 0])[0] == 10**18
    assert whitening._exact_squares(far * 10, 2, [10**10, 0])[0] is None
