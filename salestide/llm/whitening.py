"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation.

With X the centred rows, two chains of unit vectors are grown in turns, u by products Xv
over the distributed rows and v by products of the transposed X with u:

    alpha u' = X v - beta u      beta v' = X'u' - alpha v

Every new u and v is made orthogonal to all before it. The numbers alpha and beta form a
bidiagonal matrix no larger than a vector is long; its singular value decomposition
gives the components (the v's combined) and the deviations along them. The chains are
grown to the full width, so nothing depends on a convergence test; where a chain ends
early, as with equal deviations, it goes on from a new direction.

The u's, as long as the table, are never stored: each one is X times a short vector that
the driver keeps, so a pass over the rows needs nothing but the rows and a few short
vectors, and a lost task is simply run again. One pass a step forms the new u, its
products with the u's before and with X, all at once; what a task returns is two short
vectors, added up by place before they reach the driver.

Entries become integers first, so counts, sums and deviations are exact.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salestide.llm.tables import saved

SCALE = 64
SHIFT = 1_000_000
COMPONENTS = 32
#: Rows whose numbers are worked on at once.
ROWS_AT_ONCE = 4096
#: A deviation below this share of the largest is rounding, not a component.
NEGLIGIBLE = 1e-9
#: A new direction shorter than this, against the largest number so far, is rounding.
ENDED = 1e-11


def whole_numbers(vector: Column) -> Column:
    """The vector's entries as integers; null where an entry is null or not finite or
    its integer doesn't fit."""
    # An entry beyond this cannot be told from its neighbours as an integer anyway.
    bound = 2.0**62 / SCALE
    fit = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < bound))
    scaled = F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE).cast("long") + SHIFT)
    return F.when(F.coalesce(fit, F.lit(False)), scaled)


def fit_rows(embeddings: DataFrame, key: str, vector: str) -> DataFrame:
    """(``_key``, ``x``) of the rows that take part, written to the shared folder.

    Vectors have one length: that of the most rows, and of those the greatest.
    """
    rows = embeddings.select(F.col(f"`{key}`").alias("_key"), whole_numbers(F.col(f"`{vector}`")).alias("x"))
    rows = saved(rows.where("x IS NOT NULL"), "whole-vectors")
    sizes = rows.groupBy(F.size("x").alias("size")).agg(F.count("*").alias("n"))
    usual = sizes.orderBy(F.desc("n"), F.desc("size")).first()
    return rows if usual is None else rows.where(F.size("x") == usual["size"])


def _blocks(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS_AT_ONCE):
            part = batch.slice(at, ROWS_AT_ONCE)
            flat = part.column(column).flatten().to_numpy()
            yield part, flat.reshape(part.num_rows, -1)


def _summed(rows: DataFrame, partial: Callable[[np.ndarray], np.ndarray], kind: str) -> np.ndarray:
    """The sum over all blocks of rows of ``partial(block)``, a short vector. Tasks add
    up their own blocks, then places are added up over the tasks."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        total = None
        for _, x in _blocks(batches, 0):
            part = partial(x)
            total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total)], ["place", "v"])

    parts = rows.select("x").mapInArrow(work, f"place int, v {kind}")
    sums = parts.groupBy("place").agg(F.sum("v").alias("v")).collect()
    return np.array([r["v"] for r in sorted(sums)])


class Directions:
    """The chains of unit vectors, as far as they have grown. ``v`` holds the right
    ones; ``p`` the short vectors whose product with X are the left ones; ``xu`` the
    products of the transposed X with the left ones."""

    def __init__(self, width: int, seed: int) -> None:
        self.width = width
        self.v, self.p, self.xu = (np.zeros((width, 0)) for _ in range(3))
        self.alphas: list[float] = []
        self.betas: list[float] = []
        self.random = np.random.default_rng(seed)
        self.largest = 0.0

    def _unit(self, w: np.ndarray) -> tuple[np.ndarray, float]:
        """``w`` made orthogonal to all v, as unit vector, and its length."""
        for _ in range(2):
            w = w - self.v @ (self.v.T @ w)
        size = float(np.linalg.norm(w))
        return (w / size if size else w), size

    def fresh(self) -> np.ndarray:
        w, _ = self._unit(self.random.standard_normal(self.width))
        return self._unit(w)[0]

    def left(self, step: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> None:
        """Adds the left vector that belongs to the last v, by one pass over the rows."""
        k = self.p.shape[1]
        v = self.v[:, -1]
        beta = self.betas[-1] if self.betas else 0.0
        q = v - beta * self.p[:, -1] if beta else v
        sums = step(q, self.p)
        square, overlap, xu = sums[0], sums[1 : 1 + k], sums[1 + k :]
        # Made orthogonal to the left vectors before it, and so are all its products.
        square = square - overlap @ overlap
        alpha = float(np.sqrt(max(square, 0.0)))
        self.largest = max(self.largest, alpha)
        if alpha <= ENDED * self.largest or not alpha:
            alpha, p, xu = 0.0, np.zeros(self.width), np.zeros(self.width)
        else:
            p = (q - self.p @ overlap) / alpha
            xu = (xu - self.xu @ overlap) / alpha
        self.alphas.append(alpha)
        self.p, self.xu = np.column_stack([self.p, p]), np.column_stack([self.xu, xu])

    def right(self, w: np.ndarray | None) -> None:
        """Adds the right vector that continues from the last left one; a new direction
        where nothing is left of it."""
        unit, beta = (None, 0.0) if w is None else self._unit(w)
        if beta <= ENDED * self.largest or unit is None:
            unit, beta = self.fresh(), 0.0
        if self.v.shape[1]:
            self.betas.append(beta)
        self.largest = max(self.largest, beta)
        self.v = np.column_stack([self.v, unit])


def bidiagonalised(rows: DataFrame, mean: np.ndarray, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Singular values of the centred rows, falling, and the right singular vectors as
    columns. One pass over the rows for each entry of a vector."""

    def step(q: np.ndarray, p: np.ndarray) -> np.ndarray:
        def partial(x: np.ndarray) -> np.ndarray:
            centred = x - mean
            u = centred @ q
            return np.concatenate([[u @ u], (centred @ p).T @ u, centred.T @ u])

        return _summed(rows, partial, "double")

    width = len(mean)
    if not width:
        return np.zeros(0), np.zeros((0, 0))
    chains = Directions(width, seed)
    chains.right(None)
    for k in range(width):
        chains.left(step)
        if k + 1 < width:
            chains.right(chains.xu[:, -1] - chains.alphas[-1] * chains.v[:, -1] if chains.alphas[-1] else None)
    small = np.diag(chains.alphas) + np.diag(chains.betas, 1)
    _, sizes, turned = np.linalg.svd(small)
    return sizes, chains.v @ turned.T


def _exact_squares(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over the entries of (n*x - sum)^2 for each row; None beyond a long."""
    bound = max([n * int(v) + abs(s) for v, s in zip(np.abs(x).max(0), sums)], default=0)
    if x.shape[1] * bound * bound < 1 << 63:
        far = n * x - np.array(sums, np.int64)
        return (far * far).sum(1).tolist()
    far = [[n * v - s for v, s in zip(row, sums)] for row in x.tolist()]
    exact = (sum(v * v for v in row) for row in far)
    return [e if e < 1 << 63 else None for e in exact]


class Whitening:
    """Mean, components (columns), eigenvalues and their share of the whole variance."""

    def __init__(self, rows: DataFrame, n: int, sums: list[int], keep: int, seed: int) -> None:
        self.n, self.sums = n, sums
        self.mean = np.array([s / n for s in sums])
        sizes, vectors = bidiagonalised(rows, self.mean, seed)
        values = sizes**2 / n
        kept = (sizes > NEGLIGIBLE * sizes.max(initial=0.0)) & (np.arange(len(sizes)) < keep)
        self.eigenvalues, self.vectors = values[kept], vectors[:, kept]
        # Of the two signs, the one with a positive largest entry.
        if self.vectors.size:
            at = np.abs(self.vectors).argmax(0)
            self.vectors = self.vectors * np.sign(self.vectors[at, np.arange(len(at))])
        self.explained = self.eigenvalues / values.sum() if len(self.eigenvalues) else self.eigenvalues
        self.weights = self.vectors / np.sqrt(self.eigenvalues)

    def white(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ self.weights


def _count_and_sums(rows: DataFrame) -> tuple[int, list[int]]:
    sums = _summed(rows, lambda x: np.concatenate([[len(x)], x.sum(0)]).astype(np.int64), "long")
    return (int(sums[0]), [int(s) for s in sums[1:]]) if len(sums) else (0, [])


def fitted(rows: DataFrame, keep: int = COMPONENTS, seed: int = 1) -> Whitening | None:
    """The whitening of rows from ``fit_rows``; None without rows."""
    n, sums = _count_and_sums(rows)
    return Whitening(rows, n, sums, keep, seed) if n else None


def identity_error(rows: DataFrame, model: Whitening) -> float:
    """Largest entry, without sign, of the whitened rows' covariance minus the identity."""
    k = len(model.eigenvalues)

    def partial(x: np.ndarray) -> np.ndarray:
        white = model.white(x)
        return np.concatenate([white.sum(0), (white.T @ white).ravel()])

    sums = _summed(rows, partial, "double")
    mean = sums[:k] / model.n
    covariance = sums[k:].reshape(k, k) / model.n - np.outer(mean, mean)
    return float(np.abs(covariance - np.eye(k)).max(initial=0.0))


def whitened(
    embeddings: DataFrame, key: str = "vec_id", vector: str = "embedding", keep: int = COMPONENTS
) -> DataFrame:
    """One row for each fit row and component: key, ``component`` from 1, ``n``,
    ``deviation``, ``whitened``, ``explained`` and ``identity_error``.

    Left out are null vectors, vectors with a null, infinite or undefined entry or one
    whose integer is no long, and vectors of another length than most. Rows with the
    same key or vector count one by one; a null key is a key like any other. Directions
    without variance are no components: of one row, or equal ones, or an empty table,
    nothing comes back. ``deviation`` is null where it exceeds a long.
    """
    rows = fit_rows(embeddings, key, vector)
    model = fitted(rows, keep)
    kind = embeddings.schema[key].dataType.simpleString()
    schema = (
        f"`{key}` {kind}, component int, n long, deviation long, whitened double, "
        "explained double, identity_error double"
    )
    if model is None or not len(model.eigenvalues):
        return embeddings.sparkSession.createDataFrame([], schema)
    error = identity_error(rows, model)
    names = [key, "component", "n", "deviation", "whitened", "explained", "identity_error"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(model.eigenvalues)
        for part, x in _blocks(batches, 1):
            m = len(x)
            each = pa.array(np.repeat(np.arange(m), k))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0).take(each),
                    pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()),
                    pa.array(np.full(m * k, model.n), pa.int64()),
                    pa.array(_exact_squares(x, model.n, model.sums), pa.int64()).take(each),
                    pa.array(model.white(x).ravel()),
                    pa.array(np.tile(model.explained, m)),
                    pa.array(np.full(m * k, error)),
                ],
                names,
            )

    return rows.mapInArrow(work, schema)
