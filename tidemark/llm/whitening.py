"""Embedding whitening: pivoted Cholesky of the centred scatter, then one-sided Jacobi on the triangular factor.

Entries become whole numbers x = floor(1024 * entry) + 100000, so sums and the centred scatter are exact, the same in
whatever order they are added. Tasks emit partial sums of a fixed size (the square of the dimensions); the factorisation
works on one such square on the driver, so its work doesn't grow with the rows.

* Pivoted Cholesky gives V = L L' (rows of L permuted) and stops where what is left is rounding, so L has as many columns
  as V has rank.
* One-sided Jacobi rotates the columns of L until they are orthogonal. Their squared norms are V's eigenvalues, and the
  columns over their norms are the components, numbered by falling eigenvalue. The entry that is largest in magnitude is
  positive.

Defined results: vectors that are null, empty or hold null or non-finite entries are dropped, as are those whose length isn't
the commonest (of lengths as common, the longest stays); there are no more components than V has rank, so equal vectors
or a single one give no rows, as does an empty table; a null vec_id stays null and repeated rows count each; other columns
pass by. Numbers beyond 64 bits (entries of 2**52 or more, deviations of 2**63 or more) fail the job with ``overflow``.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
#: Rows of a batch that are multiplied at a time.
ROWS = 4096
MOST_SWEEPS = 60
_EPS = float(np.finfo(float).eps)


# --- factorisation ---------------------------------------------------------------------------------------------------


def pivoted_cholesky(v: np.ndarray) -> np.ndarray:
    """L with v = L @ L.T, one column for each pivot that is more than rounding."""
    size = len(v)
    factor, left = np.zeros((size, size)), np.diag(v).astype(float).copy()
    least = size * _EPS * max(left.max(initial=0.0), 0.0)
    for k in range(size):
        pivot = int(np.argmax(left))
        if left[pivot] <= least:
            return factor[:, :k]
        column = (v[:, pivot] - factor[:, :k] @ factor[pivot, :k]) / np.sqrt(left[pivot])
        column[left == -np.inf] = 0.0  # rows that were pivots before
        column[pivot] = np.sqrt(left[pivot])
        factor[:, k] = column
        left = left - column**2
        left[pivot] = -np.inf
    return factor


def _tournament(n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rounds of disjoint pairs of n columns (n even) that meet every pair once."""
    seats = np.arange(n)
    for _ in range(n - 1):
        yield seats[: n // 2].copy(), seats[n // 2 :][::-1].copy()
        seats[1:] = np.roll(seats[1:], 1)


def one_sided_jacobi(factor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of factor @ factor.T, falling, and its unit eigenvectors as columns."""
    a = np.concatenate([factor, np.zeros((len(factor), factor.shape[1] % 2))], axis=1)
    for _ in range(MOST_SWEEPS):
        turned = False
        for p, q in _tournament(a.shape[1]) if a.shape[1] else ():
            x, y = a[:, p], a[:, q]
            one, two, both = (x * x).sum(axis=0), (y * y).sum(axis=0), (x * y).sum(axis=0)
            turn = np.abs(both) > _EPS * np.sqrt(one * two)
            if not turn.any():
                continue
            turned = True
            p, q, x, y, one, two, both = p[turn], q[turn], x[:, turn], y[:, turn], one[turn], two[turn], both[turn]
            zeta = (two - one) / (2 * both)
            tangent = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
            cosine = 1 / np.hypot(1.0, tangent)
            a[:, p], a[:, q] = cosine * x - cosine * tangent * y, cosine * tangent * x + cosine * y
        if not turned:
            break
    norms = np.sqrt((a * a).sum(axis=0))
    order = [i for i in np.argsort(-norms, kind="stable") if norms[i] > 0]
    vectors = a[:, order] / norms[order]
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(order))]) if order else np.ones(0)
    return norms[order] ** 2, vectors * signs


# --- sums ------------------------------------------------------------------------------------------------------------


def _matrices(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[np.ndarray]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.column("x").slice(at, ROWS)
            yield part.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)



def _product(one: np.ndarray, two: np.ndarray) -> list[list[int]]:
    """one.T @ two of whole numbers, exactly."""
    most = max(int(np.abs(one).max(initial=0)), int(np.abs(two).max(initial=0)))
    if most**2 * len(one) < 2**53:
        return [[int(x) for x in row] for row in (one.T.astype(float) @ two.astype(float))]
    return (one.T.astype(object) @ two.astype(object)).tolist()


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each length, the number of vectors (at -1) and the sum at each place."""
    totals: dict[int, tuple[int, np.ndarray]] = {}
    for batch in batches:
        sizes, values = batch.column("size").to_numpy(), batch.column("x").flatten().to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes)
        for size in np.unique(sizes).tolist():
            rows = np.flatnonzero(sizes == size)
            part = values[(ends[rows] - size)[:, None] + np.arange(size)]
            n, sums = totals.get(size, (0, np.zeros(size, object)))
            totals[size] = (n + len(rows), sums + part.astype(object).sum(axis=0) if np.abs(part).max(initial=0) >= 2**40 else sums + part.sum(axis=0).astype(object))
    rows = [(size, at, total) for size, (n, sums) in totals.items() for at, total in enumerate([n, *sums.tolist()], -1)]
    yield _decimals(rows, ["size", "at", "total"])


def _decimals(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] if i < 2 else str(r[i]) for r in rows], k) for i, k in enumerate(kinds)], names=names)


def _scatter(width: int, centre: list[int]):
    """Partial sums of the products of y = x less the whole part of the mean."""

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for x in _matrices(batches, width):
            y = x - np.array(centre, np.int64)
            part = np.array(_product(y, y), object)
            total = part if total is None else total + part
        rows = [] if total is None else [(i, k, total[i, k]) for i in range(width) for k in range(i, width)]
        yield _decimals(rows, ["i", "k", "total"])

    return scatter


class Whitening:
    """Means and components of a table of whole vectors."""

    def __init__(self, n: int, sums: list[int], centre: list[int], products: dict[tuple[int, int], int]):
        self.n, self.centre = n, centre
        self.rest = [s - n * c for s, c in zip(sums, centre)]  # n * (mean - centre), so n*x - S = n*y - rest
        v = np.zeros((len(sums), len(sums)))
        for (i, k), total in products.items():
            v[i, k] = v[k, i] = (n * total - self.rest[i] * self.rest[k]) / n**2  # whole numbers, rounded once
        self.values, self.vectors = one_sided_jacobi(pivoted_cholesky(v))
        self.trace = float(np.trace(v))

    def deviations(self, y: np.ndarray) -> tuple[np.ndarray, list[int]]:
        """(n*x - S) / n for each entry, and the exact sum of squares of n*x - S for each row."""
        most = self.n * (int(np.abs(y).max(initial=0)) + 1)
        if y.shape[1] * most**2 < 2**63:
            whole = self.n * y - np.array(self.rest, np.int64)
            return whole / self.n, (whole * whole).sum(axis=1).tolist()
        whole = self.n * y.astype(object) - np.array(self.rest, object)
        squares = (whole * whole).sum(axis=1).tolist()
        if max(squares) >= 2**63:
            raise OverflowError("overflow: a deviation takes more than 64 bits")
        return (whole / self.n).astype(float), squares


def _projected(model: Whitening, width: int, components: int):
    axes = model.vectors[:, :components] / np.sqrt(model.values[:components])

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            deviation, whitened = [], [np.zeros((0, axes.shape[1]))]
            for x in _matrices(iter([batch]), width):
                centred, squares = model.deviations(x - np.array(model.centre, np.int64))
                deviation += squares
                whitened.append(centred @ axes)
            flat = np.concatenate(whitened)
            offsets = pa.array(np.arange(len(flat) + 1, dtype=np.int32) * axes.shape[1])
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(deviation, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(flat.ravel()))], names=["row", "deviation", "whitened"])

    return projected


def _whole_vectors(rows: DataFrame, vector: str, carry: list[str]) -> DataFrame:
    """(row, size, x): the sound vectors as whole numbers."""
    entry = lambda c: c.cast("double")
    sound = F.size(vector) > 0
    sound &= F.forall(vector, lambda c: F.coalesce(F.abs(entry(c)) < float("inf"), F.lit(False)))
    large = F.exists(vector, lambda c: F.abs(entry(c)) >= float(2**52))
    checked = F.when(large, F.raise_error(F.lit("overflow: an entry takes more than 64 bits")).cast("array<bigint>"))
    x = checked.otherwise(F.transform(vector, lambda c: F.floor(entry(c) * SCALE) + SHIFT))
    held = F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(carry)])
    return rows.where(sound).select(held.alias("row"), F.size(vector).alias("size"), x.alias("x"))


def whiten(rows: DataFrame, vector: str = "embedding", components: int = COMPONENTS, carry: list[str] | None = None) -> DataFrame:
    """One row per vector that takes part: the columns of ``carry`` (by default vec_id), n, deviation, whitened, explained, identity_error.

    ``deviation`` is the sum over dimensions of (n*x - S)**2, exactly; ``whitened`` and ``explained`` are arrays by component:
    projections over the square root of the eigenvalue, and the eigenvalue's share of the trace; ``identity_error`` is the
    largest absolute entry of the whitened covariance less the identity, found over all rows as they are written.
    """
    carry = ["vec_id"] if carry is None else carry
    scratch = Scratch(rows.sparkSession)
    vectors = _whole_vectors(rows, vector, carry)
    kind = f"row struct<{', '.join(f'c{i}: {dict(rows.dtypes)[c]}' for i, c in enumerate(carry))}>, deviation bigint, whitened array<double>"
    total = F.sum(F.col("total").cast("decimal(38,0)")).alias("total")
    sums = scratch.write(vectors.select("size", "x").mapInArrow(_sums, "size int, at int, total string").groupBy("size", "at").agg(total), "vector-sums")
    usual = sums.where("at = -1").orderBy(F.desc("total"), F.desc("size")).first()
    if usual is None:
        model, width, told = None, 0, scratch.write(rows.sparkSession.createDataFrame([], kind), "whitened")
    else:
        width, n = usual["size"], int(usual["total"])
        by_place = [int(r.total) for r in sums.where((F.col("size") == width) & (F.col("at") >= 0)).orderBy("at").collect()]  # one for each dimension
        centre = [s // n for s in by_place]
        usable = vectors.where(F.col("size") == width)
        parts = usable.select("x").mapInArrow(_scatter(width, centre), "i int, k int, total string").groupBy("i", "k").agg(total)
        model = Whitening(n, by_place, centre, {(r.i, r.k): int(r.total) for r in parts.collect()})  # half the square of the dimensions
        told = scratch.write(usable.select("row", "x").mapInArrow(_projected(model, width, components), kind), "whitened")

    kept = 0 if model is None else min(components, len(model.values))
    pairs = list(combinations_with_replacement(range(kept), 2))
    off = [F.abs(F.covar_pop(F.col("whitened")[i], F.col("whitened")[k]) - float(i == k)) for i, k in pairs]
    error = float(told.agg(F.array_max(F.array(*off))).first()[0]) if kept else None
    explained = F.array(*[F.lit(float(model.values[i] / model.trace)) for i in range(kept)]).cast("array<double>")
    return told.where(F.size("whitened") > 0).select(
        *[F.col(f"row.c{i}").alias(c) for i, c in enumerate(carry)],
        F.lit(model.n if model else None).cast("bigint").alias("n"), "deviation", "whitened", explained.alias("explained"), F.lit(error).cast("double").alias("identity_error"),
    )
