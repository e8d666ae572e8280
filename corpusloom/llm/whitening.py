"""Whitening of embeddings by principal components.

Two scans fit: one sums the quantised vectors, one sums the products of what they
differ by from the mean, rounded to whole numbers, so all sums are exact whole
numbers however rows are dealt; the driver adds the mean's fraction and has the
covariance, correctly rounded.  It diagonalises the small symmetric matrix by cyclic
Jacobi rotations until every off-diagonal entry vanishes beside its diagonal
entries, which keeps small eigenvalues accurate, sorts, and broadcasts the whitening
matrix.  Tasks send one row of sums for each matrix cell; the driver gets one row a
cell, so its memory goes with the dimensions alone.  A third scan measures the
whitened vectors' covariance, the last one writes them.

Defined cases: rows whose vector is null, holds null or non-finite entries, or
entries too large for a long when quantised, are dropped; so are rows of another
length than most rows have (of lengths that are equally frequent the larger counts);
components without variance (below the rounding error of the largest) are left out,
so equal vectors or a single one give no rows; repeated rows and null vec_ids are
rows like others; ``deviation`` is null where it exceeds a long; an empty table gives
an empty result; no other column is read, so none can clash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, tune

SCALE, SHIFT = 64, 1_000_000
#: Differences up to this size are multiplied in doubles, in blocks whose sums stay exact.
_SMALL = 1 << 20
_EXACT = 1 << 53
_LONG = 1 << 62


@dataclass(frozen=True)
class Whitening:
    """A fitted whitening: for the rows of length ``dims``."""

    dims: int
    n: int
    sums: list[int]
    covariance: np.ndarray
    values: np.ndarray
    vectors: np.ndarray

    @property
    def matrix(self) -> np.ndarray:
        return self.vectors / np.sqrt(self.values)


def jacobi(a: np.ndarray, sweeps: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns of a symmetric matrix.

    A cyclic sweep meets every pair once, in rounds of disjoint pairs whose rotations
    are applied together.
    """
    a = np.array(a, float)
    size, n = len(a), len(a) + len(a) % 2
    v = np.eye(size)
    players = np.arange(n)
    floor = np.abs(a).max(initial=0) * 1e-40
    for _ in range(sweeps):
        turned = False
        for _ in range(n - 1):
            p, q = np.minimum(players[: n // 2], players[n // 2 :][::-1]), np.maximum(players[: n // 2], players[n // 2 :][::-1])
            players = np.concatenate([players[:1], players[-1:], players[1:-1]])
            real = q < size
            p, q = p[real], q[real]
            off, x, y = a[p, q], a[p, p], a[q, q]
            large = np.abs(off) > np.maximum(2.0**-53 * np.sqrt(np.abs(x * y)), floor)
            if not large.any():
                continue
            turned = True
            p, q, off, x, y = p[large], q[large], off[large], x[large], y[large]
            theta = (y - x) / (2 * off)
            t = np.where(theta >= 0, 1.0, -1.0) / (np.abs(theta) + np.hypot(theta, 1))
            c = 1 / np.hypot(t, 1)
            s = t * c
            rows_p, rows_q = a[p], a[q]
            a[p], a[q] = c[:, None] * rows_p - s[:, None] * rows_q, s[:, None] * rows_p + c[:, None] * rows_q
            cols_p, cols_q = a[:, p], a[:, q]
            a[:, p], a[:, q] = c * cols_p - s * cols_q, s * cols_p + c * cols_q
            a[p, p], a[q, q] = x - t * off, y + t * off
            a[p, q] = a[q, p] = 0
            cols_p, cols_q = v[:, p], v[:, q]
            v[:, p], v[:, q] = c * cols_p - s * cols_q, s * cols_p + c * cols_q
        if not turned:
            break
    else:
        rest = np.abs(a - np.diag(np.diag(a))).max()
        if rest > 1e-14 * np.abs(np.diag(a)).max():
            raise ArithmeticError(f"Jacobi rotations left {rest} off the diagonal after {sweeps} sweeps")
    e = np.diag(a)
    order = np.argsort(-e, kind="stable")
    return e[order], v[:, order]


def quantise(x: np.ndarray) -> np.ndarray:
    return np.floor(x * SCALE).astype(np.int64) + SHIFT


def _valid(vectors: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places and lengths of rows whose entries can be quantised; all entries, with each row's start."""
    lengths = vectors.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    starts = vectors.offsets.to_numpy()[:-1]
    x = vectors.values.cast(pa.float64()).to_numpy(zero_copy_only=False)  # a null becomes NaN
    bad = np.concatenate([[0], np.cumsum(~(np.abs(x) * SCALE < _LONG))])
    held = np.maximum(lengths, 0)
    good = (lengths > 0) & (bad[starts + held] == bad[starts])
    return np.flatnonzero(good), lengths, np.concatenate([x, [0.0]]), starts


def _blocks(b: pa.RecordBatch, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and quantised vectors of the batch's rows of length ``dims``."""
    good, lengths, x, starts = _valid(b.column(b.num_columns - 1))
    good = good[lengths[good] == dims]
    return good, quantise(x[starts[good][:, None] + np.arange(dims)]) if len(good) else np.empty((0, dims), np.int64)


def _products(d: np.ndarray) -> list[list[int]]:
    """d' d in whole numbers, exactly."""
    out = np.zeros((d.shape[1],) * 2, object)
    large = np.abs(d).max(axis=1, initial=0) > _SMALL
    small = d[~large].astype(float)
    step = max(1, _EXACT // max(1, int(np.abs(small).max(initial=0)) ** 2))
    for at in range(0, len(small), step):
        part = small[at : at + step]
        out += (part.T @ part).astype(np.int64).astype(object)
    if large.any():
        rows = d[large].astype(object)
        out += rows.T @ rows
    return out


def _sum_rows(rows: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[int, int, int]]]) -> dict[tuple[int, int], int]:
    """Sums of (kind, cell, number) over all tasks; numbers are whole and may exceed a long."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = list(run(batches))
        yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int32()), pa.array([f[1] for f in found], pa.int32()), pa.array([Decimal(int(f[2])) for f in found], pa.decimal128(38, 0))], names=["kind", "cell", "number"])

    summed = rows.mapInArrow(emit, "kind int, cell int, number decimal(38,0)").groupBy("kind", "cell").agg(F.sum("number").alias("number"))
    return {(r[0], r[1]): int(r[2]) for r in summed.collect()}


def _lengths_and_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, int]]:
    """Kind: the length; cell -1: rows, cell k: sum of the k-th entries."""
    sums: dict[int, np.ndarray] = {}
    counts: dict[int, int] = {}
    for b in batches:
        good, lengths, *_ = _valid(b.column(b.num_columns - 1))
        for dims in np.unique(lengths[good]).tolist():
            _, x = _blocks(b, dims)
            # halves, as the whole sum may exceed a long
            high, low = (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)
            sums[dims] = sums.get(dims, 0) + (high.astype(object) * (1 << 32) + low.astype(object))
            counts[dims] = counts.get(dims, 0) + len(x)
    for dims, n in counts.items():
        yield dims, -1, n
        for k, s in enumerate(sums[dims]):
            yield dims, k, s


def fit_whitening(rows: DataFrame, vector: str, most: int = 32) -> Whitening | None:
    """The whitening of all valid vectors, with ``most`` components at most; None without a vector."""
    tune(rows.sparkSession)
    only = rows.select(col(rows, vector).cast("array<double>").alias("_v"))
    found = _sum_rows(only, _lengths_and_sums)
    counts = {dims: n for (dims, k), n in found.items() if k < 0}
    if not counts:
        return None
    dims = max(counts, key=lambda k: (counts[k], k))
    n, sums = counts[dims], [found[dims, k] for k in range(dims)]
    centre = np.array([round(Fraction(s, n)) for s in sums], np.int64)
    upper = np.triu_indices(dims)

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, int]]:
        total = 0
        for b in batches:
            total = total + _products(_blocks(b, dims)[1] - centre)
        if not isinstance(total, int):
            for cell, s in enumerate(total[upper]):
                yield 0, cell, s

    cells = _sum_rows(only, scatter)
    off = [s - n * int(c) for s, c in zip(sums, centre)]  # what the rounded centre leaves of the sums
    v = np.zeros((dims, dims))
    for cell, (i, j) in enumerate(zip(*(u.tolist() for u in upper))):
        v[i, j] = v[j, i] = (n * cells[0, cell] - off[i] * off[j]) / n**2  # whole numbers: one rounding
    values, vectors = jacobi(v)
    able = values > dims * 2.0**-52 * max(values[0], 0)
    keep = np.flatnonzero(able)[:most]
    return Whitening(dims, n, sums, v, values[keep], vectors[:, keep])


def _whitened(fit: Whitening, matrix: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    centre = np.array([s // fit.n for s in fit.sums], np.int64)
    rest = np.array([(s % fit.n) / fit.n for s in fit.sums])
    return lambda x: ((x - centre) - rest) @ matrix


def identity_error(rows: DataFrame, vector: str, fit: Whitening) -> float:
    """The largest entry by which the covariance of the whitened vectors differs from the identity, measured over all rows."""
    only = rows.select(col(rows, vector).cast("array<double>").alias("_v"))
    k, whiten, dims = len(fit.values), _whitened(fit, fit.matrix), fit.dims

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, products = np.zeros(k), np.zeros((k, k))
        for b in batches:
            w = whiten(_blocks(b, dims)[1])
            total += w.sum(axis=0)
            products += w.T @ w
        sums = np.concatenate([total, products.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(sums)), pa.int32()), pa.array(sums)], names=["cell", "number"])

    sums = np.zeros(k + k * k)
    for cell, number in only.mapInArrow(run, "cell int, number double").groupBy("cell").agg(F.sum("number")).collect():
        sums[cell] = number
    mean = sums[:k] / fit.n
    return float(np.abs(sums[k:].reshape(k, k) / fit.n - np.outer(mean, mean) - np.eye(k)).max(initial=0))


def whiten(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", most: int = 32) -> DataFrame:
    """For each valid row and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    spark = tune(rows.sparkSession)
    kind = dict(rows.dtypes)[vec_id]
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    fit = fit_whitening(rows, vector, most)
    if fit is None or not len(fit.values):
        return spark.createDataFrame([], schema)
    error = identity_error(rows, vector, fit)
    n, dims, k = fit.n, fit.dims, len(fit.values)
    trace = float(np.trace(fit.covariance))
    matrix, sums = spark.sparkContext.broadcast(fit.matrix), fit.sums
    explained = fit.values / trace
    centre = np.array([s // n for s in sums], np.int64)
    rest = np.array([s % n for s in sums], object)

    def deviations(x: np.ndarray) -> pa.Array:
        d = x - centre
        largest = (int(np.abs(d).max(initial=0)) + 1) * n
        if dims * largest**2 < _LONG:
            return pa.array(((n * d - rest.astype(np.int64)) ** 2).sum(axis=1), pa.int64())
        exact = ((n * d.astype(object) - rest) ** 2).sum(axis=1)
        return pa.array([int(e) if e < 1 << 63 else None for e in exact], pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apply = _whitened(fit, matrix.value)
        for b in batches:
            places, x = _blocks(b, dims)
            at = pa.array(np.repeat(np.arange(len(x)), k))
            m = len(at)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0).take(pa.array(places)).take(at), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(m, n)),
                    deviations(x).take(at), pa.array(apply(x).ravel()), pa.array(np.tile(explained, len(x))), pa.array(np.full(m, error)),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.select(col(rows, vec_id).alias("vec_id"), col(rows, vector).cast("array<double>").alias("_v")).mapInArrow(run, schema)
