"""Embedding whitening by an exact distributed covariance and an eigensolver of its own.

Vectors are taken to whole numbers, so the sums that tasks add up are exact
and do not depend on how rows are dealt out: one pass gives the means, a
second the products of what is centred on the nearest whole mean. The
covariance (dimensions x dimensions, nothing that grows with the rows) is
brought to tridiagonal form by Householder reflections; bisection on Sturm
counts gives the leading eigenvalues and inverse iteration, with
reorthogonalisation inside clusters, their vectors. Their projection goes to
the tasks with the function that applies it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .tables import materialise, written

SCALE, SHIFT = 64, 1_000_000
#: Entries are held within this size, so that every whole number fits a long.
BOUND = float(1 << 62)
#: Rows that are multiplied at once.
RUN_ROWS = 4096
#: The eigensolver works in the widest float of the machine; neighbouring eigenvalues nearer than this share are a cluster.
WIDE, CLUSTER = np.longdouble, 1e-3


def whole_numbers(vector: Column) -> Column:
    """Each entry c as floor(64 c) + 1000000."""
    whole = lambda c: F.floor(F.greatest(F.least(c.cast("double") * SCALE, F.lit(BOUND)), F.lit(-BOUND))) + F.lit(SHIFT)
    return F.transform(vector, whole)


def usable(vector: Column) -> Column:
    """Neither null nor with an entry that is null, NaN or infinite."""
    good = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    return vector.isNotNull() & F.coalesce(F.forall(vector, good), F.lit(False))


def _rows(column: pa.Array, dims: int) -> Iterator[np.ndarray]:
    flat = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
    for at in range(0, len(flat), RUN_ROWS):
        yield flat[at:at + RUN_ROWS]


def _exact(values: np.ndarray, most: int) -> np.ndarray:
    """``values`` as whole numbers of Python where sums of ``most`` could pass a long."""
    return values.astype(object) if most >= 1 << 63 else values


def _largest(values: np.ndarray) -> int:
    return max(abs(int(values.min())), abs(int(values.max()))) if values.size else 0


def _sums(dims: int):
    """Number of rows (dimension -1) and the sum of each dimension."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(dims, object)
        for batch in batches:
            for x in _rows(batch.column(0), dims):
                n += len(x)
                total += _exact(x, _largest(x) * len(x)).sum(axis=0).astype(object)
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(-1, dims), pa.int32()), pa.array([0] * (dims + 1), pa.int32()),
             pa.array([Decimal(int(v)) for v in [n, *total]], pa.decimal128(38, 0))], ["i", "j", "total"])
    return run


def _products(x: np.ndarray) -> np.ndarray:
    """Exact sums of products of the columns."""
    most = _largest(x) ** 2 * len(x)
    if most < 1 << 53:
        x = x.astype(np.float64)
        return (x.T @ x).astype(np.int64)
    x = _exact(x, most)
    return x.T @ x


def _centred_products(centre: list[int]):
    dims = len(centre)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held, bound = np.zeros((dims, dims), object), np.zeros((dims, dims), np.int64), 0
        middle = np.array(centre, object) if _largest(np.array(centre, object)) >= 1 << 62 else np.array(centre, np.int64)
        for batch in batches:
            for x in _rows(batch.column(0), dims):
                z = x.astype(object) - middle if _largest(x) >= 1 << 61 else x - middle
                g = _products(z)
                if g.dtype == object:
                    total += g
                    continue
                bound += _largest(g)
                if bound >= 1 << 62:
                    total += held.astype(object)
                    held[:], bound = 0, _largest(g)
                held += g
        total += held.astype(object)
        i, j = np.triu_indices(dims)
        yield pa.RecordBatch.from_arrays(
            [pa.array(i, pa.int32()), pa.array(j, pa.int32()),
             pa.array([Decimal(int(v)) for v in total[i, j]], pa.decimal128(38, 0))], ["i", "j", "total"])
    return run


def _added(parts: DataFrame) -> dict[tuple[int, int], int]:
    """One total for each pair of dimensions: as many as the covariance has entries."""
    return {(r.i, r.j): int(r.total) for r in parts.groupBy("i", "j").agg(F.sum("total").alias("total")).collect()}


def _wide(value: int) -> WIDE:
    high = float(value)
    return WIDE(high) + WIDE(float(value - int(high)))


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, off-diagonal and orthogonal Q of ``matrix`` = Q T Q^T, by Householder reflections."""
    a, n = matrix.copy(), len(matrix)
    q = np.eye(n, dtype=a.dtype)
    for k in range(n - 2):
        v = a[k + 1:, k].copy()
        if not v[1:].any():
            continue
        norm = np.sqrt(v @ v)
        pivot = -np.copysign(norm, v[0])
        v[0] -= pivot
        v /= np.sqrt(v @ v)
        rest = a[k + 1:, k + 1:]
        w = rest @ v
        w -= v * (v @ w)
        rest -= 2 * (np.outer(v, w) + np.outer(w, v))
        a[k + 1:, k] = a[k, k + 1:] = 0
        a[k + 1, k] = a[k, k + 1] = pivot
        q[:, k + 1:] -= 2 * np.outer(q[:, k + 1:] @ v, v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), q


def sturm_counts(diagonal: np.ndarray, off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each value of ``at`` how many eigenvalues of the tridiagonal matrix are below it."""
    least = np.finfo(diagonal.dtype).tiny
    count = np.zeros(len(at), int)
    pivot = np.ones_like(at)
    for k in range(len(diagonal)):
        square = off[k - 1] ** 2 if k else at.dtype.type(0)
        pivot = diagonal[k] - at - square / pivot
        pivot = np.where(np.abs(pivot) < least, -least, pivot)
        count += pivot < 0
    return count


def leading_eigenvalues(diagonal: np.ndarray, off: np.ndarray, count: int) -> np.ndarray:
    """The ``count`` largest, falling, each halved down to neighbouring numbers."""
    n = len(diagonal)
    around = np.concatenate([[0], np.abs(off), [0]])
    radius = around[:-1] + around[1:]
    low = np.full(count, (diagonal - radius).min())
    high = np.full(count, (diagonal + radius).max())
    pad = np.maximum(np.abs(low), np.abs(high)) * np.finfo(diagonal.dtype).eps * n
    low, high = low - pad, high + pad
    below = n - np.arange(1, count + 1)
    while True:
        mid = (low + high) / 2
        if ((mid <= low) | (mid >= high)).all():
            return mid
        over = sturm_counts(diagonal, off, mid) > below
        low, high = np.where(over, low, mid), np.where(over, mid, high)


def _solve(diagonal: np.ndarray, off: np.ndarray, shift, right: np.ndarray, least) -> np.ndarray:
    """(T - shift) y = right by elimination with row exchanges; a zero pivot counts as ``least``."""
    n = len(diagonal)
    main, up, up2, y = diagonal - shift, np.append(off, 0), np.zeros_like(diagonal), right.copy()
    for k in range(n - 1):
        below, row = off[k], (main[k + 1], up[k + 1])
        if abs(main[k]) < abs(below):
            factor = main[k] / below
            main[k], main[k + 1] = below, up[k] - factor * row[0]
            up[k], up[k + 1] = row[0], -factor * row[1]
            up2[k] = row[1]
            y[k], y[k + 1] = y[k + 1], y[k] - factor * y[k + 1]
        else:
            main[k] = main[k] if abs(main[k]) > least else least
            factor = below / main[k]
            main[k + 1] = row[0] - factor * up[k]
            y[k + 1] -= factor * y[k]
    for k in range(n - 1, -1, -1):
        after = (up[k] * y[k + 1] if k + 1 < n else 0) + (up2[k] * y[k + 2] if k + 2 < n else 0)
        y[k] = (y[k] - after) / (main[k] if abs(main[k]) > least else least)
    return y


def inverse_iteration(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors (columns) for falling ``values``; those of a cluster are kept orthogonal as they form."""
    size = np.max(np.abs(diagonal)) + (np.max(np.abs(off)) if len(off) else 0)
    least = size * np.finfo(diagonal.dtype).eps
    rng, found, first = np.random.default_rng(11), [], 0
    for k, value in enumerate(values):
        if k and values[k - 1] - value > CLUSTER * size:
            first = k
        y = rng.standard_normal(len(diagonal)).astype(diagonal.dtype)
        # of equal values each gets a shift of its own
        shift = value - least * (k - first)
        for _ in range(6):
            y = _solve(diagonal, off, shift, y / np.sqrt(y @ y), least)
            y /= np.max(np.abs(y))
            for other in found[first:] * 2:
                y -= other * (other @ y)
        found.append(y / np.sqrt(y @ y))
    return np.stack(found, axis=1)


def leading_components(matrix: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` largest eigenvalues, falling, and their unit vectors as columns, the largest entry positive."""
    diagonal, off, q = tridiagonal(matrix.astype(WIDE))
    values = leading_eigenvalues(diagonal, off, min(count, len(matrix)))
    vectors = q @ inverse_iteration(diagonal, off, values)
    vectors /= np.sqrt((vectors * vectors).sum(axis=0))
    top = vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])]
    return values, vectors * np.sign(top)


@dataclass
class Whitener:
    """Everything that a task needs: dimensions x components numbers and the sums."""

    n: int
    sums: list[int]
    projection: np.ndarray
    explained: np.ndarray

    @property
    def centre(self) -> list[int]:
        return [(2 * s + self.n) // (2 * self.n) for s in self.sums]

    def parts(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """n x - S as whole numbers, and what each row is on the components."""
        centre = self.centre
        rest = np.array([s - self.n * c for s, c in zip(self.sums, centre)], object)
        z = x.astype(object) - np.array(centre, object) if max(map(abs, centre), default=0) >= 1 << 61 or _largest(x) >= 1 << 61 \
            else x - np.array(centre, np.int64)
        far = self.n * (_largest(z) + 1)
        exact = far * far * max(1, len(self.sums)) < 1 << 63
        apart = self.n * z - rest.astype(np.int64) if exact else self.n * z.astype(object) - rest
        return apart, (apart / self.n).astype(np.float64) @ self.projection


def fit(fit_list: DataFrame, dims: int, components: int = 16) -> Whitener:
    """``fit_list`` has one column of vectors of ``dims`` whole numbers, every different one once."""
    schema = "i int, j int, total decimal(38,0)"
    sums = _added(fit_list.mapInArrow(_sums(dims), schema))
    n, s = sums.get((-1, 0), 0), [sums.get((i, 0), 0) for i in range(dims)]
    model = Whitener(n, s, np.zeros((dims, 0)), np.zeros(0))
    if not n:
        return model
    centre = model.centre
    products = _added(fit_list.mapInArrow(_centred_products(centre), schema))
    rest = [a - n * c for a, c in zip(s, centre)]
    cov = np.zeros((dims, dims), WIDE)
    square = _wide(n * n)
    for (i, j), g in products.items():
        cov[i, j] = cov[j, i] = _wide(n * g - rest[i] * rest[j]) / square
    trace = np.trace(cov)
    if not trace > 0:
        return model
    values, vectors = leading_components(cov / trace, components)
    kept = values > dims * np.finfo(np.float64).eps * values[0]
    values, vectors = values[kept], vectors[:, kept]
    model.projection = (vectors / np.sqrt(values * trace)).astype(np.float64)
    model.explained = values.astype(np.float64)
    return model


def _whitened_products(model: Whitener):
    dims, k = model.projection.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k))
        for batch in batches:
            for x in _rows(batch.column(0), dims):
                w = model.parts(x)[1]
                total += np.vstack([w.sum(axis=0), w.T @ w])
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel() - 1, pa.int32()), pa.array(j.ravel(), pa.int32()),
                                          pa.array(total.ravel())], ["i", "j", "total"])
    return run


def identity_error(fit_list: DataFrame, model: Whitener) -> float:
    """How far the covariance of the whitened fit list is from the identity, at most."""
    k = model.projection.shape[1]
    parts = fit_list.mapInArrow(_whitened_products(model), "i int, j int, total double")
    table = np.zeros((k + 1, k))
    for r in parts.groupBy("i", "j").agg(F.sum("total").alias("total")).collect():
        table[r.i + 1, r.j] = r.total
    mean = table[0] / model.n
    return float(np.abs(table[1:] / model.n - np.outer(mean, mean) - np.eye(k)).max())


def _apply(model: Whitener, error: float):
    dims, k = model.projection.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for x in _rows(batch.column(1), dims):
                apart, w = model.parts(x)
                far = [int(v) for v in (apart * apart).sum(axis=1)]
                ids = batch.column(0).slice(at, len(x)).take(pa.array(np.repeat(np.arange(len(x)), k)))
                at += len(x)
                # a deviation beyond a long is null
                deviation = pa.array([v if v < 1 << 63 else None for v in far], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(np.tile(np.arange(1, k + 1), len(x)), pa.int32()),
                     pa.array(np.full(len(x) * k, model.n), pa.int64()),
                     deviation.take(pa.array(np.repeat(np.arange(len(x)), k))), pa.array(w.ravel()),
                     pa.array(np.tile(model.explained, len(x))), pa.array(np.full(len(x) * k, error))],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])
    return run


@written("whitened")
def whiten(table: DataFrame, vector: str = "embedding", key: str = "vec_id", components: int = 16) -> DataFrame:
    """One row per usable row and component: ``key``, component, n, deviation, whitened, explained, identity_error.

    Rows go whose vector is null or holds a null, NaN or infinite entry. An
    entry c counts as x = floor(64 c) + 1000000 (held within 2^62). The fit
    list is each different x once, so repeated rows do not weigh more; they
    are whitened each. Shorter vectors count as 0 in the dimensions they
    miss. n is the size of the fit list, deviation the sum of (n x - S)^2
    (null beyond a long), whitened the projection of x - S/n on a component
    over the root of its eigenvalue, explained the eigenvalue's share of the
    variance, identity_error the largest difference between the covariance
    of the whitened fit list and the identity. Components are numbered by
    falling eigenvalue; equal ones in any order. Components without variance
    are left out, so an empty table, or one of equal vectors, gives no rows.
    Keys may be null or repeated; other columns are not read.
    """
    ship_package(table.sparkSession)
    rows = table.select(F.col(key).alias("vec_id"), F.col(vector).alias("v")).filter(usable(F.col("v")))
    dims = rows.agg(F.max(F.size("v")).alias("d")).first()["d"] or 0
    x = whole_numbers(F.col("v"))
    rows = rows.select("vec_id", F.concat(x, F.array_repeat(F.lit(SHIFT).cast("long"), F.lit(dims) - F.size("v"))).alias("x"))
    kind = table.schema[key].dataType.simpleString()
    out = (f"vec_id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, "
           "identity_error double")
    nothing = table.sparkSession.createDataFrame([], out).withColumnRenamed("vec_id", key)
    if not dims:
        return nothing
    fit_list = materialise(rows.select("x").distinct(), "fit-list")
    model = fit(fit_list, dims, components)
    if not model.projection.shape[1]:
        return nothing
    error = identity_error(fit_list, model)
    return rows.mapInArrow(_apply(model, error), out).withColumnRenamed("vec_id", key)
