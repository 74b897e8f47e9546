"""Embedding whitening: principal components of a covariance by FEAST contour integration, and rows projected on them.

Sums and products are taken by Spark over the distinct vectors as whole numbers, about a centre, so the covariance is exact until it is rounded once per entry. What reaches the
driver is that matrix of dimensions by dimensions. Of it FEAST takes the largest eigenvalues, interval by interval: quadrature of complex shifted solves along a circle
projects on the interval's eigenvectors, Rayleigh-Ritz extracts them, and inertia counts (signs of the factors of the shifted matrix) say how many there must be.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from tidemark.llm.shared import cut, small_batches
from tidemark.llm.vectors import matrix

SCALE, OFFSET = 64, 1_000_000
#: Beyond this a double holds no unit; larger ones stand as it.
LARGEST = float(1 << 53)
#: Share of the total variance under which a component is rounding noise and is left out.
NOISE = 1e-10
#: Vectors of a task that sums, at least, beside which the matrix that it sends is small.
TASK_ROWS = 8_192
#: Quadrature points on half a circle, eigenvalues of an interval, rounds of a contour.
POINTS, PER_CONTOUR, ROUNDS = 8, 8, 40


# Eigenpairs of one symmetric matrix


def tridiagonal(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and next diagonal of a matrix with the same inertia under every shift, by Householder reflections."""
    a = v.copy()
    for i in range(len(a) - 2):
        x = a[i + 1 :, i].copy()
        x[0] += math.copysign(float(np.linalg.norm(x)), x[0])
        size = float(np.linalg.norm(x))
        if size > 0:
            u = x / size
            a[i + 1 :, i:] -= 2 * np.outer(u, u @ a[i + 1 :, i:])
            a[i:, i + 1 :] -= 2 * np.outer(a[i:, i + 1 :] @ u, u)
    return np.diag(a).copy(), np.diag(a, 1).copy()


def count_above(t: tuple[np.ndarray, np.ndarray], shift: float) -> int:
    """How many eigenvalues lie above ``shift``: positive factors D of T - shift I = L D L' (Sylvester)."""
    diagonal, beside = t
    tiny = np.finfo(float).tiny
    positive, q = 0, 1.0
    for i, a in enumerate(diagonal):
        q = a - shift - (beside[i - 1] ** 2 / q if i else 0.0)
        q = q if q else -tiny
        positive += q > 0
    return positive


def _contour(v: np.ndarray, lo: float, hi: float, count: int, scale: float, rng: np.random.Generator) -> np.ndarray:
    """The eigenvectors of the ``count`` eigenvalues in (lo, hi]."""
    d = len(v)
    m = min(d, max(count + 6, count * 3 // 2 + 2))
    y = np.linalg.qr(rng.standard_normal((d, m)))[0]
    nodes, weights = np.polynomial.legendre.leggauss(POINTS)
    middle, radius = (lo + hi) / 2, (hi - lo) / 2
    turn = radius * np.exp(0.5j * np.pi * (nodes + 1))
    inverses = [np.linalg.inv((middle + z) * np.eye(d) - v) for z in turn]
    best, found = np.inf, None
    for _ in range(ROUNDS):
        projected = sum(0.5 * w * (z * (r @ y)).real for w, z, r in zip(weights, turn, inverses))
        q = np.linalg.qr(projected)[0]
        values, small = np.linalg.eigh(q.T @ v @ q)
        y = q @ small
        inside = np.flatnonzero((values > lo) & (values <= hi))
        if len(inside) < count:
            continue
        # What the subspace has beside the eigenvectors can have a value in the interval too; its residual does not vanish.
        off = np.linalg.norm(v @ y[:, inside] - y[:, inside] * values[inside], axis=0) / scale
        first = np.argsort(off)[:count]
        worst = float(off[first].max())
        settled = best < 1e-12 and worst > best / 2
        if worst < best:
            best, found = worst, y[:, inside[first]]
        if settled or best < 1e-15:
            break
    if found is None or best > 1e-9:
        raise ArithmeticError(f"{count} eigenvalues in ({lo}, {hi}] were not all found")
    return found


def feast(v: np.ndarray, k: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues, falling, and their unit eigenvectors (columns); of a matrix with fewer above ``NOISE`` of its trace, those."""
    trace = float(np.trace(v))
    scale = float(np.abs(v).sum(axis=1).max(initial=0.0))
    t = tridiagonal(v)
    k = min(k, count_above(t, trace * NOISE)) if scale > 0 else 0
    if not k:
        return np.empty(0), np.empty((len(v), 0))
    # The least interval up to the matrix's norm that holds k, or what ties with the k-th.
    lo, above = trace * NOISE, scale * (1 + 1e-9)
    low_end, high_end = lo, above
    while count_above(t, low_end) != k and high_end - low_end > 1e-11 * scale:
        middle = (low_end + high_end) / 2
        low_end, high_end = (middle, high_end) if count_above(t, middle) >= k else (low_end, middle)
    todo, vectors, rng = [(low_end, above)], [], np.random.default_rng(seed)
    while todo:
        lo, hi = todo.pop()
        count = count_above(t, lo) - count_above(t, hi)
        if not count:
            continue
        if count > PER_CONTOUR and hi - lo > 1e-8 * scale:
            # Not where an eigenvalue is so near that rounding decides its side.
            clear = lambda m: count_above(t, m - 1e-10 * scale) == count_above(t, m + 1e-10 * scale)
            middle = next((m for m in lo + (hi - lo) * np.array([0.5, 0.45, 0.55, 0.4, 0.6, 0.35, 0.65]) if clear(m)), None)
            if middle is not None:
                todo += [(lo, float(middle)), (float(middle), hi)]
                continue
        vectors.append(_contour(v, lo, hi, count, scale, rng))
    # Vectors of different contours are made orthogonal to the last digit as well.
    q = np.linalg.qr(np.concatenate(vectors, axis=1))[0]
    values, small = np.linalg.eigh(q.T @ v @ q)
    order = np.argsort(-values, kind="stable")[:k]
    return values[order], q @ small[:, order]


# Over all rows


@dataclass
class Model:
    """What rows are whitened by. ``centre`` is near ``sums`` / n, ``rest`` = sums - n centre; all three are whole numbers."""

    d: int
    n: int
    sums: list[int]
    centre: list[int]
    rest: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float = 0.0

    @property
    def explained(self) -> list[float]:
        return [float(e) / self.trace for e in self.values]

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """(rows, components) of whole numbers: what is left beside the mean, projected, over the component's spread."""
        y = (x - np.array(self.centre, np.int64)).astype(float) - np.array([r / max(1, self.n) for r in self.rest])
        return (y @ self.vectors) / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """Sums of (n x - sums)^2, exact; what a long can't hold stands as the largest."""
        y = x - np.array(self.centre, np.int64)
        if (int(np.abs(y).max(initial=0)) * self.n + max(map(abs, self.rest), default=0)) ** 2 * max(1, self.d) < 1 << 63:
            z = self.n * y - np.array(self.rest, np.int64)
            return (z * z).sum(axis=1)
        z = self.n * y.astype(object) - np.array(self.rest, object)
        return np.array([min(int(s), (1 << 63) - 1) for s in (z * z).sum(axis=1)], np.int64)


def scaled(rows: DataFrame, vector_col: str) -> tuple[DataFrame, int]:
    """Rows with a vector of finite numbers, it as whole numbers ``x``, shorter ones as if zeros followed; and the number of dimensions."""
    v = F.col(vector_col).cast("array<double>")
    rows = rows.filter(F.coalesce(F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False)))
    d = rows.agg(F.max(F.size(vector_col))).first()[0] or 0
    x = F.transform(v, lambda c: F.floor(F.least(F.greatest(SCALE * c, F.lit(-LARGEST)), F.lit(LARGEST))) + OFFSET)
    return rows.withColumn("x", F.concat(x, F.array_repeat(F.lit(OFFSET).cast("bigint"), F.lit(d) - F.size(vector_col)))), d


def _products(y: np.ndarray) -> np.ndarray:
    """y' y of whole numbers, exact, as Python's numbers: by floats or 64 bits where those hold it."""
    most = int(np.abs(y).max(initial=0)) ** 2 * len(y)
    if most < 1 << 53:
        f = y.astype(float)
        return (f.T @ f).astype(np.int64).astype(object)
    if most < 1 << 62:
        return (y.T @ y).astype(object)
    o = y.astype(object)
    return o.T @ o


def _summed(fit_list: DataFrame, d: int, kind: str, of) -> dict[tuple[int, int], int | float]:
    """{(i, j): sum} of the matrices that ``of`` makes of each batch's vectors: summed by task, then by entry, so at most one row an entry comes back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                m = of(matrix(batch.column(0), d))
                total = m if total is None else total + m
        if total is not None:
            i, j = (x.ravel() for x in np.indices(total.shape))
            v = pa.array([Decimal(int(x)) for x in total.ravel()], pa.decimal128(38, 0)) if kind.startswith("decimal") else pa.array(total.ravel(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), v], names=["i", "j", "v"])

    rows = fit_list.mapInArrow(run, f"i int, j int, v {kind}").groupBy("i", "j").agg(F.sum("v").alias("v")).toArrow()
    return {(i, j): (int(v) if kind.startswith("decimal") else v) for i, j, v in zip(*(rows.column(c).to_pylist() for c in range(3)))}


def fit(x_rows: DataFrame, d: int, components: int) -> Model:
    """The model over the distinct vectors among ``x_rows`` (x)."""
    fit_list = cut(x_rows.select("x").distinct())
    n = fit_list.count()
    fit_list = fit_list.coalesce(max(1, n // TASK_ROWS))
    if not n or not d:
        return Model(d, n, [OFFSET * n] * d, [OFFSET] * d, [0] * d, np.empty(0), np.empty((d, 0)), 0.0)
    sums = [0] * d
    for (_, j), s in _summed(fit_list, d, "decimal(38,0)", lambda x: x.astype(object).sum(axis=0, keepdims=True) if np.abs(x).max(initial=0) > 1 << 40 else x.sum(axis=0, keepdims=True).astype(object)).items():
        sums[j] = s
    centre = [s // n for s in sums]
    rest = [s - n * c for s, c in zip(sums, centre)]
    about = np.array(centre, np.int64)
    g = _summed(fit_list, d, "decimal(38,0)", lambda x: _products(x - about))
    # Whole numbers divided once.
    v = np.array([[(n * g[i, j] - rest[i] * rest[j]) / (n * n) for j in range(d)] for i in range(d)])
    values, vectors = feast(v, components)
    model = Model(d, n, sums, centre, rest, values, vectors, float(np.trace(v)))
    if len(values):
        means = _summed(fit_list, d, "double", lambda x: model.whitened(x).sum(axis=0, keepdims=True))
        mean = np.array([means[0, j] / n for j in range(len(values))])

        def squares(x: np.ndarray) -> np.ndarray:
            w = model.whitened(x) - mean
            return w.T @ w

        found = _summed(fit_list, d, "double", squares)
        model.identity_error = max(abs(s / n - (i == j)) for (i, j), s in found.items())
    return model


def whiten(rows: DataFrame, *, components: int = 16, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, Model]:
    """(vec_id, deviation, whitened array<double>) of every row with a vector, and the model.

    Each entry c becomes floor(64 c) + 1,000,000. Equal vectors count once in the model; every row is projected. A vector that is null or holds null or non-finite entries leaves no
    row; shorter ones count as if zeros followed; entries beyond 2^53 / 64 stand as that. A null id stays null, repeated rows each have a row, other columns are ignored. ``deviation``
    is the sum over dimensions of (n x - sum)^2; what passes a long stands as the largest. Components of under 1e-10 of the total variance are rounding noise and left out, so vectors that are all alike
    have none and an empty array. Of equal variances any basis is taken, the same for all rows. An empty table gives no rows.
    """
    small_batches(rows.sparkSession)
    kept, d = scaled(rows.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("v")), "v")
    kept = kept.select("vec_id", "x")
    model = fit(kept, d, components)
    schema = StructType([kept.schema["vec_id"], StructField("deviation", LongType()), StructField("whitened", ArrayType(DoubleType()))])
    spread = rows.sparkSession.sparkContext.broadcast(model)  # d times components numbers

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, m = matrix(batch.column(1), d), spread.value
                w = m.whitened(x)
                offsets = np.arange(len(x) + 1, dtype=np.int32) * w.shape[1]
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(w.ravel(), pa.float64()))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(m.deviations(x), pa.int64()), lists], names=schema.fieldNames())

    return kept.mapInArrow(project, schema), model
