"""Whitening of embeddings: covariance gathered over the cluster, leading components from a tridiagonal form, projection by broadcast.

Vectors are taken on a grid of 1/256, so sums and deviations are exact whole numbers, and equal vectors are fitted once.
The driver sees sums (d numbers), one covariance (d x d) and the components, whatever the number of rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotwise.llm import storage

_EPS = np.finfo(float).eps


@dataclass(frozen=True)
class Whitening:
    """``n`` distinct vectors with whole sums; unit ``components`` (a column each) by falling eigenvalue; their shares of the trace; the largest error of the whitened covariance."""

    n: int
    sums: tuple[int, ...]
    components: np.ndarray
    values: np.ndarray
    explained: np.ndarray
    identity_error: float = 0.0

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    @property
    def scale(self) -> np.ndarray:
        return self.components / np.sqrt(self.values)


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(diagonal, off-diagonal, reflectors) of a symmetric matrix by Householder; column k of the reflectors is the unit vector of step k."""
    a = np.array(matrix, float)
    d = len(a)
    reflectors = np.zeros((d, max(d - 2, 0)))
    for k in range(d - 2):
        x = a[k + 1 :, k].copy()
        size = np.linalg.norm(x)
        if not np.any(x[1:]):
            continue
        x[0] += size if x[0] >= 0 else -size
        x /= np.linalg.norm(x)
        reflectors[k + 1 :, k] = x
        rest = a[k + 1 :, k + 1 :]
        p = rest @ x
        p -= (x @ p) * x
        rest -= 2 * (np.outer(x, p) + np.outer(p, x))
        a[k + 1 :, k] -= 2 * x * (x @ a[k + 1 :, k])
        a[k, k + 1 :] = a[k + 1 :, k]
    return np.diag(a).copy(), np.diag(a, -1).copy(), reflectors


def sturm_count(diagonal: np.ndarray, off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many eigenvalues lie under each of ``at``: negative pivots of the shifted matrix."""
    tiny = np.finfo(float).tiny / _EPS
    pivot = diagonal[0] - at
    below = (pivot < 0).astype(int)
    for i in range(1, len(diagonal)):
        pivot = np.where(np.abs(pivot) < tiny, -tiny, pivot)
        pivot = diagonal[i] - at - off[i - 1] / pivot * off[i - 1]
        below += pivot < 0
    return below


def leading_values(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` largest eigenvalues, falling, each bisected until its interval holds no further number."""
    d = len(diagonal)
    reach = np.r_[0.0, np.abs(off)] + np.r_[np.abs(off), 0.0]
    low, high = np.full(k, (diagonal - reach).min()), np.full(k, (diagonal + reach).max())
    pad = max(abs(low[0]), abs(high[0])) * 4 * _EPS + np.finfo(float).tiny
    low, high = low - pad, high + pad
    rank = d - 1 - np.arange(k)
    while True:
        middle = low + (high - low) / 2
        if not np.any((middle > low) & (middle < high)):
            return middle
        over = sturm_count(diagonal, off, middle) <= rank
        low, high = np.where(over, middle, low), np.where(over, high, middle)


def _solver(diagonal: np.ndarray, off: np.ndarray, shift: float) -> Callable[[np.ndarray], np.ndarray]:
    """Solves (T - shift) y = b by elimination with row exchanges; a vanishing pivot becomes a tiny one."""
    d, least = len(diagonal), _EPS * max(np.abs(diagonal).max(), np.abs(off).max(initial=0.0), np.finfo(float).tiny / _EPS)
    main, upper, second = diagonal - shift, np.r_[off, 0.0], np.zeros(d)
    factors, swapped = np.zeros(d), np.zeros(d, bool)
    for i in range(d - 1):
        under = (off[i], main[i + 1], upper[i + 1])
        if abs(under[0]) > abs(main[i]):
            swapped[i] = True
            under, (main[i], upper[i], second[i]) = (main[i], upper[i], second[i]), under
        if abs(main[i]) < least:
            main[i] = least
        factors[i] = under[0] / main[i]
        main[i + 1], upper[i + 1] = under[1] - factors[i] * upper[i], under[2] - factors[i] * second[i]
    if abs(main[-1]) < least:
        main[-1] = least

    def solve(b: np.ndarray) -> np.ndarray:
        y = b.copy()
        for i in range(d - 1):
            if swapped[i]:
                y[i], y[i + 1] = y[i + 1], y[i]
            y[i + 1] -= factors[i] * y[i]
        for i in range(d - 1, -1, -1):
            y[i] = (y[i] - (upper[i] * y[i + 1] if i + 1 < d else 0) - (second[i] * y[i + 2] if i + 2 < d else 0)) / main[i]
        return y

    return solve


def tridiagonal_vectors(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray, gap: float = 1e-3) -> np.ndarray:
    """Unit eigenvectors (columns) by inverse iteration. Vectors whose values lie within ``gap`` of the matrix's norm form a cluster and are made orthogonal at every step."""
    d, rng = len(diagonal), np.random.default_rng(11)
    norm = max(np.abs(diagonal).max() + 2 * np.abs(off).max(initial=0.0), np.finfo(float).tiny)
    out = np.zeros((d, len(values)))
    first = 0
    for k, value in enumerate(values):
        if k and values[k - 1] - value > gap * norm:
            first = k
        solve = _solver(diagonal, off, value - (k - first) * 4 * _EPS * norm)
        y = rng.standard_normal(d)
        for _ in range(6):
            for _ in range(2):
                y -= out[:, first:k] @ (out[:, first:k].T @ y)
            y /= np.linalg.norm(y)
            y = solve(y)
            y /= np.abs(y).max()
        for _ in range(2):
            y -= out[:, first:k] @ (out[:, first:k].T @ y)
        out[:, k] = y / np.linalg.norm(y)
    return out


def leading_components(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(values, unit vectors in columns) of the ``k`` largest eigenvalues of a symmetric matrix, falling; the largest entry of each vector is positive."""
    size = float(np.abs(matrix).max(initial=0.0)) or 1.0
    diagonal, off, reflectors = tridiagonal(np.asarray(matrix) / size)
    values = leading_values(diagonal, off, min(k, len(diagonal)))
    vectors = tridiagonal_vectors(diagonal, off, values)
    for x in reflectors.T[::-1]:
        vectors -= 2 * np.outer(x, x @ vectors)
    vectors /= np.linalg.norm(vectors, axis=0)
    vectors *= np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])
    return values * size, vectors


def on_grid(vector: Column) -> Column:
    """Entries as doubles times 256, rounded down to whole numbers (the long's ends where they are beyond it); null if the vector is null, empty, or holds a null or non-finite entry."""
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == float("inf")))
    return F.when(vector.isNotNull() & (F.size(vector) > 0) & ~bad, F.transform(vector, lambda c: F.floor(c.cast("double") * 256).cast("long")))


def _matrix(column: pa.ListArray, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Exact sums by length of vector: upper and lower halves of the numbers are added apart."""
    found: dict[int, list] = {}
    for batch in batches:
        column = batch.column("x")
        sizes = np.diff(column.offsets.to_numpy())
        for d in np.unique(sizes):
            x = _matrix(column.filter(pa.array(sizes == d)), int(d))
            own = found.setdefault(int(d), [0, [0] * int(d)])
            own[0] += len(x)
            for i, (up, low) in enumerate(zip((x >> 32).sum(axis=0).tolist(), (x & 0xFFFFFFFF).sum(axis=0).tolist(), strict=True)):
                own[1][i] += (up << 32) + low
    for d, (n, sums) in found.items():
        yield pa.RecordBatch.from_pydict({"d": [d] * d, "i": list(range(d)), "n": [n] * d, "total": pa.array([Decimal(s) for s in sums], pa.decimal128(38, 0))}, pa.schema([("d", pa.int32()), ("i", pa.int32()), ("n", pa.int64()), ("total", pa.decimal128(38, 0))]))


def _added_products(fit: DataFrame, left: Callable[[np.ndarray], np.ndarray], d: int, k: int) -> np.ndarray:
    """Sum over all vectors of y^T y with y = left(x): one k x k partial a task, added cell by cell in Spark."""

    def partial(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for batch in batches:
            x = _matrix(batch.column("x"), d)
            for at in range(0, len(x), 4096):
                y = left(x[at : at + 4096])
                total += y.T @ y
        yield pa.RecordBatch.from_pydict({"i": np.arange(k, dtype=np.int32), "cells": list(total)}, pa.schema([("i", pa.int32()), ("cells", pa.list_(pa.float64()))]))

    cells = fit.mapInArrow(partial, "i int, cells array<double>").select("i", F.posexplode("cells").alias("j", "v"))
    out = np.zeros((k, k))
    for i, j, v in cells.filter("j >= i").groupBy("i", "j").agg(F.sum("v")).toLocalIterator():
        out[i, j] = out[j, i] = v
    return out


def fit_whitening(vectors: DataFrame, vector_col: str = "embedding", components: int = 4) -> Whitening | None:
    """Fit on the distinct grid vectors of the table; None without any.

    Rows that ``on_grid`` finds null are left out. Vectors of another length than most of the distinct ones have (ties: the shorter) are left out too. Directions without
    variance (beyond rounding) are no components, so equal or few vectors give fewer, perhaps none. Repeated vectors, however many, count once: they meet in a
    partial aggregation before the shuffle. The distinct vectors are written to the shared folder, as three passes read them: exact sums, products of centred vectors, and the check.
    """
    spark = vectors.sparkSession
    folder = f"{storage.shared_folder(spark)}/whitening-{uuid.uuid4().hex}"
    vectors.select(on_grid(F.col(vector_col)).alias("x")).filter("x is not null").distinct().write.parquet(folder)
    fit = spark.read.parquet(folder)
    totals = fit.mapInArrow(_sums, "d int, i int, n long, total decimal(38,0)").groupBy("d", "i").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    by_size = totals.groupBy("d").agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("i", "total"))).alias("totals"))
    found = by_size.orderBy(F.desc("n"), "d").first()
    if found is None:
        return None
    d, n, sums = found.d, found.n, tuple(int(t.total) for t in found.totals)
    mean = np.array([s / n for s in sums])
    fit = fit.filter(F.size("x") == d)
    covariance = _added_products(fit, lambda x: x - mean, d, d) / n
    trace = float(np.trace(covariance))
    values, axes = leading_components(covariance, components)
    some = values > d * 4 * _EPS * trace
    model = Whitening(n, sums, axes[:, some], values[some], values[some] / trace if trace else values[some])
    k = int(some.sum())
    if not k:
        return model
    scale = model.scale
    error = np.abs(_added_products(fit, lambda x: (x - mean) @ scale, d, k) / n - np.eye(k)).max()
    return Whitening(n, sums, model.components, model.values, model.explained, float(error))


def _deviations(x: np.ndarray, n: int, sums: tuple[int, ...]) -> list[int | None]:
    """Exact sum of (n x - S)^2 of each row; null where no long holds it."""
    most = float(np.abs(x).max(initial=0)) * n + max(map(abs, sums))
    if most**2 * x.shape[1] < 2**62:
        return ((x * n - np.array(sums, np.int64)) ** 2).sum(axis=1).tolist()
    exact = [sum((n * v - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x.tolist()]
    return [v if v < 2**63 else None for v in exact]


def whiten(vectors: DataFrame, model: Whitening | None, vector_col: str = "embedding") -> DataFrame:
    """Rows of the fitted length with ``deviation`` (exact sum of (n x - S)^2, null beyond a long) and ``whitened`` (a number a component), narrow and without a shuffle.

    Rows whose vector is null, empty, of another length, or holds a null or non-finite entry go; without a model all do. Other columns pass through; columns named
    ``deviation`` or ``whitened`` are replaced. Repeated rows and null ids stay as they are.
    """
    d = len(model.sums) if model else -1
    sums, n = (model.sums, model.n) if model else ((), 0)
    mean, scale = (model.mean, model.scale) if model else (np.zeros(0), np.zeros((0, 0)))

    @F.arrow_udf(returnType="struct<deviation bigint, whitened array<double>>")
    def project(column: pa.Array) -> pa.Array:
        x = _matrix(column, d)
        y = np.concatenate([(x[at : at + 4096] - mean) @ scale for at in range(0, len(x), 4096)]) if len(x) else np.zeros((0, scale.shape[1]))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1, dtype=np.int32) * y.shape[1]), pa.array(y.reshape(-1)))
        return pa.StructArray.from_arrays([pa.array(_deviations(x, n, sums), pa.int64()), lists], ["deviation", "whitened"])

    names = [c for c in vectors.columns if c not in ("deviation", "whitened")]
    rows = vectors.select(F.struct(*names).alias("row"), on_grid(F.col(vector_col)).alias("x")).filter(F.size("x") == d)
    return rows.select("row", project("x").alias("p")).select(*[F.col(f"row.`{c}`").alias(c) for c in names], "p.deviation", "p.whitened")
