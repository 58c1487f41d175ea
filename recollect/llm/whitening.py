"""Embedding whitening by spectrum slicing: inertia counts isolate eigenvalues, Rayleigh quotient iteration finds them, counts certify their numbers.

A component c becomes the integer x = floor(scale * c) + offset. The fit list holds each distinct x vector once, so that copies do not pull the axes
about; S are its sums per dimension, n its length. The covariance (over the fit list, divisor n) is
summed by the tasks as integers around the rounded mean and divided once at the end, so each of its entries is the exact value rounded to
a double, however many rows there are. Only sums per pair of dimensions reach the driver, never rows.

On the driver, for the matrix V of dimension x dimension: the signs of the pivots of an LDL^T factorisation of V - s tell how many eigenvalues
lie above s (Sylvester). Counts at bisected shifts isolate the k-th largest eigenvalue; from there Rayleigh quotient iteration
converges cubically, and two more counts on both sides of the value found certify that it is the k-th. Eigenvalues that no shift tells apart
in double precision share an interval and get an orthonormal basis of their space.

Every row, copies included, is projected: whitened_k = (x - S/n) . v_k / sqrt(e_k). Components whose eigenvalue is nothing but rounding are left
out, so equal vectors or a single one give no rows, and so does an empty table. Rows that are left out, large components and null ids:
:func:`recollect.llm.vectors.integer_vectors`. ``deviation`` is null if it does not fit a long. Repeated rows are all returned. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.llm.common import saved
from recollect.llm.vectors import integer_vectors, matrix

COMPONENTS = 16
SCALE = 64
OFFSET = 1_000_000
EPS = float(np.finfo(float).eps)
GROWTH = (1 + 17**0.5) / 8  # of Bunch and Parlett: when a 1x1 pivot is safe


def count_above(a: np.ndarray, shift: float) -> int:
    """How many eigenvalues of the symmetric matrix are above the shift: the positive pivots of LDL^T with complete pivoting."""
    m = a - shift * np.eye(len(a))
    above = 0
    while len(m):
        off = np.abs(np.tril(m, -1))
        i, j = np.unravel_index(off.argmax(), off.shape)
        d = np.abs(np.diagonal(m)).argmax()
        if abs(m[d, d]) >= GROWTH * off[i, j]:
            if m[d, d] == 0:
                return above  # what is left is zero
            above += int(m[d, d] > 0)
            pivot = [int(d)]
        else:
            above += 1  # a 2x2 pivot has one eigenvalue on either side
            pivot = [int(i), int(j)]
        rest = np.delete(np.arange(len(m)), pivot)
        column = m[np.ix_(rest, pivot)]
        m = m[np.ix_(rest, rest)] - column @ np.linalg.solve(m[np.ix_(pivot, pivot)], column.T)
        m = (m + m.T) / 2
    return above


def solved(a: np.ndarray, shift: float, x: np.ndarray, size: float) -> np.ndarray:
    """Directions of (a - shift)^-1 x, with columns of length 1; a shift on an eigenvalue is moved by a rounding error."""
    for step in range(8):
        try:
            y = np.linalg.solve(a - (shift + step * EPS * size) * np.eye(len(a)), x)
        except np.linalg.LinAlgError:
            continue
        if np.isfinite(y).all():
            return y / np.linalg.norm(y, axis=0)
    return x


@dataclass
class Spectrum:
    """Eigenvalues, falling, with unit eigenvectors as columns; ``counts`` says how many are above the lower and the upper end of each one's bracket."""

    values: np.ndarray
    vectors: np.ndarray
    counts: list[tuple[int, int]]


def leading_spectrum(a: np.ndarray, components: int) -> Spectrum:
    """The leading eigenpairs of a symmetric positive semidefinite matrix by slicing its spectrum."""
    size = float(np.abs(a).sum(axis=1).max(initial=0.0))
    tiny = 16 * EPS * size  # what a shift can tell apart
    floor = len(a) * tiny
    values: list[float] = []
    vectors: list[np.ndarray] = []
    counts: list[tuple[int, int]] = []
    known = {size * (1 + 4 * EPS): 0, floor: count_above(a, floor) if size else 0}
    wanted = min(components, known[floor])
    rng = np.random.default_rng(1)
    while len(values) < wanted:
        k = len(values) + 1
        high = min(s for s, c in known.items() if c < k)
        low = max(s for s, c in known.items() if c >= k)
        while True:
            alone = known[low] == k and known[high] == k - 1
            if alone:
                found = quotient(a, low, high, rng, size)
                if found is not None:
                    value, x = found
                    if vectors:
                        basis = np.stack(vectors, 1)
                        x = x - basis @ (basis.T @ x)
                        x /= np.linalg.norm(x)
                    below, top = max(low, value - tiny), min(high, value + tiny)
                    counts.append((count_above(a, below), count_above(a, top)))
                    values.append(value)
                    vectors.append(x)
                    break
            if high - low <= tiny:  # eigenvalues that are equal in double precision
                m = known[low] - len(values)
                x = rng.standard_normal((len(a), m))
                for _ in range(4):
                    x = solved(a, low, x, size)
                    if vectors:
                        basis = np.stack(vectors, 1)
                        x = x - basis @ (basis.T @ x)
                    x = np.linalg.qr(x)[0]
                for column in x.T[: wanted - len(values)]:
                    values.append(float(column @ a @ column))
                    vectors.append(column)
                    counts.append((known[low], known[high]))
                break
            middle = (low + high) / 2
            known[middle] = count_above(a, middle)
            low, high = (middle, high) if known[middle] >= k else (low, middle)
    return Spectrum(np.array(values), np.stack(vectors, 1) if vectors else np.zeros((len(a), 0)), counts)


def quotient(a: np.ndarray, low: float, high: float, rng: np.random.Generator, size: float) -> tuple[float, np.ndarray] | None:
    """Rayleigh quotient iteration for the one eigenvalue in the interval; none if it leaves the interval or does not settle."""
    x = solved(a, (low + high) / 2, rng.standard_normal((len(a), 1)), size)
    x = solved(a, (low + high) / 2, x, size)
    value, last = float((x.T @ a @ x)[0, 0]), np.inf
    for _ in range(12):
        if not low < value < high:
            return None
        residual = float(np.linalg.norm(a @ x - value * x))
        if residual <= 4 * EPS * size or (residual < 1e3 * EPS * size and residual >= last / 2):
            return value, x[:, 0]
        last = residual
        x = solved(a, value, x, size)
        value = float((x.T @ a @ x)[0, 0])
    return None


def sums_around(fit: DataFrame, centre: np.ndarray) -> tuple[int, list[int], list[list[int]]]:
    """n, the sums of x - centre, and the sums of their products per pair of dimensions, all exact."""
    d = len(centre)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, first, second = 0, np.zeros(d, object), np.zeros((d, d), object)
        for batch in batches:
            x = matrix(batch.column(0)) - centre if batch.num_rows else np.zeros((0, d), np.int64)
            n += len(x)
            at = 0
            while at < len(x):
                most = max(int(np.abs(x[at : at + 4096]).max()), 1)
                rows = max(1, min(4096, 2**53 // most**2))  # so many products add up exactly in doubles
                if rows >= 64:
                    part = x[at : at + rows].astype(float)
                    gram = (part.T @ part).astype(np.int64)
                else:
                    rows = max(1, min(4096, 2**62 // most**2))
                    part = x[at : at + rows]
                    gram = part.T @ part
                first = first + x[at : at + rows].sum(axis=0).astype(object)
                second = second + gram.astype(object)
                at += rows
        cells = [(-1, -1, n), *((i, -1, v) for i, v in enumerate(first)), *((i, j, second[i, j]) for i in range(d) for j in range(i + 1))]
        yield pa.RecordBatch.from_arrays([pa.array([c[0] for c in cells], pa.int32()), pa.array([c[1] for c in cells], pa.int32()), pa.array([str(c[2]) for c in cells])], names=["i", "j", "s"])

    table = fit.mapInArrow(run, "i int, j int, s string").groupBy("i", "j").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    n, first, second = 0, [0] * d, [[0] * d for _ in range(d)]
    for i, j, s in table.collect():  # at most one row per pair of dimensions
        if i < 0:
            n = int(s)
        elif j < 0:
            first[i] = int(s)
        else:
            second[i][j] = second[j][i] = int(s)
    return n, first, second


@dataclass
class Whitening:
    """n and ``rest``, the exact sums of x - centre; ``axes``: unit eigenvectors over sqrt(eigenvalue), as columns."""

    n: int
    centre: np.ndarray
    rest: list[int]
    axes: np.ndarray
    explained: np.ndarray
    spectrum: Spectrum

    def project(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.centre) - np.array([r / self.n for r in self.rest])) @ self.axes

    def deviations(self, x: np.ndarray) -> list[int]:
        """Sum over dimensions of (n * x - S)^2: exact, whatever its size."""
        apart = x - self.centre
        most = self.n * int(np.abs(apart).max(initial=0)) + max(map(abs, self.rest), default=0)
        kind = np.int64 if most * most * max(len(self.rest), 1) < 2**63 else object
        return ((apart.astype(kind) * self.n - np.array(self.rest, kind)) ** 2).sum(axis=1).tolist()


def fitted(fit: DataFrame, components: int) -> Whitening | None:
    """The whitening of a fit list (x: arrays of one length); none for an empty list."""
    first = fit.first()
    if first is None:
        return None
    d = len(first["x"])
    # Sums per dimension, combined in the tasks; then once more around the rounded mean.
    start = np.array(first["x"], np.int64)
    n, moved, _ = sums_around(fit, start)
    centre = start + np.array([round(m / n) for m in moved], np.int64)
    _, rest, products = sums_around(fit, centre)
    v = np.array([[(n * products[i][j] - rest[i] * rest[j]) / n**2 for j in range(d)] for i in range(d)])
    spectrum = leading_spectrum(v, components)
    return Whitening(n, centre, rest, spectrum.vectors / np.sqrt(spectrum.values), spectrum.values / np.trace(v) if len(spectrum.values) else spectrum.values, spectrum)


def identity_error(fit: DataFrame, model: Whitening) -> float:
    """The largest absolute entry of the covariance of the whitened fit list minus the identity, from sums over all of it."""
    k = model.axes.shape[1]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k + 1))
        for batch in batches:
            if batch.num_rows:
                w = model.project(matrix(batch.column(0)))
                total[:, :k] += w.T @ w
                total[:, k] += w.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["place", "s"])

    total = np.zeros((k, k + 1))
    for place, s in fit.mapInArrow(run, "place long, s double").groupBy("place").agg(F.sum("s")).collect():  # components^2 rows
        total.ravel()[place] = s
    mean = total[:, k] / model.n
    return float(np.abs(total[:, :k] / model.n - np.outer(mean, mean) - np.eye(k)).max(initial=0.0))


def whitened(vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row per usable row of vectors (vec_id, embedding, label) and component."""
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = integer_vectors(vectors, scale, offset).select(F.col("vec_id").cast("long"), "x")
    fit = saved(rows.select("x").distinct(), "whitening-fit")
    model = fitted(fit, components)
    if model is None or not model.axes.shape[1]:
        return vectors.sparkSession.createDataFrame([], schema)
    k, n, explained, error = model.axes.shape[1], model.n, model.explained, identity_error(fit, model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 2048):
                part = batch.slice(begin, 2048)
                x = matrix(part.column(1))
                m = len(x)
                own = np.repeat(np.arange(m), k)
                deviation = pa.array([v if v < 2**63 else None for v in model.deviations(x)], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(own)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)), deviation.take(pa.array(own)), pa.array(model.project(x).ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error))],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.mapInArrow(run, schema)
