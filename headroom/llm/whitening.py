"""Embedding whitening: leading components of the covariance by FEAST contour integration.

Entries become whole numbers, floor(256 * c). The fit list holds every distinct vector once; its
sums, its covariance and the covariance of the whitened values are added up by Spark tasks over
all of it. Only the covariance, whose size is the square of the dimension, comes to the driver.

There, counts of positive pivots (Sylvester's law of inertia) of shifted LDL^T factors place an
interval around the wanted eigenvalues. Quadrature of (zI - V)^-1 Y over a circle around that
interval projects a few vectors onto its eigenvectors, Rayleigh-Ritz extracts these, and both
steps are repeated until residuals vanish and as many eigenvalues lie in the interval as the
inertia counts say, so that none is missed.

Vectors that are null or hold null or non-finite entries take no part. Vectors of different
length are fitted apart, each length with its own n. Repeated rows and ids are kept, a null id too;
other columns are ignored. Entries beyond 2**63 / 256 count as the nearest long. A component without
variance (rank below ``k``, one distinct vector) has explained 0 and whitened null; explained
is null if nothing varies at all. A vector of length d has at most d components, an empty one no
row. A deviation that no long can hold is null. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headroom.llm.arrow import narrow
from headroom.sources.shared import cut_lineage

K = 4
SCALE = 256.0
#: Quadrature points on the upper half of the circle.
NODES = 12
#: Rounds of projection and extraction before the subspace is doubled.
ROUNDS = 12
#: Residual, as a share of the largest eigenvalue, at which a component counts as found.
RESIDUAL = 1e-14
#: Whole numbers up to here are computed in 64-bit integers, larger ones in Python's.
SAFE = 2.0**62


def whole_vectors(embeddings: DataFrame) -> DataFrame:
    """vec_id, x (array of longs) of the rows that take part."""
    rows = narrow(embeddings, vec_id="long", embedding="array<double>").where(F.col("embedding").isNotNull())
    finite = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return rows.where(finite).select("vec_id", F.transform("embedding", lambda c: F.floor(c * F.lit(SCALE))).alias("x"))


def by_length(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """length, row numbers and matrix of all vectors of a batch that have this length."""
    sizes = pa.compute.list_value_length(column).to_numpy(zero_copy_only=False)
    flat, at = pa.compute.list_flatten(column).to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(sizes)])
    for size in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == size)
        yield size, rows, flat[at[rows][:, None] + np.arange(size)]


def largest(data: np.ndarray) -> float:
    return float(np.abs(data.astype(np.float64)).max(initial=0.0))


def exact_sums(fit: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """length -> (n, S): how many distinct vectors and their exact sum in each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for size, rows, data in by_length(batch.column("x")):
                data = data if largest(data) * len(rows) < SAFE else data.astype(object)
                totals = pa.array([Decimal(int(t)) for t in data.sum(axis=0)], pa.decimal128(38, 0))
                length, n = np.full(size, size, np.int32), np.full(size, len(rows), np.int64)
                place = np.arange(size, dtype=np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(length), pa.array(place), pa.array(n), totals], ["size", "place", "n", "total"])

    parts = fit.mapInArrow(run, "size int, place int, n long, total decimal(38,0)")
    found: dict[int, tuple[int, list[int]]] = {}
    for row in parts.groupBy("size", "place").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).orderBy("size", "place").collect():
        found.setdefault(row["size"], (row["n"], []))[1].append(int(row["total"]))
    return found


def mean_of(n: int, sums: list[int]) -> np.ndarray:
    return np.array([s / n for s in sums])


def covariances(fit: DataFrame, sums: dict[int, tuple[int, list[int]]]) -> dict[int, np.ndarray]:
    """length -> covariance; rows are centred before they are multiplied, one triangle a task is added up."""
    means = {size: mean_of(*found) for size, found in sums.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for size, _, data in by_length(batch.column("x")):
                if size:
                    centred = data - means[size]
                    total[size] = total.get(size, 0.0) + centred.T @ centred
        for size, square in total.items():
            i, j = (a.astype(np.int32) for a in np.triu_indices(size))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), size, np.int32)), pa.array(i), pa.array(j), pa.array(square[i, j])], ["size", "i", "j", "value"])

    added = fit.mapInArrow(run, "size int, i int, j int, value double").groupBy("size", "i", "j").agg(F.sum("value").alias("value")).toArrow()
    size, i, j, value = (added[c].to_numpy() for c in ("size", "i", "j", "value"))
    out = {}
    for d in sums:
        own = size == d
        out[d] = np.zeros((d, d))
        out[d][i[own], j[own]] = out[d][j[own], i[own]] = value[own] / sums[d][0]
    return out


def eigenvalues_above(matrix: np.ndarray, shift: float) -> int:
    """How many eigenvalues exceed ``shift``: positive pivots of LDL^T of the shifted matrix.

    Pivots of one or two rows are chosen as Bunch and Kaufman do; a pair has one eigenvalue of each sign.
    """
    a = matrix - shift * np.eye(len(matrix))
    bound = (1 + np.sqrt(17)) / 8
    found = at = 0

    def swap(p: int, q: int) -> None:
        a[[p, q]] = a[[q, p]]
        a[:, [p, q]] = a[:, [q, p]]

    while at < len(a):
        column, width = np.abs(a[at + 1 :, at]), 1
        if len(column) and abs(a[at, at]) < bound * (most := column.max()):
            other = at + 1 + int(column.argmax())
            row = np.abs(a[other, at:])
            row[other - at] = 0
            if abs(a[at, at]) < bound * most * (most / row.max()):
                if abs(a[other, other]) >= bound * row.max():
                    swap(at, other)
                else:
                    swap(at + 1, other)
                    width = 2
        pivot, left = a[at : at + width, at : at + width], a[at + width :, at : at + width].copy()
        found += 1 if width == 2 else int(pivot[0, 0] > 0)
        if width == 2 or pivot[0, 0] != 0:
            a[at + width :, at + width :] -= left @ np.linalg.solve(pivot, left.T)
        at += width
    return found


def interval(matrix: np.ndarray, k: int) -> tuple[float, float, int]:
    """(low, high, count): the k largest eigenvalues and others as near as the k-th, with a gap below them."""
    span = float(np.sqrt((matrix**2).sum()))
    high, low = span * 1.01, -span * 0.01

    def bisect(low: float, high: float, least: int, steps: int) -> tuple[float, float]:
        for _ in range(steps):
            middle = (low + high) / 2
            if eigenvalues_above(matrix, middle) >= least:
                low = middle
            else:
                high = middle
        return low, high

    top = bisect(low, high, 1, 12)[1]
    edge = bisect(low, top, k, 40)[0]
    count = eigenvalues_above(matrix, edge)
    below = bisect(low, edge, count + 1, 20)[1] if count < len(matrix) else low
    return (below + edge) / 2, top, count


def projected(matrix: np.ndarray, vectors: np.ndarray, low: float, high: float) -> np.ndarray:
    """Gauss-Legendre quadrature of (zI - matrix)^-1 vectors around [low, high]: its spectral projector."""
    centre, radius = (low + high) / 2, (high - low) / 2
    points, weights = np.polynomial.legendre.leggauss(NODES)
    total = np.zeros_like(vectors)
    for turn, weight in zip(np.exp(0.5j * np.pi * (1 + points)), weights, strict=True):
        solved = np.linalg.solve((centre + radius * turn) * np.eye(len(matrix)) - matrix, vectors.astype(complex))
        total += weight * (turn * solved).real
    return total * radius / 2


def leading(matrix: np.ndarray, k: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues, falling, and their unit eigenvectors as columns; entry of largest size positive."""
    d = len(matrix)
    k = min(k, d)
    if not k or not matrix.any():
        return np.zeros(k), np.eye(d)[:, :k]
    size = float(np.abs(matrix).max())
    matrix = matrix / size
    low, high, count = interval(matrix, k)
    width = min(d, count + max(8, count))
    start = np.random.default_rng(seed).standard_normal((d, d))
    vectors = start[:, :width]
    while True:
        for _ in range(ROUNDS):
            basis = np.linalg.qr(projected(matrix, vectors, low, high) if width < d else vectors)[0]
            values, turn = np.linalg.eigh(basis.T @ matrix @ basis)
            vectors = basis @ turn
            inside = values > low
            off = np.abs(matrix @ vectors - vectors * values)[:, inside].max(initial=0.0)
            if inside.sum() == count and (off <= RESIDUAL * high * np.sqrt(d) or width == d):
                order = np.argsort(-values)[:k]
                values, vectors = values[order], vectors[:, order]
                vectors = vectors * np.where(np.take_along_axis(vectors, np.abs(vectors).argmax(axis=0)[None], 0) < 0, -1, 1)
                return values * size, vectors
            if width == d:
                break
        if width == d:
            raise ArithmeticError(f"{count} eigenvalues expected by inertia, {int(inside.sum())} found")
        width = min(d, 2 * width)
        vectors = np.concatenate([vectors, start[:, vectors.shape[1] : width]], axis=1)


@dataclass(frozen=True)
class Fit:
    """What whitens vectors of one length."""

    n: int
    sums: list[int]
    mean: np.ndarray
    vectors: np.ndarray  # one column for each component
    values: np.ndarray  # eigenvalues; 0 where nothing varies
    explained: np.ndarray

    def whiten(self, data: np.ndarray) -> np.ndarray:
        """Rows x components, NaN where nothing varies."""
        scale = np.where(self.values > 0, self.values, np.nan)
        return (data - self.mean) @ self.vectors / np.sqrt(scale)

    def deviations(self, data: np.ndarray) -> list[int | None]:
        bound = self.n * largest(data) + max(map(abs, self.sums), default=0)
        exact = bound**2 * max(len(self.sums), 1) < SAFE
        kind = np.int64 if exact else object
        off = data.astype(kind) * self.n - np.array(self.sums, dtype=kind)
        found = (off * off).sum(axis=1).tolist() if len(self.sums) else [0] * len(data)
        return [v if v < 2**63 else None for v in found]


def learn(fit: DataFrame, k: int = K) -> dict[int, Fit]:
    """length -> its fit, from the list of distinct vectors (column x)."""
    sums = exact_sums(fit)
    out = {}
    for size, square in covariances(fit, sums).items():
        n, total = sums[size]
        trace = float(np.trace(square))
        values, vectors = leading(square, k)
        values = np.where(values > trace * size * np.finfo(float).eps, values, 0.0)
        out[size] = Fit(n, total, mean_of(n, total), vectors, values, values / trace if trace else np.full(len(values), np.nan))
    return out


def identity_error(fit: DataFrame, fits: dict[int, Fit], k: int = K) -> float | None:
    """Largest entry of (covariance of the whitened fit list - identity), over components that vary."""
    names = [f"w{i}" for i in range(k)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for size, rows, data in by_length(batch.column("x")):
                if size:
                    wide = np.full((len(rows), k), np.nan)
                    wide[:, : fits[size].values.size] = fits[size].whiten(data)
                    columns = [pa.array(wide[:, i], from_pandas=True) for i in range(k)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), size, np.int32)), *columns], ["size", *names])

    whitened = fit.mapInArrow(run, "size int, " + ", ".join(f"{n} double" for n in names))
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    off = [F.abs(F.covar_pop(names[i], names[j]) - F.lit(float(i == j))) for i, j in pairs]
    rows = whitened.groupBy("size").agg(*[o.alias(f"c{p}") for p, o in enumerate(off)]).drop("size").collect()
    return max((v for row in rows for v in row if v is not None), default=None)


def whiten(embeddings: DataFrame, k: int = K) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error: a row for each vector and component."""
    rows = whole_vectors(embeddings)
    fit = cut_lineage(rows.select("x").distinct(), "fit-list")
    fits = learn(fit, k)
    error = identity_error(fit, fits, k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for size, at, data in by_length(batch.column("x")):
                if not size:
                    continue
                own = fits[size]
                c = len(own.values)
                each, place = np.repeat(np.arange(len(at)), c), np.tile(np.arange(c), len(at))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("vec_id").take(pa.array(at[each])),
                        pa.array((place + 1).astype(np.int32)),
                        pa.array(np.full(len(each), own.n, np.int64)),
                        pa.array(own.deviations(data), pa.int64()).take(pa.array(each)),
                        pa.array(own.whiten(data).ravel(), from_pandas=True),
                        pa.array(own.explained[place], from_pandas=True),
                        pa.array([error] * len(each), pa.float64()),
                    ],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.mapInArrow(run, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
