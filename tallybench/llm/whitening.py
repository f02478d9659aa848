"""Embedding whitening: centred, turned to principal components, scaled to unit variance.

Entries are taken as whole numbers x = floor(64 c) + 1000000, so sums are exact. Four passes
read the vectors alone: (1) rows and sums per dimension; (2) the covariance V of x, centred
before multiplying at the whole number next to the mean, so products of ordinary
embeddings are exact in a double, and moved by the remaining fraction; (3) the covariance
of the whitened values, centred at each batch's own mean; (4) the result rows. Tasks send one
matrix each, summed in two steps, so neither the driver nor a task gets more than matrices
whose size is the number of dimensions.

The leading eigenvectors come from V on the driver: Householder reflections make it
tridiagonal, bisection on Sturm counts finds the eigenvalues, inverse iteration their
vectors, made orthogonal inside clusters of close eigenvalues, and the reflections turn
them back. Components, mean and scales are broadcast (their size is that of V's leading part).

Defined cases: vectors that are null, empty or hold null or non-finite entries are dropped,
and so are those whose length is not the table's most frequent one (the longer of ties).
Entries beyond 2**33 in size count as that, so that sums stay exact. Repeated rows and ids are rows of
their own; null ids are kept. A component whose variance is nothing but rounding (below
1e-12 of the trace per dimension) has no whitened values and is left out, so a table of one
distinct vector, or an empty one, gives no rows. ``deviation`` is null if it passes a long.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shipping import shipped

COMPONENTS = 32
SCALE, SHIFT = 64, 1_000_000
LARGEST = float(1 << 33)   # entries are cut to this size
ROUNDING = 1e-12           # of the trace per dimension: variances below are zero
MERGED = 256               # partial matrices summed in a task of the first step
ROWS = 1024                # rows taken at a time


def usable(vector: Column) -> Column:
    """Not null, not empty, every entry finite."""
    wide = vector.cast("array<double>")
    fine = F.forall(wide, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return F.coalesce((F.size(vector) > 0) & fine, F.lit(False))


def _x(column: pa.Array) -> np.ndarray:
    """The whole numbers of a batch of vectors of one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    c = np.clip(flat, -LARGEST, LARGEST).reshape(len(column), -1)
    return np.floor(SCALE * c).astype(np.int64) + SHIFT


def _parts(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[np.ndarray, pa.RecordBatch]]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            yield _x(part.column(column)), part


def _summed(rows: DataFrame, width: int) -> np.ndarray:
    """Sum of partial matrices (part, row, values): in two steps, to the driver."""
    schema = "part int, row int, values binary"

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(v.as_buffer(), np.float64) for v in table.column("values").combine_chunks())
        return pa.table({"part": table.column("part").slice(0, 1), "row": table.column("row").slice(0, 1), "values": pa.array([total.tobytes()], pa.binary())})

    once = rows.groupBy("part", "row").applyInArrow(add, schema)
    whole = once.withColumn("part", F.lit(0)).groupBy("part", "row").applyInArrow(add, schema).collect()  # a row per dimension
    out = np.zeros((width, width))
    for r in whole:
        out[r["row"]] = np.frombuffer(r["values"], np.float64)
    return out


def _matrix_rows(total: np.ndarray) -> pa.RecordBatch:
    from pyspark import TaskContext

    part = TaskContext.get().partitionId() // MERGED
    return pa.RecordBatch.from_arrays([pa.array([part] * len(total), pa.int32()), pa.array(np.arange(len(total)), pa.int32()),
                                       pa.array([r.tobytes() for r in total], pa.binary())], ["part", "row", "values"])


def covariance(vectors: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """V, divisor n, of the x of ``vectors`` (one column of vectors of one length)."""
    centre = np.array([(2 * s + n) // (2 * n) for s in sums], np.int64)  # next to the mean, exactly
    fraction = np.array([float(s - n * int(m)) / n for s, m in zip(sums, centre)])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(centre), len(centre)))
        for x, _ in _parts(batches, 0):
            y = (x - centre).astype(np.float64)
            total += y.T @ y
        yield _matrix_rows(total)

    found = _summed(shipped(vectors).mapInArrow(partial, "part int, row int, values binary"), len(sums))
    return found / n - np.outer(fraction, fraction)


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Householder reflections: diagonal, off-diagonal and the reflections' unit vectors."""
    a = matrix.copy()
    d = len(a)
    reflections = []
    for k in range(d - 2):
        v = a[k + 1:, k].copy()
        size = np.abs(v[1:]).max()
        if size == 0:
            reflections.append(np.zeros(d - k - 1))
            continue
        v /= max(size, abs(v[0]))
        v[0] += np.copysign(np.linalg.norm(v), v[0])
        v /= np.linalg.norm(v)
        reflections.append(v)
        p = a[k + 1:, k + 1:] @ v
        w = 2 * (p - v * (v @ p))
        a[k + 1:, k + 1:] -= np.outer(v, w) + np.outer(w, v)
        column = a[k + 1:, k].copy()
        a[k + 1:, k] = column - 2 * v * (v @ column)
    return np.diag(a).copy(), np.diag(a, -1).copy(), reflections


def sturm_counts(diagonal: np.ndarray, off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many eigenvalues of the tridiagonal matrix are below each value."""
    least = np.finfo(float).tiny / np.finfo(float).eps
    count = np.zeros(len(at), np.int64)
    q = diagonal[0] - at
    for i in range(len(diagonal)):
        if i:
            q = diagonal[i] - at - off[i - 1] ** 2 / q
        q = np.where(np.abs(q) < least, -least, q)
        count += q < 0
    return count


def largest_eigenvalues(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The k largest eigenvalues, falling, by bisection until the bounds are neighbours."""
    radius = np.abs(np.concatenate([[0.0], off])) + np.abs(np.concatenate([off, [0.0]]))
    low = np.full(k, (diagonal - radius).min())
    high = np.full(k, (diagonal + radius).max())
    margin = np.finfo(float).eps * max(abs(low[0]), abs(high[0])) * 4 + np.finfo(float).tiny
    low, high = low - margin, high + margin
    wanted = len(diagonal) - np.arange(k)  # eigenvalues below the (i+1)-th largest, and itself
    for _ in range(2100):
        middle = low + (high - low) / 2
        if ((middle <= low) | (middle >= high)).all():
            break
        above = sturm_counts(diagonal, off, middle) >= wanted
        high, low = np.where(above, middle, high), np.where(above, low, middle)
    return low + (high - low) / 2


def _solver(diagonal: np.ndarray, off: np.ndarray, value: float, norm: float):
    """Elimination with row exchange of the matrix less ``value``; returns a solve."""
    d = len(diagonal)
    least = np.finfo(float).eps * norm + np.finfo(float).tiny
    first, second, third = diagonal - value, np.append(off, 0.0), np.zeros(d)
    steps = []
    for i in range(d - 1):
        below = off[i]
        if abs(first[i]) >= abs(below):
            if abs(first[i]) < least:
                first[i] = least
            factor = below / first[i]
            first[i + 1] -= factor * second[i]
            steps.append((False, factor))
        else:
            factor = first[i] / below
            first[i], old = below, second[i]
            second[i], third[i] = first[i + 1], second[i + 1]
            first[i + 1] = old - factor * second[i]
            second[i + 1] = -factor * third[i]
            steps.append((True, factor))
    if abs(first[-1]) < least:
        first[-1] = least

    def solve(right: np.ndarray) -> np.ndarray:
        b = right.copy()
        for i, (swapped, factor) in enumerate(steps):
            if swapped:
                b[i], b[i + 1] = b[i + 1], b[i]
            b[i + 1] -= factor * b[i]
        for i in range(d - 1, -1, -1):
            if i + 1 < d:
                b[i] -= second[i] * b[i + 1]
            if i + 2 < d:
                b[i] -= third[i] * b[i + 2]
            b[i] /= first[i]
            if abs(b[i]) > 1e150:
                b /= abs(b[i])
        return b / np.linalg.norm(b)

    return solve


def eigenvectors(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit vectors (columns) by inverse iteration, orthogonal inside clusters."""
    d = len(diagonal)
    norm = (np.abs(diagonal) + np.abs(np.append(off, 0.0)) + np.abs(np.append(0.0, off))).max()
    out = np.zeros((d, len(values)))
    draw = np.random.default_rng(1)
    cluster, shifted = 0, 0.0
    for i, value in enumerate(values):
        if i and values[i - 1] - value > 1e-3 * norm:
            cluster = i
        # Equal eigenvalues get shifts of their own, a few roundings apart.
        shifted = value if not i else min(value, shifted - 4 * np.finfo(float).eps * norm) if i > cluster else value
        solve = _solver(diagonal, off, shifted, norm)
        v = draw.standard_normal(d)
        for _ in range(6):
            for _ in range(2):
                v -= out[:, cluster:i] @ (out[:, cluster:i].T @ v)
            v = solve(v / np.linalg.norm(v))
        for _ in range(2):
            v -= out[:, cluster:i] @ (out[:, cluster:i].T @ v)
            v /= np.linalg.norm(v)
        out[:, i] = v
    return out


def leading(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues, falling, and their unit eigenvectors as columns."""
    matrix = (matrix + matrix.T) / 2
    size = np.abs(matrix).max()
    if size == 0:
        return np.zeros(k), np.eye(len(matrix))[:, :k]
    diagonal, off, reflections = tridiagonal(matrix / size)
    values = largest_eigenvalues(diagonal, off, k)
    vectors = eigenvectors(diagonal, off, values)
    for start in range(len(reflections) - 1, -1, -1):
        v = reflections[start]
        vectors[start + 1:] -= 2 * np.outer(v, v @ vectors[start + 1:])
    return values * size, vectors


@dataclass
class Whitener:
    """What is broadcast: rows, sums, kept components (columns), their variances and shares."""

    n: int
    sums: list[int]
    components: np.ndarray
    variances: np.ndarray
    explained: np.ndarray

    def __post_init__(self):
        self.centre = np.array([(2 * s + self.n) // (2 * self.n) for s in self.sums], np.int64)
        self.fraction = np.array([float(s - self.n * int(m)) / self.n for s, m in zip(self.sums, self.centre)])
        self.scaled = self.components / np.sqrt(self.variances)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.centre).astype(np.float64) - self.fraction) @ self.scaled

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n x - S)^2, exactly."""
        away, rest = x - self.centre, np.array([s - self.n * int(m) for s, m in zip(self.sums, self.centre)], object)
        if len(x) and (self.n * (int(np.abs(away).max()) + 1)) ** 2 * x.shape[1] < 1 << 62:
            return ((self.n * away - rest.astype(np.int64)) ** 2).sum(axis=1).tolist()
        whole = [sum((self.n * int(a) - r) ** 2 for a, r in zip(row, rest)) for row in away]
        return [w if w < 1 << 63 else None for w in whole]


def identity_error(vectors: DataFrame, model: Whitener) -> float:
    """Largest absolute entry of the covariance of the whitened values minus the identity."""
    k = len(model.variances)
    shared = vectors.sparkSession.sparkContext.broadcast(model)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, mean, total = 0, np.zeros(k), np.zeros((k, k))
        for x, _ in _parts(batches, 0):
            w = shared.value.whitened(x)
            here = w.mean(axis=0)
            away, step = w - here, here - mean
            total += away.T @ away + np.outer(step, step) * (n * len(w) / (n + len(w)))
            n += len(w)
            mean += step * (len(w) / n)
        # Batches are centred at their own mean; the last row and column hold n and n * mean.
        whole = np.zeros((k + 1, k + 1))
        whole[:k, :k] = total + n * np.outer(mean, mean)
        whole[k, :k], whole[k, k] = n * mean, n
        yield _matrix_rows(whole)

    found = _summed(shipped(vectors).mapInArrow(partial, "part int, row int, values binary"), k + 1)
    mean = found[k, :k] / found[k, k]
    return float(np.abs(found[:k, :k] / found[k, k] - np.outer(mean, mean) - np.eye(k)).max())


def fit(vectors: DataFrame, components: int = COMPONENTS) -> Whitener | None:
    """Learn from usable vectors of one length (one column); None if nothing varies."""
    vector = vectors.columns[0]
    schema = "n long, sums array<decimal(38, 0)>"

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for x, _ in _parts(batches, 0):
            part = x.sum(axis=0)   # at most ROWS entries of 2**40
            n, total = n + len(x), part.astype(object) if total is None else total + part.astype(object)
        if n:
            from decimal import Decimal

            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([[Decimal(int(s)) for s in total]], pa.list_(pa.decimal128(38, 0)))], ["n", "sums"])

    counted = shipped(vectors.select(vector)).mapInArrow(partial, schema)
    flat = counted.select("n", F.posexplode("sums").alias("at", "s")).groupBy("at").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect()  # a row per dimension
    if not flat:
        return None
    n, sums = flat[0]["n"], [int(r["s"]) for r in sorted(flat, key=lambda r: r["at"])]
    v = covariance(vectors.select(vector), n, sums)
    trace = float(np.trace(v))
    values, found = leading(v, min(components, len(sums)))
    kept = values > ROUNDING * trace / len(sums)
    if trace <= 0 or not kept.any():
        return None
    return Whitener(n, sums, found[:, kept], values[kept], values[kept] / trace)


def whitened(table: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row per usable vector and component: key, component, n, deviation, whitened, explained, identity_error."""
    kind = table.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    fine = table.select(F.col(key).alias("_key"), F.col(vector).alias("_vector")).where(usable(F.col("_vector")))
    lengths = fine.groupBy(F.size("_vector").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    model = None
    if lengths:
        fine = fine.where(F.size("_vector") == lengths[0]["d"])
        model = fit(fine.select("_vector"), components)
    if model is None:
        return table.sparkSession.createDataFrame([], schema)
    error = identity_error(fine.select("_vector"), model)
    shared = table.sparkSession.sparkContext.broadcast(model)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        k = len(model.variances)
        for x, part in _parts(batches, 1):
            rows, each = len(x), np.repeat(np.arange(len(x)), k)
            yield pa.RecordBatch.from_arrays([
                part.column(0).take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1), rows), pa.int32()), pa.array(np.full(rows * k, model.n), pa.int64()),
                pa.array(model.deviations(x), pa.int64()).take(pa.array(each)), pa.array(model.whitened(x).ravel()),
                pa.array(np.tile(model.explained, rows)), pa.array(np.full(rows * k, error))],
                [key, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return shipped(fine).mapInArrow(project, schema)
