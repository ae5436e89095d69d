"""Whitening of embeddings from an exact integer scatter.

Each entry c becomes x = floor(SCALE * c) + SHIFT. Tasks subtract the shift and accumulate sums and cross-products of the
integers: blocks by float64 matrix products, short enough that every partial sum is an integer below 2^53, then in integers
without a bound. Spark adds them up in limbs of 30 bits, so nothing rounds or overflows however many rows there are. The
driver holds one matrix of the dimension, n * X'X - S S', exact; only then is it converted to floats, divided by n^2 and
decomposed by eigh. Rows are projected in a second scan; a third measures the covariance of the whitened rows.

Scale: scans of the vectors, and one shuffle of the tasks' partial sums (rows and entries of the matrix). What reaches the
driver is bounded by the square of the dimension, whatever the number of rows; no vector does.

Defined cases: vectors that are null or hold null or non-finite entries are left out. The dimension is the most frequent
length among the others (the larger one of a tie); vectors of another length are left out too. Repeated rows count each; a
null vec_id is returned as null. Directions without variance (eigenvalue at most DIMENSION * 2^-50 of the largest) have no
component, so a table of equal rows, of one row or of none gives no rows. A deviation too large for a long is null.
Huge finite entries take Python's integers. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 32
LIMB = 30
#: Largest integer up to which float64 sums of integers are exact.
EXACT = 1 << 53
#: Rows of one block.
BLOCK = 4096


def matrices(batches: Iterator[pa.RecordBatch], dimension: int | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows that take part, their vectors as float64) of each batch of (vec_id, embedding); without a dimension, all whole vectors' lengths."""
    for batch in batches:
        for k in range(0, batch.num_rows, BLOCK):
            rows = batch.slice(k, BLOCK)
            column = rows.column(1)
            sizes = np.asarray(column.value_lengths().fill_null(-1))
            values = column.flatten()
            good = np.isfinite(np.asarray(values.cast(pa.float64()).fill_null(np.nan)))
            ends = np.cumsum(np.maximum(sizes, 0))
            upto = np.concatenate([[0], np.cumsum(good)])
            whole = (sizes >= 0) & (upto[ends] - upto[ends - np.maximum(sizes, 0)] == sizes)
            if dimension is None:
                yield np.flatnonzero(whole), sizes
                continue
            take = np.flatnonzero(whole & (sizes == dimension))
            data = np.asarray(values.cast(pa.float64()).fill_null(np.nan))
            yield rows.take(pa.array(take)), data[(ends[take] - dimension)[:, None] + np.arange(dimension)]


def integers(x: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x), the shift already taken off: int64, or Python integers where they don't fit."""
    y = np.floor(scale * x)
    if not y.size or np.abs(y).max() < 1 << 62:
        return y.astype(np.int64)
    # a double times a power of two that overflows is computed in integers
    return np.array([[int(v) if np.isfinite(v) else int(u) * scale for u, v in zip(p, q, strict=True)] for p, q in zip(x.tolist(), y.tolist(), strict=True)], object)


def product(x: np.ndarray) -> np.ndarray:
    """x'x in integers without a bound (dtype object)."""
    most = int(np.abs(x).max(initial=0))
    if most * most >= EXACT:
        x = x.astype(object)
        return x.T.dot(x)
    step = max(1, (EXACT - 1) // max(1, most * most))
    total = np.zeros((x.shape[1], x.shape[1]), object)
    for k in range(0, len(x), step):
        y = x[k : k + step].astype(np.float64)
        total += (y.T @ y).astype(np.int64).astype(object)
    return total


def limbs(values: list[int]) -> Iterator[tuple[int, list[int]]]:
    """(limb number, that limb of each value), signed, lowest first."""
    k = 0
    while k == 0 or any(values):
        yield k, [(abs(v) & ((1 << LIMB) - 1)) * (1 if v >= 0 else -1) for v in values]
        values = [(abs(v) >> LIMB) * (1 if v >= 0 else -1) for v in values]
        k += 1


def scatter(dimension: int, scale: int):
    """A task's partial sums: rows of (i, limb, entries): row i of X'X from its diagonal on; i = -1 for the sums and the count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cross, sums, n = np.zeros((dimension, dimension), object), np.zeros(dimension, object), 0
        for _, x in matrices(batches, dimension):
            y = integers(x, scale)
            cross += product(y)
            sums += y.astype(object).sum(axis=0) if len(y) else 0
            n += len(y)
        if n:
            rows = [(-1, k, part) for k, part in limbs([*sums.tolist(), n])]
            rows += [(i, k, part) for i in range(dimension) for k, part in limbs(cross[i, i:].tolist())]
            for k in range(0, len(rows), 256):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[k : k + 256], strict=True), (pa.int32(), pa.int32(), pa.list_(pa.int64())), strict=True)], names=["i", "limb", "entries"])

    return run


class Fit:
    """Counts, integer sums without the shift, the exact scatter n * X'X - S S', and the decomposition in floats."""

    def __init__(self, n: int, sums: list[int], cross: list[list[int]]):
        d = len(sums)
        self.n, self.sums = n, sums
        self.scatter = [[n * cross[i][j] - sums[i] * sums[j] for j in range(d)] for i in range(d)]
        self.covariance = np.array([[v / (n * n) for v in row] for row in self.scatter], np.float64).reshape(d, d)
        values, vectors = np.linalg.eigh(self.covariance) if d else (np.zeros(0), np.zeros((0, 0)))
        order = np.argsort(-values, kind="stable")
        self.values, self.vectors = values[order], vectors[:, order]
        self.trace = sum(self.scatter[i][i] for i in range(d)) / (n * n)
        self.rank = int((self.values > max(self.values, default=0) * d * 2.0**-50).sum()) if self.trace > 0 else 0


def dimension_of(vectors: DataFrame) -> int | None:
    """The most frequent length of vectors without null or non-finite entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole, sizes in matrices(batches, None):
            length, n = np.unique(sizes[whole], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(length, pa.int32()), pa.array(n, pa.int64())], names=["length", "n"])

    best = vectors.mapInArrow(run, "length int, n long").groupBy("length").agg(F.sum("n").alias("n")).agg(F.max_by("length", F.struct("n", "length")).alias("length")).first()
    return best.length


def fitted(vectors: DataFrame, scale: int = SCALE) -> Fit | None:
    """Fit all rows of vectors (vec_id, embedding); None where no row takes part."""
    d = dimension_of(vectors)
    if d is None:
        return None
    partial = vectors.mapInArrow(scatter(d, scale), "i int, limb int, entries array<bigint>")
    total = partial.select("i", "limb", F.posexplode("entries").alias("j", "v")).groupBy("i", "limb", "j").agg(F.sum("v").alias("v"))
    sums, cross = [0] * (d + 1), [[0] * d for _ in range(d)]
    for i, limb, j, v in total.collect():  # limbs of the entries of one matrix of the dimension
        if i < 0:
            sums[j] += v << LIMB * limb
        else:
            cross[i][i + j] += v << LIMB * limb
    for i in range(d):
        for j in range(i):
            cross[i][j] = cross[j][i]
    return Fit(sums[d], sums[:d], cross)


def deviations(x: np.ndarray, fit: Fit) -> tuple[np.ndarray, list[int | None]]:
    """(n * x - S as float64, the exact sum of its squares) of each row; None where that doesn't fit a long."""
    most = max([int(np.abs(x).max(initial=0)) * fit.n + max(map(abs, fit.sums), default=0), 1])
    if most * most * max(1, x.shape[1]) < 1 << 63:
        away = fit.n * x - np.array(fit.sums, np.int64)
        return away.astype(np.float64), (away * away).sum(axis=1).tolist()
    away = fit.n * x.astype(object) - np.array(fit.sums, object)
    total = (away * away).sum(axis=1).tolist()
    return away.astype(np.float64), [v if v < 1 << 63 else None for v in total]


def projected(x: np.ndarray, fit: Fit, k: int) -> tuple[np.ndarray, list[int | None]]:
    """(whitened rows, deviations): x minus its mean, times the unit components over the roots of their eigenvalues."""
    away, deviation = deviations(x, fit)
    return away / fit.n @ (fit.vectors[:, :k] / np.sqrt(fit.values[:k])), deviation


def identity_error(vectors: DataFrame, fit: Fit, k: int, scale: int = SCALE) -> float:
    """The largest absolute entry of the whitened rows' covariance minus the identity, measured over all rows."""
    d = len(fit.sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, cross = np.zeros(k), np.zeros((k, k))
        for _, x in matrices(batches, d):
            w, _ = projected(integers(x, scale), fit, k)
            total += w.sum(axis=0)
            cross += w.T @ w
        entries = np.concatenate([total, cross.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(entries), dtype=np.int32)), pa.array(entries)], names=["at", "v"])

    found = vectors.mapInArrow(run, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()  # k + k * k rows
    entries = np.zeros(k + k * k)
    for at, v in found:
        entries[at] = v / fit.n
    mean, cross = entries[:k], entries[k:].reshape(k, k)
    return float(np.abs(cross - np.outer(mean, mean) - np.eye(k)).max())


def whitened(vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """A row per vector that takes part and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    shift is part of x by definition; sums, deviations and projections are the same without it, so it never enters.
    """
    prepare(vectors.sparkSession)
    source = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    fit = fitted(source, scale)
    k = min(components, fit.rank) if fit else 0
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not k:
        return vectors.sparkSession.createDataFrame([], schema)
    error, d = identity_error(source, fit, k, scale), len(fit.sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, x in matrices(batches, d):
            w, deviation = projected(integers(x, scale), fit, k)
            m = len(w)
            ids = rows.column(0).take(pa.array(np.repeat(np.arange(m), k)))
            columns = [ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, fit.n, np.int64)), pa.array([v for v in deviation for _ in range(k)], pa.int64())]
            columns += [pa.array(w.ravel()), pa.array(np.tile(fit.values[:k] / fit.trace, m)), pa.array(np.full(m * k, error))]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in schema.split(", ")])

    return source.mapInArrow(run, schema)
