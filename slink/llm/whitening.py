"""Whitening of vectors by shifted CholeskyQR.

Entries become whole numbers (256 steps a unit), and each distinct vector counts once. The centred distinct vectors
are a tall matrix; a distributed pass adds up its Gram matrix, whose (shifted, where need be) Cholesky factor turns
the rows by a triangular solve into nearly orthogonal ones, whose Gram matrix the next pass adds up, until they are
orthogonal. The composed triangular factors are the R of a QR decomposition of the matrix; its singular vectors are
the components, and no covariance matrix, with its squared condition number, is decomposed.

Only the Gram matrices (the square of the dimension) reach the driver, each added up in two steps on the executors in
a fixed order.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slink.sources.shared import new_path

STEPS = 256
COMPONENTS = 4
MOST_PASSES = 6
LARGEST = 1 << 53  # a step number beyond it is no whole number of its own in double precision
BLOCK_ENTRIES = 1 << 20
_KINDS = ("<i2", "<i4", "<i8")


@dataclass
class Whitening:
    """Count, exact sums, components (columns), their eigenvalues, the trace, and the largest error of whitening."""

    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    identity_error: float
    passes: int

    def centre(self, x: np.ndarray) -> np.ndarray:
        return _centred(x, self.n, self.sums)

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return self.centre(x) @ self.components / np.sqrt(self.eigenvalues)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Exact sums of (n x - S) squared; None where one does not fit 64 bits."""
        sums = np.array(self.sums, object)
        reach = self.n * int(np.abs(x).max(initial=0)) + max(map(abs, self.sums), default=0)
        if reach * reach * max(1, x.shape[1]) < 1 << 63:
            return ((self.n * x - sums.astype(np.int64)) ** 2).sum(axis=1).tolist()
        exact = ((self.n * x.astype(object) - sums) ** 2).sum(axis=1)
        return [int(v) if v < 1 << 63 else None for v in exact]


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - S/n: the whole part of the mean is taken off exactly."""
    whole = np.array([s // n for s in sums], np.int64)
    rest = np.array([(s % n) / n for s in sums])
    return (x - whole) - rest


def quantised(column: pa.Array, steps: int = STEPS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix of whole numbers) of each length among the usable vectors of a column."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    present = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
    some = column.take(pa.array(present))
    sizes = np.diff(some.offsets.to_numpy()).astype(np.int64)
    entries = some.flatten()
    values = entries.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
    starts = np.cumsum(sizes) - sizes
    for size in np.unique(sizes[sizes > 0]).tolist():
        rows = np.flatnonzero(sizes == size)
        matrix = np.floor(steps * values[starts[rows][:, None] + np.arange(size)])
        usable = (np.abs(matrix) < LARGEST).all(axis=1)  # false for NaN and infinities, too
        yield present[rows[usable]], matrix[usable].astype(np.int64)


def _packed(matrix: np.ndarray) -> list[bytes]:
    """Each row in its narrowest width, so equal vectors are equal bytes."""
    most = np.abs(matrix).max(axis=1)
    out: list[bytes] = [b""] * len(matrix)
    width = np.where(most < 1 << 15, 0, np.where(most < 1 << 31, 1, 2))
    for kind in np.unique(width).tolist():
        rows = np.flatnonzero(width == kind)
        data = matrix[rows].astype(_KINDS[kind])
        for row, values in zip(rows.tolist(), data, strict=True):
            out[row] = bytes([kind]) + values.tobytes()
    return out


def _unpacked(keys: list[bytes], dimension: int) -> np.ndarray:
    out = np.empty((len(keys), dimension), np.int64)
    kinds = np.array([k[0] for k in keys])
    for kind in np.unique(kinds).tolist():
        rows = np.flatnonzero(kinds == kind)
        joined = b"".join(keys[i][1:] for i in rows.tolist())
        out[rows] = np.frombuffer(joined, _KINDS[kind]).reshape(-1, dimension)
    return out


def distinct_vectors(vectors: DataFrame, vector: str, steps: int) -> DataFrame:
    """(size, key) of every distinct usable vector, written to the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, matrix in quantised(batch.column(0), steps):
                keys = _packed(matrix)
                sizes = pa.array([matrix.shape[1]] * len(keys), pa.int32())
                yield pa.RecordBatch.from_arrays([sizes, pa.array(keys, pa.binary())], names=["size", "key"])

    path = new_path(vectors.sparkSession, "distinct-vectors")
    vectors.select(vector).mapInArrow(run, "size int, key binary").distinct().write.parquet(path)
    return vectors.sparkSession.read.parquet(path)


def _blocks(batches: Iterator[pa.RecordBatch], dimension: int) -> Iterator[np.ndarray]:
    rows = max(1, BLOCK_ENTRIES // dimension)
    for batch in batches:
        keys = batch.column("key").to_pylist()
        for start in range(0, len(keys), rows):
            yield _unpacked(keys[start : start + rows], dimension)


def _sums(fit: DataFrame, dimension: int) -> list[int]:
    """Exact sums per dimension: high and low halves apart, so that none overflows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high, low = np.zeros(dimension, np.int64), np.zeros(dimension, np.int64)
        for x in _blocks(batches, dimension):
            high += (x >> 26).sum(axis=0)
            low += (x & ((1 << 26) - 1)).sum(axis=0)
        columns = [pa.array(np.arange(dimension)), pa.array(high), pa.array(low)]
        yield pa.RecordBatch.from_arrays(columns, names=["i", "high", "low"])

    parts = fit.select("key").mapInArrow(run, "i long, high long, low long")
    totals = parts.groupBy("i").agg(F.sum(F.col("high").cast("decimal(38,0)")).alias("high"), F.sum(F.col("low").cast("decimal(38,0)")).alias("low"))
    found = {r["i"]: (int(r["high"]) << 26) + int(r["low"]) for r in totals.collect()}
    return [found[i] for i in range(dimension)]


def solve_triangular(rows: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """Q of Q R = rows for an upper triangular R, column by column."""
    q = np.empty_like(rows)
    for j in range(rows.shape[1]):
        q[:, j] = (rows[:, j] - q[:, :j] @ upper[:j, j]) / upper[j, j]
    return q


def _gram(fit: DataFrame, dimension: int, prepare) -> np.ndarray:
    """Sum over all vectors of prepare(x)^T prepare(x), one row of the matrix per task and then per row number."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for x in _blocks(batches, dimension):
            rows = prepare(x)
            total = rows.T @ rows if total is None else total + rows.T @ rows
        if total is not None:
            part = TaskContext.get().partitionId()
            n = len(total)
            columns = [pa.array(np.arange(n)), pa.array([part] * n, pa.int64()), pa.array(list(total), pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["i", "part", "row"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, row in zip(batch.column("i").to_pylist(), batch.column("row"), strict=True):
                values = row.values.to_numpy()
                totals[i] = totals[i] + values if i in totals else values
        columns = [pa.array(list(totals), pa.int64()), pa.array(list(totals.values()), pa.list_(pa.float64()))]
        yield pa.RecordBatch.from_arrays(columns, names=["i", "row"])

    rows = fit.select("key").mapInArrow(partial, "i long, part long, row array<double>")
    summed = rows.repartition("i").sortWithinPartitions("i", "part").mapInArrow(add, "i long, row array<double>")
    found = {r["i"]: r["row"] for r in summed.collect()}
    return np.array([found[i] for i in range(len(found))])


def _factor(gram: np.ndarray, shift: float) -> np.ndarray:
    """Upper Cholesky factor of the Gram matrix plus `shift` times the identity; the shift grows where it fails."""
    while True:
        try:
            return np.linalg.cholesky(gram + shift * np.eye(len(gram))).T
        except np.linalg.LinAlgError:
            shift = max(100 * shift, len(gram) * np.finfo(float).eps * np.trace(gram))


def fit(vectors: DataFrame, vector: str = "embedding", components: int = COMPONENTS, steps: int = STEPS) -> Whitening | None:
    """The whitening of the distinct quantised vectors of a table; None where none is usable.

    Vectors that are null or hold null or non-finite entries, or entries of 2^53 steps or more, take no part. All
    vectors must have one length: those of another length than the most frequent one (of equals the greater) take
    no part, as no covariance is defined over them. Components whose variance is zero (a singular value below 1e-11
    of the greatest) have no whitening and are left out, so fewer than `components` may come back, or none, as for
    a single distinct vector.
    """
    table = distinct_vectors(vectors, vector, steps)
    lengths = table.groupBy("size").count().orderBy(F.desc("count"), F.desc("size")).limit(1).collect()
    if not lengths:
        return None
    dimension, n = lengths[0]["size"], lengths[0]["count"]
    table = table.filter(F.col("size") == dimension)
    sums = _sums(table, dimension)
    factors: list[np.ndarray] = []

    def rows_of(x: np.ndarray) -> np.ndarray:
        rows = _centred(x, n, sums)
        for upper in factors:
            rows = solve_triangular(rows, upper)
        return rows

    gram = _gram(table, dimension, rows_of)
    trace = float(np.trace(gram)) / n
    eps = np.finfo(float).eps
    # The shift of the first pass keeps the factor away from singular whatever the condition number.
    shift = 11 * (n * dimension + dimension * (dimension + 1)) * eps * np.linalg.norm(gram, 2)
    composed = np.eye(dimension)
    empty = np.zeros((dimension, 0))
    if trace == 0:
        return Whitening(n, sums, empty, np.zeros(0), 0.0, 0.0, 1)
    passes = 1
    while True:
        upper = _factor(gram, shift)
        composed = upper @ composed
        passes += 1
        factors.append(upper)
        gram = _gram(table, dimension, rows_of)
        values = np.linalg.eigvalsh(gram)
        orthogonal = np.abs(values[values > 0.5] - 1).max(initial=0) < 1e-13 * dimension and not ((values > 1e-6) & (values <= 0.5)).any()
        if orthogonal or passes >= MOST_PASSES:
            break
        shift = 0.0
    _, singular, right = np.linalg.svd(composed)
    used = min(components, int((singular > 1e-11 * singular[0]).sum()))
    found = Whitening(n, sums, right[:used].T.copy(), singular[:used] ** 2 / n, trace, 0.0, passes)
    if used:
        covariance = _gram(table, dimension, found.whiten) / n
        found.identity_error = float(np.abs(covariance - np.eye(used)).max())
    return found


def whiten(
    vectors: DataFrame, found: Whitening | None, keep: list[str], vector: str = "embedding", steps: int = STEPS
) -> DataFrame:
    """`keep` columns, deviation and whitened (an array, one entry a component) of every usable row.

    Repeated rows stay; unusable ones (as for `fit`) are left out; other columns are ignored, whatever their names.
    A deviation that does not fit 64 bits is null.
    """
    slim = vectors.select(F.struct(*keep).alias("_k"), F.col(vector).alias("_v"))
    schema = f"_k {slim.schema['_k'].dataType.simpleString()}, deviation long, whitened array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches if found else ():
            for rows, matrix in quantised(batch.column("_v"), steps):
                if matrix.shape[1] != len(found.sums) or not len(rows):
                    continue
                columns = [
                    batch.column("_k").take(pa.array(rows)),
                    pa.array(found.deviations(matrix), pa.int64()),
                    pa.array(list(found.whiten(matrix)), pa.list_(pa.float64())),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["_k", "deviation", "whitened"])

    return slim.mapInArrow(run, schema).select("_k.*", "deviation", "whitened")
