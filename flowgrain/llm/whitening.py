"""Whitening of embeddings by refined eigenvectors of their covariance.

Method. Vectors become whole numbers, so sums and products are exact. Their covariance is
gathered by Spark from centred blocks; its eigenvectors are found in float32 and corrected by
the matrix-multiplication iteration of Ogita and Aishima in extended precision, which about
squares the error each round. Where eigenvalues lie closer than the error allows to part them,
the block of their vectors is shifted by its mean, solved by itself and turned, and the
iteration goes on. Vectors are then projected block by block.

Size. Equal vectors meet once, combined before the shuffle. Of a partition only sums leave
the task: dimensions for the mean, their square for the covariance. The driver holds matrices
of dimensions squared, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, release, store

#: A number c becomes floor(SCALE * c) + ORIGIN.
SCALE, ORIGIN = 64, 1_000_000
#: Numbers whose scaled size is this or more are no usable entries.
LIMIT = 1 << 45
#: Most components.
COMPONENTS = 16
#: Rows of an Arrow batch of vectors, and rows multiplied at once when entries are large.
ROWS, SLAB = 4096, 128
#: Bits of the low part of a sum sent by a task.
LOW = 40
#: Most rounds of refinement.
ROUNDS = 40


def quantised(column: pa.Array) -> tuple[np.ndarray, list[bytes]]:
    """(places of the usable vectors, their whole numbers as little-endian 64-bit bytes)."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = column.flatten().cast(pa.float64(), safe=False)
    x = values.to_numpy(zero_copy_only=False)
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy().astype(np.int64)
    ends = np.cumsum(sizes)
    with np.errstate(invalid="ignore", over="ignore"):
        scaled = np.floor(SCALE * x)
        good = np.abs(scaled) < LIMIT
    bad = np.concatenate(([0], np.cumsum(~good)))
    usable = np.flatnonzero((sizes > 0) & (bad[ends] == bad[ends - sizes]))
    whole = np.where(good, scaled, 0).astype("<i8") + ORIGIN
    return usable, [whole[ends[i] - sizes[i]:ends[i]].tobytes() for i in usable.tolist()]


def whole_vectors(rows: DataFrame, id_name: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, x) of the usable rows; x holds 64-bit whole numbers as bytes."""
    batches_of(rows.sparkSession, ROWS)
    kind = rows.schema[id_name].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            usable, made = quantised(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(usable)), pa.array(made, pa.binary())],
                                             ["vec_id", "x"])

    return rows.select(F.col(id_name).alias("vec_id"), F.col(vector).cast("array<double>").alias("x")).mapInArrow(
        run, f"vec_id {kind}, x binary")


def matrix(batch: pa.RecordBatch, name: str = "x") -> np.ndarray:
    """Rows of equal length as one matrix of 64-bit whole numbers."""
    held = batch.column(batch.schema.get_field_index(name)).to_pylist()
    return np.frombuffer(b"".join(held), "<i8").reshape(len(held), -1)


def products(x: np.ndarray) -> np.ndarray:
    """Exact sum of the outer products of the rows of ``x``, as Python whole numbers."""
    top = int(np.abs(x).max(initial=0))
    if top * top * len(x) < 1 << 53:
        y = x.astype(np.float64)
        return (y.T @ y).astype(np.int64).astype(object)
    total = np.zeros((x.shape[1],) * 2, object)
    for low in range(0, len(x), SLAB):
        part = x[low:low + SLAB]
        high = part >> 23
        small = (part - (high << 23)).astype(np.float64)
        high = high.astype(np.float64)
        mixed = (high.T @ small).astype(np.int64).astype(object)
        total += ((high.T @ high).astype(np.int64).astype(object) << 46) + (mixed + mixed.T << 23) \
            + (small.T @ small).astype(np.int64).astype(object)
    return total


def _exact_sums(rows: DataFrame, of: Callable[[np.ndarray], np.ndarray]) -> dict[int, int]:
    """Exact sums over all rows of the cells that ``of`` gives for a block."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                cells = of(matrix(batch)).ravel()
                total = cells if total is None else total + cells
        if total is not None:
            high = [int(v) >> LOW for v in total]
            low = [int(v) & (1 << LOW) - 1 for v in total]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(high, pa.int64()),
                                              pa.array(low, pa.int64())], ["cell", "high", "low"])

    sums = rows.select("x").mapInArrow(run, "cell int, high long, low long").groupBy("cell").agg(
        F.sum(F.col("high").cast("decimal(38,0)")).alias("high"), F.sum(F.col("low").cast("decimal(38,0)")).alias("low"))
    return {r.cell: (int(r.high) << LOW) + int(r.low) for r in sums.collect()}


def _norm(a: np.ndarray) -> float:
    return float(np.linalg.norm(a.astype(np.float64), 2))


def eigenvectors(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, eigenvectors as columns) of a symmetric matrix in extended precision, by
    falling eigenvalue; the entry of greatest size of a vector, the first of equals, is
    positive."""
    a = a.astype(np.longdouble)
    d, tiny = len(a), np.finfo(np.longdouble).eps
    scale = np.abs(a).max(initial=0)
    if not scale:
        return np.zeros(d, np.longdouble), np.eye(d, dtype=np.longdouble)
    b, one = a / scale, np.eye(d, dtype=np.longdouble)
    x = np.linalg.eigh(b.astype(np.float32))[1].astype(np.longdouble)
    size, last = _norm(b), np.inf
    for _ in range(ROUNDS):
        x, change, solved = _refined(b, x, one, size, d * tiny)
        # rounding of b, over the least gap, is all that is left once the change stops falling
        if solved and (change <= 8 * d * tiny or change > last / 2):
            break
        last = change
    values = (x * (b @ x)).sum(axis=0) / (x * x).sum(axis=0)
    order = np.argsort(-values, kind="stable")
    values, x = values[order] * scale, x[:, order]
    x = x / np.sqrt((x * x).sum(axis=0))
    signs = np.sign(x[np.abs(x).argmax(axis=0), np.arange(d)])
    return values, x * signs


def _refined(b: np.ndarray, x: np.ndarray, one: np.ndarray, size: float, tiny: float
             ) -> tuple[np.ndarray, float, bool]:
    """One round: (vectors, largest correction, no cluster had to be solved)."""
    r = one - x.T @ x
    s = x.T @ (b @ x)
    # symmetric to the last digit, or a small gap would turn rounding into lost orthogonality
    r, s = (r + r.T) / 2, (s + s.T) / 2
    values = np.diag(s) / (1 - np.diag(r))
    apart = 2 * (_norm(s - np.diag(values)) + size * _norm(r))
    gap = values[None, :] - values[:, None]
    far = np.abs(gap) > apart
    fix = np.where(far, (s + values[None, :] * r) / np.where(far, gap, 1), r / 2)
    x = x + x @ fix
    order, solved = np.argsort(values, kind="stable"), True
    cuts = np.flatnonzero(np.diff(values[order]) > apart) + 1
    for block in np.split(order, cuts):
        if len(block) > 1:
            y = x[:, block]
            inner = y.T @ (b @ y) - values[block].mean() * (y.T @ y)
            inner = (inner + inner.T) / 2
            width = np.abs(inner).max()
            # a block that is constant to the last digit has one eigenvalue; any basis is right
            if width > tiny:
                turn = np.linalg.eigh((inner / width).astype(np.float64))[1]
                x[:, block] = y @ turn.astype(np.longdouble)
                solved = solved and float(np.abs(inner - np.diag(np.diag(inner))).max()) <= 8 * tiny
    return x, float(np.abs(fix).max()), solved


@dataclass
class Basis:
    """What whitening needs: count, whole-number centre, rest of the sums, components."""

    n: int
    centre: np.ndarray
    rest: list[int]
    vectors: np.ndarray
    values: np.ndarray
    explained: np.ndarray
    identity_error: float | None = None

    def projected(self, x: np.ndarray) -> np.ndarray:
        """Whitened rows; a component without variance is NaN."""
        with np.errstate(divide="ignore", invalid="ignore"):
            weights = np.where(self.values > 0, self.vectors / np.sqrt(self.values), np.nan)
        return ((x - self.centre) - np.array([r / self.n for r in self.rest])) @ weights

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Exact sum of squares of n * x - S by row; null beyond 64 bits."""
        y, rest = x - self.centre, np.array(self.rest, object)
        most = self.n * int(np.abs(y).max(initial=0)) + max(map(abs, self.rest), default=0)
        if most * most * x.shape[1] < 1 << 63:
            return (np.square(self.n * y - rest.astype(np.int64)).sum(axis=1)).tolist()
        total = ((self.n * y.astype(object) - rest) ** 2).sum(axis=1)
        return [int(v) if v < 1 << 63 else None for v in total]


def fit(vectors: DataFrame, components: int = COMPONENTS) -> Basis | None:
    """Basis of the distinct ``vectors`` (x, all of one length); None for an empty table."""
    n = vectors.count()
    if not n:
        return None
    sums = _exact_sums(vectors, lambda x: x.sum(axis=0).astype(object))
    d = len(sums)
    centre = np.array([(2 * sums[i] + n) // (2 * n) for i in range(d)], np.int64)
    rest = [sums[i] - n * int(centre[i]) for i in range(d)]
    cells = _exact_sums(vectors, lambda x: products(x - centre))
    exact = [[n * cells[i * d + j] - rest[i] * rest[j] for j in range(d)] for i in range(d)]
    square = np.longdouble(n) * np.longdouble(n)
    covariance = np.array([[np.longdouble(str(v)) for v in row] for row in exact], np.longdouble) / square
    values, axes = eigenvectors(covariance)
    trace = np.longdouble(str(sum(exact[i][i] for i in range(d)))) / square
    k = min(components, d)
    real = values[:k] > values[0] * d * np.finfo(np.float64).eps
    values = np.where(real, values[:k], 0)
    basis = Basis(n, centre, rest, axes[:, :k].astype(np.float64), values.astype(np.float64),
                  (values / trace if trace > 0 else values).astype(np.float64))
    basis.identity_error = _identity_error(vectors, basis)
    return basis


def _identity_error(vectors: DataFrame, basis: Basis) -> float | None:
    """Largest entry of the whitened vectors' covariance minus the identity, measured over all
    of them; null if no component has variance."""
    real = np.flatnonzero(basis.values > 0)
    k = len(real)
    if not k:
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k))
        for batch in batches:
            if batch.num_rows:
                z = basis.projected(matrix(batch))[:, real]
                total += np.vstack([z.T @ z, z.sum(axis=0)])
        yield pa.RecordBatch.from_arrays([pa.array(range(total.size), pa.int32()), pa.array(total.ravel())],
                                         ["cell", "value"])

    sums = vectors.select("x").mapInArrow(run, "cell int, value double").groupBy("cell").agg(
        F.sum("value").alias("value")).collect()
    held = np.zeros((k + 1) * k)
    for row in sums:
        held[row.cell] = row.value
    held = held.reshape(k + 1, k) / basis.n
    return float(np.abs(held[:k] - np.outer(held[k], held[k]) - np.eye(k)).max())


def whitened(rows: DataFrame, basis: Basis) -> DataFrame:
    """One row for each of ``rows`` (vec_id, x) and component of ``basis``."""
    kind = rows.schema["vec_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch)
            z = basis.projected(x)
            m, k = z.shape
            repeat = pa.array(np.repeat(np.arange(m), k))
            deviation = pa.array(basis.deviation(x), pa.int64()).take(repeat)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(repeat), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                 pa.array(np.full(m * k, basis.n, np.int64)), deviation,
                 pa.array(z.ravel(), pa.float64(), mask=np.isnan(z.ravel())), pa.array(np.tile(basis.explained, m)),
                 pa.array([basis.identity_error] * (m * k), pa.float64())], names)

    names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    return rows.select("vec_id", "x").mapInArrow(
        run, f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, "
             "identity_error double")


def whiten(rows: DataFrame, id_name: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS
           ) -> DataFrame:
    """Whitened ``rows`` (an id, an array of numbers, any other columns), one row for each
    usable row and each of at most ``components`` components.

    Rows are dropped whose vector is null or empty, holds a null or non-finite entry or one of
    2**45 / ``SCALE`` or more in size, or has not the commonest length (the shortest of equally
    common ones). A component without variance has null whitened values and explains 0. Null
    and repeated ids stay. deviation is null where it passes 64 bits. No usable row gives an
    empty table.
    """
    usable = store(whole_vectors(rows, id_name, vector))
    size = F.octet_length("x")
    length = usable.groupBy(size.alias("length")).count().orderBy(F.desc("count"), "length").first()
    kept = usable.where(size == (length["length"] if length else 0))
    vectors = store(kept.select("x").distinct())
    basis = fit(vectors, components)
    release(vectors)
    if basis is None:
        basis = Basis(1, np.zeros(0, np.int64), [], np.zeros((0, 0)), np.zeros(0), np.zeros(0))
    return whitened(kept, basis)
