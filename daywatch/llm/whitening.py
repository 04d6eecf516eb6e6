"""Embedding whitening: leading eigenvalues by spectrum slicing, vectors by Rayleigh quotient iteration.

Entries become whole numbers, so counts, sums and products over the corpus are exact whatever
their order: tasks sum their own rows and the partial sums are added in a tree. Only one matrix of
the dimensions' square reaches the driver. There the covariance is shifted and factored as L D Lᵀ:
by Sylvester's law the signs in D count the eigenvalues on either side of the shift. Bisection on
the counts isolates each leading eigenvalue, Rayleigh quotient iteration converges on it
cubically, and counts just below and above the result certify its number.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from daywatch.session import shuffle_width

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
#: Rows of a batch at once.
ROWS = 4096
#: Largest entry, as a whole number, that exact sums are kept for.
MOST = 1 << 40
#: What an eigenvalue may be off by, as a part of the trace.
TOLERANCE = 1e-13
#: Entries are split at this before they are multiplied.
HALF = 1 << 20


# -- spectrum --------------------------------------------------------------------------------------


def inertia(matrix: np.ndarray) -> tuple[int, int]:
    """How many eigenvalues of a symmetric matrix are negative and positive.

    L D Lᵀ with symmetric pivoting: at each step the largest diagonal entry, or a 2 x 2 block
    around the largest other entry where that is much larger. A block has one of each sign.
    """
    a = np.array(matrix, float)
    negative = positive = 0
    bound = (1 + 17**0.5) / 8
    while len(a):
        diagonal = np.abs(np.diagonal(a))
        r = int(np.argmax(diagonal))
        off = np.abs(a - np.diag(np.diagonal(a)))
        i, j = np.unravel_index(int(np.argmax(off)), off.shape)
        if not diagonal[r] and not off[i, j]:
            break
        if diagonal[r] >= bound * off[i, j]:
            pivot = a[r, r]
            negative, positive = negative + (pivot < 0), positive + (pivot > 0)
            rest = np.delete(np.arange(len(a)), r)
            column = a[rest, r]
            a = a[np.ix_(rest, rest)] - np.outer(column, column / pivot)
        else:
            negative, positive = negative + 1, positive + 1
            rest = np.delete(np.arange(len(a)), [i, j])
            block = a[np.ix_([i, j], [i, j])]
            columns = a[np.ix_(rest, [i, j])]
            a = a[np.ix_(rest, rest)] - columns @ np.linalg.solve(block, columns.T)
        a = (a + a.T) / 2
    return int(negative), int(positive)


def above(matrix: np.ndarray, shift: float) -> int:
    """Eigenvalues greater than the shift."""
    return inertia(matrix - shift * np.eye(len(matrix)))[1]


def leading(matrix: np.ndarray, count: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """The greatest eigenvalues of a covariance, falling, and their unit vectors as rows.

    Those that are no greater than rounding are left out. Equal eigenvalues get any orthonormal
    vectors of their space.
    """
    size, trace = len(matrix), float(np.trace(matrix))
    values: list[float] = []
    vectors = np.zeros((0, size))
    if size == 0 or trace <= 0:
        return np.array(values), vectors
    scaled, least = matrix / trace, TOLERANCE * size
    draw = np.random.default_rng(1)
    known = {1.0 + 4 * least: 0, least: above(scaled, least)}
    while len(values) < min(count, known[least]):
        number = len(values) + 1
        low, high = _isolate(scaled, number, known, least)
        alone = known[low] - known[high] == 1
        value, vector = _quotients(scaled, (low + high) / 2, vectors, draw, alone)
        while alone and high - low > least / 8 and not low - least <= value <= high + least:
            # Drawn to a neighbour: slice on.
            low, high = _narrow(scaled, number, known, low, high)
            value, vector = _quotients(scaled, (low + high) / 2, vectors, draw, True)
        if alone and not above(scaled, value - 2 * least) >= number > above(scaled, value + 2 * least):
            raise ArithmeticError(f"eigenvalue {number} isn't where the counts have it")
        values.append(value)
        vectors = np.vstack([vectors, vector])
    order = np.argsort(-np.array(values), kind="stable")
    return np.array(values)[order] * trace, vectors[order]


def _narrow(matrix: np.ndarray, number: int, known: dict[float, int], low: float, high: float) -> tuple[float, float]:
    middle = (low + high) / 2
    known[middle] = above(matrix, middle)
    return (middle, high) if known[middle] >= number else (low, middle)


def _isolate(matrix: np.ndarray, number: int, known: dict[float, int], least: float) -> tuple[float, float]:
    """An interval with eigenvalue ``number`` alone, or as narrow as rounding; counts are kept in ``known``."""
    low = max(s for s, n in known.items() if n >= number)
    high = min(s for s, n in known.items() if n < number)
    while high - low > least and (known[low] - known[high] > 1 or high - low > 0.1 * high):
        low, high = _narrow(matrix, number, known, low, high)
    return low, high


def _quotients(
    matrix: np.ndarray, shift: float, found: np.ndarray, draw: np.random.Generator, alone: bool
) -> tuple[float, np.ndarray]:
    """Rayleigh quotient iteration from a shift, away from the vectors found already."""
    size = len(matrix)

    def cleared(v: np.ndarray) -> np.ndarray:
        for _ in range(2):
            v = v - found.T @ (found @ v)
        return v / np.linalg.norm(v)

    vector = cleared(draw.normal(size=size))
    best = (np.inf, shift, vector)
    for step in range(40):
        shifted = matrix - shift * np.eye(size)
        try:
            vector = cleared(np.linalg.solve(shifted, vector))
        except np.linalg.LinAlgError:
            vector = cleared(np.linalg.solve(shifted + 1e-16 * np.eye(size), vector))
        quotient = float(vector @ matrix @ vector)
        left = float(np.linalg.norm(matrix @ vector - quotient * vector))
        if left < best[0]:
            best = (left, quotient, vector)
        if left < 1e-16 or step > 4 and left >= best[0] and best[0] < 1e-14:
            break
        if step >= 2 and alone or not alone and left < 1e-6:  # the middle of the slice first
            shift = quotient
    return best[1], best[2]


# -- sums over the corpus --------------------------------------------------------------------------

_PARTIAL = "part long, data binary"


def _added(rows: DataFrame, kind: str) -> np.ndarray | None:
    """Sum of the arrays in ``part, data`` rows, by way of as many tasks as a shuffle has."""

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(v.as_buffer(), kind) for v in table.column("data"))
        return pa.Table.from_arrays(
            [table.column("part").slice(0, 1), pa.array([total.tobytes()], pa.binary())], names=["part", "data"]
        )

    shards = shuffle_width(rows.sparkSession)
    for part in (F.col("part") % shards, F.lit(0)):
        rows = rows.withColumn("part", part.cast("long")).groupBy("part").applyInArrow(add, _PARTIAL)
    found = rows.first()  # one row
    return found and np.frombuffer(found["data"], kind)


def _numbers(batch: pa.RecordBatch, column: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows with a usable vector, and their entries as whole numbers."""
    lists = batch.column(column)
    fits = pc.fill_null(pc.equal(pc.list_value_length(lists), size), False).to_numpy(zero_copy_only=False)
    rows = np.nonzero(fits)[0]
    flat = lists.take(pa.array(rows)).flatten()
    values = flat.cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(rows), size)
    usable = np.isfinite(values).all(1)  # a null entry is read as not a number
    values = np.floor(SCALE * values[usable])
    if len(values) and np.abs(values).max() >= MOST:
        raise ValueError(f"an entry is beyond {MOST // SCALE} in size")
    return rows[usable], values.astype(np.int64) + SHIFT


def _partials(
    vectors: DataFrame, size: int, fn: Callable[[np.ndarray], np.ndarray], shape: tuple[int, ...], kind: str
) -> DataFrame:
    """Per task the sum of ``fn`` over batches of whole-number vectors.

    Whole sums are kept as two arrays, multiples of 2**32 and the rest, so that they can't overflow.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = np.zeros((2, *shape) if kind == "<i8" else shape, kind)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                _, x = _numbers(whole.slice(at, ROWS), 0, size)
                if len(x):
                    found = fn(x)
                    total += np.stack([found >> 32, found & 0xFFFFFFFF]) if kind == "<i8" else found
        columns = [pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([total.tobytes()], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["part", "data"])

    return vectors.mapInArrow(run, _PARTIAL)


def _whole_sums(vectors: DataFrame, size: int, fn: Callable[[np.ndarray], np.ndarray], shape: tuple[int, ...]) -> np.ndarray | None:
    """Exact sums, as an array of Python integers."""
    found = _added(_partials(vectors, size, fn, shape, "<i8"), "<i8")
    if found is None:
        return None
    high, low = found.reshape(2, *shape).astype(object)
    return high * (1 << 32) + low


def _float_sums(vectors: DataFrame, size: int, fn: Callable[[np.ndarray], np.ndarray], shape: tuple[int, ...]) -> np.ndarray:
    return _added(_partials(vectors, size, fn, shape, "<f8"), "<f8").reshape(shape)


@dataclass(frozen=True)
class Whitening:
    """What a corpus is whitened by: exact count and sums, covariance, and its leading pairs."""

    n: int
    sums: list[int]
    covariance: np.ndarray
    values: np.ndarray
    vectors: np.ndarray

    @property
    def explained(self) -> np.ndarray:
        return self.values / np.trace(self.covariance)

    def deviations(self, x: np.ndarray) -> list[int]:
        """Sum over dimensions of (n x - S) squared, exact."""
        base = np.array([s // self.n for s in self.sums], np.int64)
        over = np.array([s - self.n * int(b) for s, b in zip(self.sums, base)], np.int64)
        z = x - base
        most = self.n * int(np.abs(z).max(initial=0)) + self.n
        if len(base) * most * most < 1 << 63:
            return ((self.n * z - over) ** 2).sum(1).tolist()
        wide = self.n * z.astype(object) - over.astype(object)
        return [int((row * row).sum()) for row in wide]

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened rows, a column per component."""
        base = np.array([s // self.n for s in self.sums], np.int64)
        part = np.array([(s - self.n * int(b)) / self.n for s, b in zip(self.sums, base)])
        return ((x - base) - part) @ self.vectors.T / np.sqrt(self.values)


def dimensions(vectors: DataFrame) -> int:
    """The commonest length of vectors, the greater of equally common ones; zero for none."""
    sizes = vectors.groupBy(F.size(vectors.columns[0]).alias("size")).count().where("size > 0")
    top = sizes.orderBy(F.desc("count"), F.desc("size")).first()
    return top["size"] if top else 0


def fit(embeddings: DataFrame, vector_col: str = "embedding", components: int = COMPONENTS) -> Whitening | None:
    """The whitening of all usable vectors; none if there are none."""
    vectors = embeddings.select(F.col(vector_col).alias("v"))
    size = dimensions(vectors)
    if not size:
        return None

    found = _whole_sums(vectors, size, lambda x: np.concatenate([[len(x)], x.sum(0)]), (1 + size,))
    if found is None or not found[0]:
        return None
    n, total = found[0], list(found[1:])
    base = np.array([s // n for s in total], np.int64)

    # Entries are centred on a whole number next to their mean, and that number's distance from
    # the mean, less than one, is put right afterwards. Halves keep the products of a batch small.
    def products(x: np.ndarray) -> np.ndarray:
        z = x - base
        high = (z + HALF // 2) // HALF
        low = z - high * HALF
        cross = high.T @ low
        return np.stack([high.T @ high, cross + cross.T, low.T @ low])

    square = _whole_sums(vectors, size, products, (3, size, size))
    exact = square[0] * (HALF * HALF) + square[1] * HALF + square[2]
    part = np.array([(s - n * int(b)) / n for s, b in zip(total, base)])
    covariance = (exact / n).astype(float) - np.outer(part, part)
    values, rows = leading((covariance + covariance.T) / 2, components)
    return Whitening(n, total, covariance, values, rows)


def identity_error(embeddings: DataFrame, model: Whitening, vector_col: str = "embedding") -> float:
    """Largest entry of the whitened vectors' covariance less the identity, measured over all of them."""
    vectors, size, k = embeddings.select(F.col(vector_col).alias("v")), len(model.sums), len(model.values)
    if not k:
        return 0.0
    mean = _float_sums(vectors, size, lambda x: model.project(x).sum(0), (k,)) / model.n

    def products(x: np.ndarray) -> np.ndarray:
        w = model.project(x) - mean
        return w.T @ w

    square = _float_sums(vectors, size, products, (k, k)) / model.n
    return float(np.abs(square - np.eye(k)).max())


def whiten(
    embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS
) -> DataFrame:
    """A row per usable vector and component: ``id_col, component, n, deviation, whitened, explained, identity_error``.

    Vectors that are null or hold null or non-finite entries are left out, and so are those of
    another length than the commonest (the greater of equally common ones) and empty ones. An
    entry c counts as floor(1024 c) + 100000; entries of 2**30 or more are refused. Components are unit
    eigenvectors of the covariance over all vectors, with repeats, numbered by falling
    eigenvalue; as many as have variance, so none where all vectors are equal. Equal
    eigenvalues have any orthonormal vectors. ``deviation`` is null where it exceeds a long. Null and repeated ids are rows
    like others; an empty table gives no rows; other columns don't matter.
    """
    id_field = embeddings.schema[id_col]
    schema = StructType(
        [
            StructField(id_col, id_field.dataType),
            StructField("component", IntegerType()),
            StructField("n", LongType()),
            StructField("deviation", LongType()),
            StructField("whitened", DoubleType()),
            StructField("explained", DoubleType()),
            StructField("identity_error", DoubleType()),
        ]
    )
    model = fit(embeddings, vector_col, components)
    if model is None or not len(model.values):
        return embeddings.sparkSession.createDataFrame([], schema)
    error, size, k, explained = identity_error(embeddings, model, vector_col), len(model.sums), len(model.values), model.explained

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                rows, x = _numbers(batch, 1, size)
                deviations = [d if d < 1 << 63 else None for d in model.deviations(x)]
                columns = [
                    batch.column(0).take(pa.array(np.repeat(rows, k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(rows))),
                    pa.array(np.full(k * len(rows), model.n, np.int64)),
                    pa.array([d for d in deviations for _ in range(k)], pa.int64()),
                    pa.array(model.project(x).ravel()),
                    pa.array(np.tile(explained, len(rows))),
                    pa.array(np.full(k * len(rows), error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return embeddings.select(id_col, vector_col).mapInArrow(run, schema)
