"""Embedding whitening by shifted CholeskyQR over distributed Gram passes.

Vectors become whole numbers, each distinct one is fitted once. With A the centred distinct rows, a pass sums A'A over
all tasks and its Cholesky factor makes the rows nearly orthonormal: the first factor is of A'A shifted by a little
more than the sum's rounding error, so it exists however ill-conditioned A is. Two further passes sum the Gram matrix of
the rows after triangular solves with the factors so far and mend what the passes before left. The factors'
product R has R'R = A'A to double precision without A ever being squared in one step, and the singular values and
right vectors of R are the components. A pass whose matrix is singular (dimensions that never vary, fewer vectors
than dimensions) is shifted too, each time by as little as makes it succeed; the shifts multiply, so their
product vanishes beside anything that counts.

How it runs. Equal vectors are brought together by grouping with partial aggregation, so one that a third of all rows
hold is one row a task before the shuffle. Sums are exact whole numbers per dimension, and rows are centred by
their whole and broken parts apart, so no digit is lost to a large mean. A task's part of a Gram matrix leaves it as
d rows, which are added by row number; the driver gets d rows whatever the table's size. All it holds is
bounded by the dimension, which must be such that a d x d matrix fits in a task. Distinct vectors are stored once and
read by every pass.

Defined cases. Null vectors, and those with a null or non-finite entry, are dropped. The dimension is the greatest length
left; shorter and empty vectors end in zeros, a table of empty ones has no components and no rows. Repeated rows and equal vectors each get their result and are fitted once.
Ties between eigenvalues: any orthonormal choice, the same for all rows. Components without variance: whitened
is null and explained 0 (null if nothing varies at all); identity_error is over the others, null if there are none. Null
ids are kept. No rows, or none left: no rows. ``deviation`` is null where it exceeds a long. Entries must be less than 2^44
after scaling, else the query stops with an error. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relayout.llm.shared import prepare, stored

#: Entries are multiplied by this and rounded down.
SCALE = 256
#: Components returned.
COMPONENTS = 4
#: Gram passes after the first, shifted one.
REPEATS = 2
#: Rows of a matrix worked on at a time.
BLOCK_ROWS = 4096
#: Largest scaled entry: differences and their squares stay exact as documented.
LARGEST = 1 << 44

Batches = Iterator[pa.RecordBatch]


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and lengths of a list column without nulls."""
    offsets = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
    return values.astype(np.float64), np.diff(offsets)


def _scaled(values: np.ndarray, scale: int) -> np.ndarray:
    whole = np.floor(values * scale) + 0.0
    if len(whole) and np.abs(whole).max() >= LARGEST:
        raise ValueError(f"an entry of {np.abs(values).max()} is too large to be scaled by {scale}")
    return whole.astype("<i8")


def scaled_vectors(vectors: DataFrame, id_column: str, vector: str, scale: int) -> DataFrame:
    """vec_id and ``x``, the scaled entries as bytes without zeros at the end, of every row that is kept."""
    read = vectors.select(F.col(id_column).alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    bad = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    kept = read.where(F.col("v").isNotNull() & ~F.coalesce(bad, F.lit(False)))

    def scaled(batches: Batches) -> Batches:
        for batch in batches:
            if not batch.num_rows:
                continue
            values, lengths = _lists(batch.column("v"))
            whole = _scaled(values, scale)
            ends = np.cumsum(lengths)
            # up to the last entry that is not zero, so that equal vectors have equal bytes
            last = np.where(whole != 0, np.arange(len(whole)) + 1, 0)
            last = np.maximum.accumulate(last) if len(last) else last
            filled = np.concatenate([[0], last])[ends]
            sizes = np.maximum(filled - (ends - lengths), 0)
            data = [whole[a : a + n].tobytes() for a, n in zip(ends - lengths, sizes)]
            columns = [batch.column("vec_id"), pa.array(data, pa.binary()), pa.array(lengths, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "x", "size"])

    kind = kept.schema["vec_id"].dataType.simpleString()
    return kept.mapInArrow(scaled, f"vec_id {kind}, x binary, size int")


def matrix(column: pa.Array, d: int) -> np.ndarray:
    """Bytes of ``scaled_vectors`` as rows of d whole numbers."""
    out = np.zeros((len(column), d), np.int64)
    for i, data in enumerate(column.to_pylist()):
        out[i, : len(data) // 8] = np.frombuffer(data, "<i8")
    return out


@dataclass(frozen=True)
class Whitening:
    """n distinct vectors with sums ``s`` per dimension; ``r`` is the composed factor of the centred rows."""

    n: int
    s: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    explained: np.ndarray
    identity_error: float | None

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """Rows of x on the components that vary, each with variance one; NaN on the others."""
        good = self.values > 0
        scale = np.where(good, 1 / np.sqrt(np.where(good, self.values, 1)), np.nan)
        return (centred(x, self.n, self.s) @ self.vectors) * scale


def centred(x: np.ndarray, n: int, s: tuple[int, ...]) -> np.ndarray:
    """x - s/n, by the whole and the broken part of s/n."""
    whole, broken = zip(*(divmod(total, n) for total in s))
    return (x - np.array(whole, np.int64)) - np.array([part / n for part in broken])


def summed(df: DataFrame, part: Callable[[np.ndarray], np.ndarray], d: int, size: int) -> np.ndarray:
    """Sum of ``part``, a square matrix, over blocks of the rows of ``x``."""

    def parts(batches: Batches) -> Batches:
        total = None
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                block = part(matrix(batch.column("x").slice(at, BLOCK_ROWS), d))
                total = block if total is None else total + block
        if total is not None:
            lines = [line.astype("<f8").tobytes() for line in total]
            yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array(lines, pa.binary())], ["i", "m"])

    def added(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(data, "<f8") for data in table.column("m").to_pylist())
        return pa.table({"i": table.column("i").slice(0, 1), "m": pa.array([total.tobytes()], pa.binary())})

    made = df.select("x").mapInArrow(parts, "i int, m binary").groupBy("i").applyInArrow(added, "i int, m binary")
    total = np.zeros((size, size))
    for row in made.collect():
        total[row["i"]] = np.frombuffer(row["m"], "<f8")
    return total


def factor(gram: np.ndarray, shift: float) -> np.ndarray:
    """Upper Cholesky factor; a matrix that has none is shifted, from ``shift`` on, until it has."""
    unit = np.trace(gram) / len(gram) or 1.0
    while True:
        try:
            return np.linalg.cholesky(gram + shift * unit * np.eye(len(gram))).T
        except np.linalg.LinAlgError:
            shift = max(100 * shift, len(gram) * np.finfo(float).eps)


def solved(rows: np.ndarray, factors: list[np.ndarray]) -> np.ndarray:
    """Rows times the inverses of the factors, one triangular solve after another."""
    for upper in factors:
        rows = np.linalg.solve(upper.T, rows.T).T
    return rows


def fit(distinct: DataFrame, d: int, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of distinct scaled vectors (``x`` of ``scaled_vectors``); None without rows."""
    n, s = exact_sums(distinct, d)
    if not n:
        return None
    eps = np.finfo(float).eps
    factors: list[np.ndarray] = []
    for repeat in range(1 + REPEATS):

        def gram(x: np.ndarray, so_far: tuple = tuple(factors)) -> np.ndarray:
            rows = solved(centred(x, n, s), list(so_far))
            return rows.T @ rows

        whole = summed(distinct, gram, d, d)
        factors.append(factor(whole, 11 * (math.sqrt(n) + d) * d * eps if repeat == 0 else 0.0))
    r = factors[0]
    for upper in factors[1:]:
        r = upper @ r
    sizes, right = np.linalg.svd(r)[1:]
    most = min(components, d)
    # what rounding and shifts leave of a direction without variance is less than this; one vector has none at all
    real = (sizes > sizes[0] * d * 64 * eps) & (n > 1)
    values = np.where(real, sizes**2 / n, 0.0)
    trace = float(np.sum(values))
    explained = values[:most] / trace if trace else np.full(most, np.nan)
    model = Whitening(n, s, values[:most], right[:most].T.copy(), explained, None)
    good = int(np.count_nonzero(model.values))
    if not good:
        return model

    def covariance(x: np.ndarray) -> np.ndarray:
        rows = model.whitened(x)[:, :good]
        rows = np.concatenate([rows, np.ones((len(rows), 1))], axis=1)
        return rows.T @ rows

    moments = summed(distinct, covariance, d, good + 1) / n
    mean = moments[good, :good]
    error = np.abs(moments[:good, :good] - np.outer(mean, mean) - np.eye(good)).max()
    return Whitening(n, s, model.values, model.vectors, explained, float(error))


def exact_sums(distinct: DataFrame, d: int) -> tuple[int, tuple[int, ...]]:
    """Number of rows and exact sum of each dimension; every task gives one row per dimension."""

    def parts(batches: Batches) -> Batches:
        n, total = 0, [0] * d
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):  # 2^12 rows of less than 2^44 fit a long
                x = matrix(batch.column("x").slice(at, BLOCK_ROWS), d)
                n += len(x)
                total = [a + int(b) for a, b in zip(total, x.sum(axis=0))]
        names = ["i", "n", "s"]
        numbers = [str(a) for a in total]
        columns = [pa.array(range(-1, d), pa.int32()), pa.array([n, *[0] * d], pa.int64()), pa.array(["0", *numbers])]
        yield pa.RecordBatch.from_arrays(columns, names)

    made = distinct.select("x").mapInArrow(parts, "i int, n long, s string")
    found = made.groupBy("i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    by = {row["i"]: row for row in found}
    if not by:
        return 0, ()
    return by[-1]["n"], tuple(int(by[i]["s"]) for i in range(d))


def deviations(x: np.ndarray, n: int, s: tuple[int, ...]) -> list[int | None]:
    """Sum over dimensions of (n*x - s)^2 per row, in whole numbers of any size."""
    wide = x.astype(object)
    out = []
    for row in wide:
        total = sum((n * a - b) ** 2 for a, b in zip(row.tolist(), s))
        out.append(total if total < 1 << 63 else None)
    return out


def small_deviations(x: np.ndarray, n: int, s: tuple[int, ...]) -> list[int | None]:
    """``deviations`` by machine integers where no step can exceed them."""
    largest = int(np.abs(x).max(initial=0))
    if x.shape[1] * (n * largest + max(map(abs, s), default=0)) ** 2 >= 1 << 62:
        return deviations(x, n, s)
    return (((n * x - np.array(s, np.int64)) ** 2).sum(axis=1)).tolist()


def whiten(
    vectors: DataFrame, id_column: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS,
    scale: int = SCALE,
) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error for every kept row and component."""
    prepare(vectors.sparkSession)
    rows = stored(scaled_vectors(vectors, id_column, vector, scale), "whitening-rows")
    distinct = stored(rows.select("x").distinct(), "whitening-distinct")
    d = rows.agg(F.max("size")).first()[0] or 0
    model = fit(distinct, d, components) if d else None
    kind = rows.schema["vec_id"].dataType.simpleString()
    schema = (
        f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    )

    def projected(batches: Batches) -> Batches:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                x = matrix(part.column("x"), d)
                count, m = len(x), len(model.values)
                white = model.whitened(x).reshape(-1)
                deviation = pa.array(small_deviations(x, model.n, model.s), pa.int64())
                row = pa.array(np.repeat(np.arange(count), m))
                columns = [
                    part.column("vec_id").take(row), pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), count)),
                    pa.array(np.full(count * m, model.n, np.int64)), deviation.take(row),
                    pa.array(white, mask=np.isnan(white)),
                    pa.array(np.tile(model.explained, count), mask=np.isnan(np.tile(model.explained, count))),
                    pa.array([model.identity_error] * (count * m), pa.float64()),
                ]
                yield pa.RecordBatch.from_arrays(
                    columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
                )

    if model is None:
        return vectors.sparkSession.createDataFrame([], schema)
    return rows.select("vec_id", "x").mapInArrow(projected, schema)
