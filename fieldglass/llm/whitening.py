"""Whitening of embeddings by shifted CholeskyQR.

Vectors become integers, so that counts, sums and deviations are exact. Rows are centred exactly (n*x - S, then divided by n) before
anything is multiplied. Then passes over all rows make them orthogonal: each task adds up the Gram matrix of its rows, these are added up
over all tasks, and their Cholesky factor R turns the rows by a triangular solve. The first pass shifts the Gram matrix, so
that its factor exists however ill-conditioned the rows are; later passes repeat this on the rows as turned so far until they are
orthonormal. The product of the factors, with what the last Gram matrix still differs from the identity, has the singular values and
right singular vectors of the rows; the covariance itself, whose condition is the square, is never decomposed.

Only Gram matrices of d rows and d columns and sums of d numbers come to the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Units of an entry, what is added, and where entries are held (so that they are longs).
SCALE, OFFSET, MOST = 64, 1_000_000, 2**62
#: Rows that a task turns at once, passes at most, the distance from the identity that ends them, and the share of the largest variance that a component has at least.
ROWS, PASSES, CLOSE, LEAST = 4096, 8, 1e-9, 1e-13
COMPONENTS = 32


def usable(vector: str) -> Column:
    """Whether a vector is there, with at least one entry, and all of its entries are finite numbers."""
    c = F.col(vector)
    return F.coalesce((F.size(c) > 0) & F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def integers(column: pa.Array) -> np.ndarray:
    """The entries of a batch of vectors of one length as longs: floor(64 * c) + 1000000."""
    column = column.cast(pa.large_list(pa.float64())) if pa.types.is_list(column.type) else column
    flat = np.floor(SCALE * column.flatten().to_numpy(zero_copy_only=False)).reshape(len(column), -1)
    return np.clip(flat, -MOST, MOST).astype(np.int64) + OFFSET


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Count and exact sum of each dimension in this task."""
    n, high, low = 0, None, None
    for batch in batches:
        if batch.num_rows:
            x = integers(batch.column(0))
            n += len(x)
            high = (x >> 32).sum(axis=0) + (0 if high is None else high)
            low = (x & 0xFFFFFFFF).sum(axis=0) + (0 if low is None else low)
    if n:
        sums = [Decimal((int(h) << 32) + int(v)) for h, v in zip(high, low, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(sums)), pa.int32()), pa.array([n] * len(sums)), pa.array(sums, pa.decimal128(38, 0))], ["i", "n", "s"])


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n*x - S, exactly: longs where they fit, else Python integers."""
    most = max(int(x.max()), -int(x.min()), 1) * n + max(map(abs, sums))
    return x * n - np.array(sums, np.int64) if most < 2**63 else x.astype(object) * n - np.array(sums, object)


def deviations(apart: np.ndarray) -> list[int | None]:
    """The sum of squares of each row, exactly; null where it is no long."""
    if apart.dtype == np.int64 and max(int(apart.max()), -int(apart.min())) ** 2 * apart.shape[1] < 2**63:
        return (apart * apart).sum(axis=1).tolist()
    found = [int(v) for v in (apart.astype(object) ** 2).sum(axis=1)]
    return [v if v < 2**63 else None for v in found]


def turned(rows: np.ndarray, factors: list[np.ndarray]) -> np.ndarray:
    """rows @ inverse(R) for each upper triangular R in turn, by substitution."""
    for r in factors:
        out = np.empty_like(rows)
        for j in range(r.shape[0]):
            out[:, j] = (rows[:, j] - out[:, :j] @ r[:j, j]) / r[j, j]
        rows = out
    return rows


def _blocks(batches: Iterator[pa.RecordBatch], n: int, sums: list[int]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            yield part, centred(integers(part.column(part.num_columns - 1)), n, sums)


def _gram(n: int, sums: list[int], turn: Callable[[np.ndarray], np.ndarray]):
    """The Gram matrix of a task's rows as they are turned: i, row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for _, apart in _blocks(batches, n, sums):
            rows = turn((apart / n).astype(np.float64))
            total = rows.T @ rows + (0 if total is None else total)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["i", "row"])

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with equal i, added up: as many rows at most as the matrix has in this task."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for i, row in zip(batch.column("i").to_pylist(), batch.column("row").to_pylist(), strict=True):
            total[i] = total[i] + np.array(row) if i in total else np.array(row)
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(list(total.values()), pa.list_(pa.float64()))], ["i", "row"])


def gram(vectors: DataFrame, n: int, sums: list[int], turn: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    kind = "i int, row array<double>"
    found = vectors.mapInArrow(_gram(n, sums, turn), kind).repartition("i").mapInArrow(_added, kind)
    return np.array([r["row"] for r in sorted(found.collect(), key=lambda r: r["i"])])


def factor(g: np.ndarray, n: int, shift: bool) -> np.ndarray:
    """The upper Cholesky factor of a Gram matrix of n rows; with a shift, or where there is none without, that of the shifted matrix."""
    d = len(g)
    by = 11 * (n * d + d * (d + 1)) * np.finfo(float).eps / 2 * np.linalg.norm(g, 2)
    while True:
        try:
            return np.linalg.cholesky(g + by * np.eye(d) if shift else g).T
        except np.linalg.LinAlgError:
            by *= 10 if shift else 1
            shift = True


def decomposed(vectors: DataFrame, n: int, sums: list[int]) -> tuple[np.ndarray, np.ndarray, float]:
    """Standard deviations (falling) and unit vectors (columns) of the components of the covariance, and its trace."""
    factors: list[np.ndarray] = []
    g = gram(vectors, n, sums, lambda rows: rows)
    trace, d = float(np.trace(g)) / n, len(g)
    # dimensions without any variance, exactly, are left out
    live = np.flatnonzero(np.diag(g) > 0)
    if not len(live):
        return np.zeros(0), np.zeros((d, 0)), 0.0
    g = g[np.ix_(live, live)]
    while len(factors) < PASSES and (not factors or np.abs(g - np.eye(len(g))).max() > CLOSE):
        factors.append(factor(g, n, shift=not factors))
        now = list(factors)
        g = gram(vectors, n, sums, lambda rows, now=now: turned(rows[:, live], now))
    whole = np.eye(len(live))
    for r in factors:
        whole = r @ whole
    size, axes = np.linalg.eigh(g)  # near 1; near 0 in directions that no row has
    _, singular, right = np.linalg.svd(np.sqrt(np.maximum(size, 0))[:, None] * (axes.T @ whole))
    kept = singular**2 > LEAST * singular[0] ** 2
    vectors_ = np.zeros((d, int(kept.sum())))
    vectors_[live] = right[kept].T
    return singular[kept] / np.sqrt(n), vectors_, trace


def _projected(n: int, sums: list[int], onto: np.ndarray, share: list[float], error: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = onto.shape[1]
        for part, apart in _blocks(batches, n, sums):
            rows = len(apart)
            at = pa.array(np.repeat(np.arange(rows), k))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0).take(at), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)), pa.array(np.full(rows * k, n)), pa.array(deviations(apart), pa.int64()).take(at),
                    pa.array(((apart / n).astype(np.float64) @ onto).ravel()), pa.array(np.tile(share, rows)), pa.array(np.full(rows * k, error)),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return run


def whitened(embeddings: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error for each usable vector and each of its first components.

    Rows whose vector is null, empty or holds a null, NaN or infinite entry are dropped. All others are fitted, repeated rows and rows with a null
    id as often as they come; the result has them as often. Vectors of another length than most (of the longer, in a tie) are dropped too, since they share
    no covariance with the others. Components without variance (below 1e-13 of the largest) aren't returned: an empty table, a single vector or vectors
    that are all equal give no rows. Entries beyond 2^62 / 64 are held there; a deviation that is no long is null. Other columns play no part.
    """
    spark = embeddings.sparkSession
    kind = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    found = embeddings.where(usable(vector_col)).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    length = found.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if length is None:
        return spark.createDataFrame([], kind)
    found = found.where(F.size("vector") == length["d"])
    only = found.select("vector")
    sums = only.mapInArrow(_sums, "i int, n long, s decimal(38,0)").groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).orderBy("i").collect()
    n, sums = sums[0]["n"], [int(r["s"]) for r in sums]
    deviation, axes, trace = decomposed(only, n, sums)
    deviation, axes = deviation[:components], axes[:, :components]
    if not len(deviation):
        return spark.createDataFrame([], kind)
    onto = axes / deviation
    error = float(np.abs(gram(only, n, sums, lambda rows: rows @ onto) / n - np.eye(len(deviation))).max())
    return found.mapInArrow(_projected(n, sums, onto, (deviation**2 / trace).tolist(), error), kind)
