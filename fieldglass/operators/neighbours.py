"""The nearest points of each asked point, exactly. Points lie in blocks of near ones, and blocks meet as rows of a cross join, so no point is copied by a shuffle."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldglass.operators.shared import fresh, written

#: Pivots at most, points of a block, points of an asking block, differences that a task holds at once, bytes of blocks that one task passes over.
MOST_PIVOTS, BLOCK, ASKING, HELD, PASSED = 1024, 2048, 512, 4_000_000, 64 << 20


def _rows(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), float).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def paired_distances(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Of rows i of a to rows j of b, from differences, so that equal distances come out equal."""
    out = np.empty(len(i))
    step = max(1, HELD // max(1, a.shape[1]))
    for k in range(0, len(i), step):
        out[k : k + step] = np.sqrt(((a[i[k : k + step]] - b[j[k : k + step]]) ** 2).sum(-1))
    return out


def squares(a: np.ndarray, b: np.ndarray, centre: np.ndarray) -> tuple[np.ndarray, float]:
    """Squared distances of each row of a to each row of b by products, and how far off they may be."""
    a, b = a - centre, b - centre
    p, q = (a**2).sum(axis=1), (b**2).sum(axis=1)
    return p[:, None] + q[None] - 2 * (a @ b.T), 1e-14 * (a.shape[1] + 8) * (p.max(initial=0) + q.max(initial=0))


def pivots_of(points: DataFrame, n: int) -> np.ndarray:
    """About the root of n of the vectors x, by hash, in an order that keeps near ones together."""
    few = points.select("x").orderBy(F.xxhash64("x"), "x").limit(max(1, min(MOST_PIVOTS, math.isqrt(n)))).toArrow()
    x = _rows(few.column("x").combine_chunks())

    def halves(rows: np.ndarray) -> np.ndarray:
        if len(rows) < 2:
            return rows
        rows = rows[x[rows, np.ptp(x[rows], axis=0).argmax()].argsort(kind="stable")]
        return np.concatenate([halves(rows[: len(rows) // 2]), halves(rows[len(rows) // 2 :])])

    return x[halves(np.arange(len(x)))]


def homes(points: DataFrame, pivots: np.ndarray) -> DataFrame:
    """points with the number of their nearest pivot, `cell`, and the distance to it, `far`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _rows(batch.column("x"))
            cell = ((pivots**2).sum(axis=1)[None] - 2 * x @ pivots.T).argmin(axis=1) if len(x) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(paired_distances(x, pivots, np.arange(len(x)), cell) if len(x) else np.zeros(0))], [*batch.schema.names, "cell", "far"])

    return points.mapInArrow(run, ", ".join([f"`{c}` {t}" for c, t in points.dtypes] + ["cell long", "far double"]))


def packed(placed: DataFrame, columns: Sequence[str], size: int, parts: int) -> DataFrame:
    """Rows of about `size` points that lie near each other, written: block (its number), centre, radius, x (bytes of doubles), and an array of each column. placed: x, cell, columns."""
    kinds = dict(placed.dtypes)

    def one(block: int, held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        x = _rows(table.column("x").combine_chunks())
        centre = x.mean(axis=0)
        radius = float(np.sqrt(((x - centre) ** 2).sum(axis=1)).max())
        lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), table.column(c).combine_chunks()) for c in columns]
        return pa.RecordBatch.from_arrays([pa.array([block]), pa.array([centre.tolist()], pa.list_(pa.float64())), pa.array([radius]), pa.array([x.tobytes()]), *lists], ["block", "centre", "radius", "x", *columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, block = [], 0, TaskContext.get().partitionId() << 32
        for batch in batches:
            while batch.num_rows:
                held.append(batch.slice(0, size - n))
                batch = batch.slice(size - n)
                n += held[-1].num_rows
                if n == size:
                    yield one(block, held)
                    held, n, block = [], 0, block + 1
        if held:
            yield one(block, held)

    dealt = placed.select("cell", "x", *columns).repartitionByRange(parts, "cell", F.xxhash64("x"), *columns).sortWithinPartitions("cell")
    kind = ", ".join(["block long", "centre array<double>", "radius double", "x binary", *(f"`{c}` array<{kinds[c]}>" for c in columns)])
    return written(dealt.mapInArrow(run, kind), "blocks")


def parts_of(df: DataFrame, n: int, size: int) -> int:
    """Partitions for n points in blocks of `size`: three a core at most."""
    return max(1, min(3 * df.sparkSession.sparkContext.defaultParallelism, -(-n // size)))


def meeting(asking: DataFrame, held: DataFrame, within: Column, bytes_: int, run: Callable, kind: str) -> DataFrame:
    """`run` over all pairs of a block of asking and one of held (its columns with `its_` before them) that may hold points within `within` of each other; those of an asking
    block in a row. held, of about bytes_ in all, is passed over in parts of about PASSED, so an asking block comes once in each part's tasks."""
    its = held.select(*[F.col(c).alias(f"its_{c}") for c in held.columns]).coalesce(max(1, -(-bytes_ // PASSED)))
    gap = F.sqrt(F.aggregate(F.zip_with("centre", "its_centre", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)) - F.col("radius") - F.col("its_radius")
    return asking.crossJoin(its.hint("shuffle_replicate_nl")).where((gap <= within * (1 + 1e-9) + 1e-9)).mapInArrow(run, kind)


def values(batch: pa.RecordBatch, column: str, i: int) -> np.ndarray:
    """The array in row i."""
    v = batch.column(column)[i].values
    return v.to_numpy(zero_copy_only=False) if pa.types.is_primitive(v.type) else np.array(v.to_pylist())


def vectors(batch: pa.RecordBatch, column: str, i: int, n: int) -> np.ndarray:
    return np.frombuffer(batch.column(column)[i].as_buffer(), float).reshape(n, -1)


def _meet(k: int, label_type: pa.DataType) -> Callable:
    """The k nearest of each asking point among the blocks that it meets in a task; of equal distances the first label's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, top = None, None, None

        def found() -> pa.RecordBatch:
            row, d, label, w = top
            return pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(d), pa.array(label, label_type), pa.array(w)], ["ask", "d", "label", "w"])

        for batch in batches:
            for i in range(batch.num_rows):
                if (block := batch.column("block")[i].as_py()) != at:
                    if top is not None:
                        yield found()
                    at, ids, top = block, values(batch, "ask", i), None
                    x, centre = vectors(batch, "x", i, len(ids)), np.array(batch.column("centre")[i].as_py())
                    bound = np.full(len(ids), batch.column("reach")[i].as_py() * (1 + 1e-9) + 1e-9)
                labels, weights = values(batch, "its_label", i), values(batch, "its_w", i)
                y = vectors(batch, "its_x", i, len(labels))
                square, off = squares(x, y, centre)
                limit = bound**2
                if top is None and len(y) > k:
                    limit = np.minimum(limit, np.partition(square, k - 1, axis=1)[:, k - 1] + off)
                row, p = np.nonzero(square <= (limit * (1 + 1e-9) + 2 * off)[:, None])
                new = (row, paired_distances(x, y, row, p), labels[p], weights[p])
                row, d, label, w = new if top is None else (np.concatenate(v) for v in zip(top, new, strict=True))
                order = np.lexsort((label, d, row))
                n = np.bincount(row, minlength=len(ids))
                order = order[np.arange(len(order)) - np.repeat(np.cumsum(n) - n, n) < k]
                top = row[order], d[order], label[order], w[order]
                last = np.cumsum(np.minimum(n, k)) - 1
                bound = np.where(n >= k, np.minimum(bound, top[1][np.maximum(last, 0)] if len(order) else np.inf), bound)
        if top is not None:
            yield found()

    return run


def nearest_points(asked: DataFrame, points: DataFrame, k: int) -> DataFrame:
    """x, d, label, w for each distinct asked x: points that hold its k nearest by weight: the k nearest rows.

    asked: x, distinct arrays of doubles; points: x, label (neither null), w (a whole weight of 1 or more). Points lie in cells of their nearest pivot
    (about the root of the number of points). Each cell has a radius and a weight, so an asked point knows a distance within which k of weight lie for certain. Blocks of asked
    points meet those blocks of points that reach into it; products of matrices tell which distances matter, and those are computed from differences.
    Equal distances come by label. No points give no rows.
    """
    kind = dict(points.dtypes)["label"]
    n = points.count()
    if not n:
        return asked.sparkSession.createDataFrame([], f"x array<double>, d double, label {kind}, w long")
    pivots = pivots_of(points, n)
    placed = homes(points.select("x", "label", F.col("w").cast("long").alias("w")), pivots)
    radius, weight = np.full(len(pivots), -np.inf), np.zeros(len(pivots))
    for r in placed.groupBy("cell").agg(F.max("far").alias("far"), F.sum("w").alias("w")).collect():  # a row a pivot
        radius[r["cell"]], weight[r["cell"]] = r["far"], r["w"]

    def reaches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            square, off = squares(_rows(batch.column("x")), pivots, pivots[0])
            within = np.where(weight > 0, np.sqrt(np.maximum(square + off, 0)) + radius, np.inf)  # all of a cell lies within this
            order = within.argsort(axis=1)
            enough = np.minimum((np.cumsum(weight[order], axis=1) < k).sum(axis=1), len(pivots) - 1)
            reach = np.take_along_axis(within, np.take_along_axis(order, enough[:, None], 1), 1)[:, 0]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.where(weight.sum() < k, np.inf, reach))], [*batch.schema.names, "reach"])

    asked = written(asked.select(F.monotonically_increasing_id().alias("ask"), "x"), "asked")
    many = asked.count()
    reaching = homes(asked, pivots).select("ask", "x", "cell").mapInArrow(reaches, "ask long, x array<double>, cell long, reach double")
    asking = packed(reaching, ["ask", "reach"], ASKING, parts_of(asked, many, ASKING)).withColumn("reach", F.array_max("reach"))
    held = packed(placed, ["label", "w"], BLOCK, parts_of(points, n, BLOCK)).select("centre", "radius", "x", "label", "w")
    label_type = asked.sparkSession.createDataFrame([], f"label {kind}").toArrow().schema.field("label").type
    near = meeting(asking, held, F.col("reach"), 8 * n * pivots.shape[1], _meet(k, label_type), f"ask long, d double, label {kind}, w long")
    rank = fresh("rank")
    near = near.withColumn(rank, F.expr("row_number() over (partition by ask order by d, label)")).where(F.col(rank) <= k)
    return near.join(asked, "ask").select("x", "d", "label", "w")
