"""Gradient boosting for several classes with early stopping.

Each round grows one tree whose leaves hold a value for every class, so that all classes are fitted jointly to the softmax loss. Features are binned once. For each
level of a tree every task adds up gradients and curvatures of its rows by node, feature and bin; these histograms, whose size doesn't depend
on the rows, are added up over all tasks and decide the splits. The pass of a tree's first level also gives the loss of the trees before it, on both parts; when that of the
validation part hasn't fallen for `patience` rounds, boosting ends and the trees after the best round are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldglass.operators.shared import written

#: Bins of a feature, rows that a task holds at once, and what is added to a curvature.
BINS, ROWS, RIDGE = 32, 4096, 1.0


@dataclass
class Tree:
    """Nodes in level order: the feature and the last bin that goes left (-1: a leaf), and the values of a leaf; children of node i are 2i+1 and 2i+2."""

    feature: np.ndarray
    bin: np.ndarray
    value: np.ndarray

    def leaves(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        while (inner := self.feature[at] >= 0).any():
            rows = np.flatnonzero(inner)
            own = at[rows]
            at[rows] = 2 * own + 1 + (x[rows, self.feature[own]] > self.bin[own])
        return at


@dataclass
class Booster:
    edges: np.ndarray
    classes: list
    start: np.ndarray
    rate: float
    trees: list[Tree] = field(default_factory=list)
    #: round, loss of the training part, loss of the validation part, with the trees up to that round
    log: list[tuple[int, float, float]] = field(default_factory=list)
    best: int = 0

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, c) for e, c in zip(self.edges, x.T, strict=True)], axis=1).astype(np.uint8)

    def scores(self, x: np.ndarray, trees: list[Tree]) -> np.ndarray:
        out = np.tile(self.start, (len(x), 1))
        for tree in trees:
            out += self.rate * tree.value[tree.leaves(x)]
        return out

    def transform(self, df: DataFrame, features: str, into: str = "prediction", probabilities: str = "probabilities") -> DataFrame:
        """df with the likeliest class (of equal ones the first) and the probabilities of all, in the order of `classes`; a null vector has null ones."""
        me, trees = self, self.trees[: self.best]

        @F.pandas_udf("array<double>")
        def likely(vectors):
            x = me.binned(np.stack(vectors.to_numpy()).astype(float)) if len(vectors) else np.zeros((0, 1))
            return pd.Series(list(_softmax(me.scores(x, trees))))

        found = df.where(F.col(features).isNotNull()).withColumn(probabilities, likely(F.col(features).cast("array<double>")))
        place = (F.array_position(F.col(probabilities), F.array_max(probabilities)) - 1).cast("int")
        found = found.withColumn(into, F.array(*map(F.lit, self.classes))[place])
        return found.unionByName(df.where(F.col(features).isNull()), allowMissingColumns=True)


def _softmax(s: np.ndarray) -> np.ndarray:
    e = np.exp(s - s.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _read(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            x = np.frombuffer(b"".join(part.column("x").to_pylist()), np.uint8).reshape(-1, d)
            yield x, part.column("y").to_numpy(), part.column("valid").to_numpy(zero_copy_only=False)


def _histograms(model: Booster, tree: Tree, level: int, d: int):
    """i, row: sums by node and feature (rows 2 * BINS * classes long: gradients, then curvatures) for the nodes of a level; -1: losses and counts of both parts."""
    first, nodes, k = 2**level - 1, 2**level, len(model.classes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, losses = np.zeros((nodes, d, BINS, 2 * k)), np.zeros(4)
        for x, y, valid in _read(batches, d):
            p = _softmax(model.scores(x, model.trees))
            loss = -np.log(np.maximum(p[np.arange(len(y)), y], 1e-15))
            losses += [loss[~valid].sum(), (~valid).sum(), loss[valid].sum(), valid.sum()]
            rows = np.flatnonzero(~valid)
            at = tree.leaves(x[rows]) - first
            rows, at = rows[at >= 0], at[at >= 0]
            g = -p[rows]
            g[np.arange(len(rows)), y[rows]] += 1
            both = np.concatenate([g, p[rows] * (1 - p[rows])], axis=1)
            for f in range(d):
                np.add.at(total[:, f], (at, x[rows, f]), both)
        table = total.reshape(nodes * d, -1)
        live = np.flatnonzero(table.any(axis=1))
        out = [(-1, losses.tolist()), *((int(i), table[i].tolist()) for i in live)]
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in out], pa.int32()), pa.array([r for _, r in out], pa.list_(pa.float64()))], ["i", "row"])

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for i, row in zip(batch.column("i").to_pylist(), batch.column("row"), strict=True):
            total[i] = row.values.to_numpy() + total.get(i, 0)
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([r.tolist() for r in total.values()], pa.list_(pa.float64()))], ["i", "row"])


def _level(data: DataFrame, model: Booster, tree: Tree, level: int, d: int) -> tuple[np.ndarray, np.ndarray]:
    kind, k = "i int, row array<double>", len(model.classes)
    sums, losses = np.zeros((2**level * d, BINS * 2 * k)), np.zeros(4)
    for r in data.mapInArrow(_histograms(model, tree, level, d), kind).repartition("i").mapInArrow(_added, kind).collect():  # nodes x features rows
        if r["i"] < 0:
            losses = np.array(r["row"])
        else:
            sums[r["i"]] = r["row"]
    return sums.reshape(2**level, d, BINS, 2, k), losses


def _split(tree: Tree, level: int, sums: np.ndarray, deepest: bool) -> None:
    """Gives the nodes of a level their best split (of equal ones the first feature and bin) and, where none gains, their values; children get values too."""
    k = sums.shape[-1]
    worth = lambda s: (s[..., 0, :] ** 2 / (s[..., 1, :] + RIDGE)).sum(axis=-1)
    value = lambda s: (k - 1) / k * s[0] / (s[1] + RIDGE)
    for n in range(2**level):
        at, own = 2**level - 1 + n, sums[n]
        whole = own[0].sum(axis=0)
        if not whole.any():
            continue
        tree.value[at] = value(whole)
        left = np.cumsum(own, axis=1)[:, :-1]
        gain = worth(left) + worth(whole[None, None] - left) - worth(whole)
        f, b = np.unravel_index(int(gain.argmax()), gain.shape)
        if deepest or gain[f, b] <= 1e-9:
            continue
        tree.feature[at], tree.bin[at] = f, b
        tree.value[2 * at + 1], tree.value[2 * at + 2] = value(left[f, b]), value(whole - left[f, b])


def boosted(df: DataFrame, features: str, label: str, valid: Column, rounds: int = 100, depth: int = 3, rate: float = 0.3, patience: int = 5) -> Booster:
    """A model fitted on the rows where `valid` is false, with as many rounds as are best for those where it is true (all `rounds`, if there are none).

    Rows with a null label or vector are left out. Bins are cut at approximate quantiles of the training part. Classes are the labels of the training part,
    in order; validation rows with another label are left out.
    """
    kept = df.where(F.col(features).isNotNull() & F.col(label).isNotNull()).select(F.col(features).cast("array<double>").alias("v"), F.col(label).alias("y"), F.coalesce(valid, F.lit(False)).alias("valid"))
    kept = written(kept, "boosting")
    counts = {r["y"]: r["count"] for r in kept.where("not valid").groupBy("y").count().collect()}  # a row a class
    if not counts:
        raise ValueError("no rows to train on")
    classes = sorted(counts)
    at = [k / BINS for k in range(1, BINS)]
    cuts = kept.where("not valid").select(F.posexplode("v").alias("d", "x")).groupBy("d").agg(F.percentile_approx("x", at, 10_000).alias("q")).orderBy("d").collect()
    model = Booster(np.array([r["q"] for r in cuts]), classes, np.log(np.array([counts[c] for c in classes]) / sum(counts.values())), rate)
    place = F.create_map(*[F.lit(v) for k, c in enumerate(classes) for v in (c, k)])[F.col("y")]

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = model.binned(np.asarray(batch.column("v").flatten()).reshape(batch.num_rows, -1)) if batch.num_rows else np.zeros((0, 1), np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary()), batch.column("y"), batch.column("valid")], ["x", "y", "valid"])

    data = written(kept.withColumn("y", place.cast("long")).where("y is not null").mapInArrow(packed, "x binary, y long, valid boolean"), "binned")
    d, size = len(cuts), 2 ** (depth + 1) - 1
    while True:
        tree = Tree(np.full(size, -1, np.int64), np.zeros(size, np.int64), np.zeros((size, len(classes))))
        sums, losses = _level(data, model, tree, 0, d)
        mean = lambda s, n: float(s / n) if n else float("nan")
        model.log.append((len(model.trees), mean(*losses[:2]), mean(*losses[2:])))
        if losses[3]:
            model.best = min(model.log, key=lambda r: (r[2], r[0]))[0]
            if len(model.trees) - model.best >= patience:
                return model
        else:
            model.best = len(model.trees)
        if len(model.trees) == rounds:
            return model
        for level in range(depth):
            if level:
                sums, _ = _level(data, model, tree, level, d)
            _split(tree, level, sums, deepest=False)
        model.trees.append(tree)
