"""Document quality by a regularised quadratic discriminant.

Statistics of the whole text (counts of byte kinds and words) are transformed to be near normal. Each class has a mean and a covariance,
shrunk towards the pooled one and to a multiple of the identity; its Cholesky factor is computed once and cached in the model. The score is the logistic
of the difference of the classes' log densities and log priors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldglass.llm.common import bucket_of, flat, pieces, staged, word_hashes, words

#: Shrinkage to the pooled covariance, ridge as a share of the mean variance, and about how many labelled rows are fitted on (chosen by hash of the id).
SHRINK, RIDGE, FIT_ROWS, CUT = 0.1, 0.02, 500_000, 0.3
STATISTICS = ("words", "word_length", "length_spread", "upper", "mark_ends", "repeats", "distinct", "bars", "shouts", "digits", "spaces", "wide", "stops", "lines")

_KIND = np.zeros((8, 256), bool)  # upper, lower or wide, bar, exclamation, digit, space, wide, stop
_KIND[0, 65:91] = True
_KIND[1, 97:123] = _KIND[1, 128:] = True
_KIND[2, ord("|")] = _KIND[3, ord("!")] = True
_KIND[4, 48:58] = True
_KIND[5, [9, 10, 11, 12, 13, 32]] = True
_KIND[6, 128:] = True
_KIND[7, [ord(c) for c in ".,;:?"]] = True
_MARK = np.zeros(256, bool)
_MARK[33:127] = True
_MARK[48:58] = _MARK[65:91] = _MARK[97:123] = False
_MARK[[ord(c) for c in ".,;:?'\")"]] = False


def statistics(column: pa.Array) -> np.ndarray:
    """A row of transformed statistics for each text; nulls and empty texts have all counts 0."""
    data, offsets = flat(column)
    n = len(column)
    full = np.flatnonzero(np.diff(offsets))
    kinds = np.zeros((9, n))
    if len(data):
        for k in range(8):
            kinds[k, full] = np.add.reduceat(_KIND[k][data].view(np.uint8), offsets[full], dtype=np.int64)
        kinds[8, full] = np.add.reduceat((data == 10).view(np.uint8), offsets[full], dtype=np.int64)
    size = np.diff(offsets)
    starts, lengths, rows = words(data, offsets)
    count = np.bincount(rows, minlength=n).astype(float)
    if len(starts):
        h = word_hashes(data, starts, lengths)
        total, squares = np.bincount(rows, lengths, n), np.bincount(rows, lengths.astype(float) ** 2, n)
        marks = np.bincount(rows, _MARK[data[starts + lengths - 1]], n)
        same = np.zeros(len(h))
        same[1:] = (h[1:] == h[:-1]) & (rows[1:] == rows[:-1])
        repeats = np.bincount(rows, same, n)
        keys = np.unique((rows.astype(np.uint64) << np.uint64(44)) | (h >> np.uint64(20)))
        distinct = np.bincount((keys >> np.uint64(44)).astype(np.int64), minlength=n).astype(float)
    else:
        total = squares = marks = repeats = distinct = np.zeros(n)
    some, chars, letters = np.maximum(count, 1), np.maximum(size, 1), np.maximum(kinds[0] + kinds[1], 1)
    mean = total / some
    share = lambda x, of: np.arcsin(np.sqrt(np.clip(x / of, 0, 1)))
    return np.column_stack([
        np.log1p(count), np.log1p(mean), np.log1p(np.sqrt(np.maximum(squares / some - mean**2, 0))), share(kinds[0], letters), share(marks, some), share(repeats, some), np.log1p(count) - np.log1p(distinct),
        share(kinds[2], some), share(kinds[3], some), share(kinds[4], chars), share(kinds[5], chars), share(kinds[6], chars), share(kinds[7], some), share(kinds[8], some),
    ])


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "text"):
        x = statistics(batch.column("text"))
        values = pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), x.ravel())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), values], ["doc_id", "held_out", "x"])


@dataclass
class Discriminant:
    """Means, inverse Cholesky factors and log constants of class 0 and class 1."""

    means: list[np.ndarray]
    factors: list[np.ndarray]
    constants: list[float]

    def score(self, x: np.ndarray) -> np.ndarray:
        log = [c - 0.5 * (((x - m) @ f.T) ** 2).sum(axis=1) for m, f, c in zip(self.means, self.factors, self.constants, strict=True)]
        return 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))


def fitted(moments: dict[int, tuple[float, np.ndarray, np.ndarray]], shrink: float = SHRINK, ridge: float = RIDGE) -> Discriminant | float:
    """From count, sum and sum of outer products of each class. A class without rows: the share of class 1 instead (0.5 without any rows)."""
    rows = sum(m[0] for m in moments.values())
    if len(moments) < 2:
        return float(next(iter(moments), 0.5))
    means = [moments[k][1] / moments[k][0] for k in (0, 1)]
    spreads = [moments[k][2] / moments[k][0] - np.outer(means[k], means[k]) for k in (0, 1)]
    pooled = sum(moments[k][0] / rows * spreads[k] for k in (0, 1))
    factors, constants = [], []
    for k in (0, 1):
        spread = (1 - shrink) * spreads[k] + shrink * pooled
        spread = spread + ridge * (np.trace(spread) / len(spread) + 1e-9) * np.eye(len(spread))
        lower = np.linalg.cholesky(spread)
        factors.append(np.linalg.inv(lower))
        constants.append(float(np.log(moments[k][0] / rows) - np.log(np.diag(lower)).sum()))
    return Discriminant(means, factors, constants)


def one_label(labels: DataFrame, label: str, most_rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, y: the training labels, one for each id (the mean of repeated ones, 1 from a half up); rows whose bucket is 0, null labels and null ids don't count.

    Beyond most_rows, a sample of about that many, chosen by hash of the id.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).alias("y")).where("doc_id is not null and y is not null")
    known = known.where(bucket_of("doc_id", 5) != 0)
    n = known.count()
    if n > most_rows:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1e6 * most_rows / n))
    return known.groupBy("doc_id").agg(F.when(F.avg("y") >= 0.5, 1).otherwise(0).alias("y"))


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), (bucket_of(id_col, 5) == 0).alias("held_out"), F.col(text_col).alias("text"))
    return staged(source.mapInArrow(_measure, "doc_id long, held_out boolean, x array<double>"), "statistics")


def trained(x: DataFrame, y: DataFrame) -> Discriminant | float:
    d = len(STATISTICS)
    both = x.join(y, "doc_id").select("y", "x")
    outer = F.expr(f"flatten(array(array(1D), x, flatten(transform(sequence(0, {d - 1}), i -> transform(x, v -> v * x[i])))))")
    sums = both.select("y", F.posexplode(outer).alias("at", "v")).groupBy("y", "at").agg(F.sum("v").alias("v")).collect()  # 2 * (1 + d + d * d) rows
    moments: dict[int, np.ndarray] = {}
    for r in sums:
        moments.setdefault(r["y"], np.zeros(1 + d + d * d))[r["at"]] = r["v"]
    return fitted({k: (v[0], v[1 : d + 1], v[d + 1 :].reshape(d, d)) for k, v in moments.items()})


def quality_scores(docs: DataFrame, labels: DataFrame, cut: float = CUT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs.

    Null and empty texts are scored as texts of no words. Rows with a null id are scored but never trained on. Repeated rows get equal
    scores. Without labels of both classes every score is the share of class 1 among them (0.5 without any). Other columns play no part.
    """
    x = measured(docs, id_col, text_col)
    model = trained(x, one_label(labels, "quality"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array(batch.column("x").flatten()).reshape(batch.num_rows, -1)
            s = np.full(batch.num_rows, model) if isinstance(model, float) else model.score(values)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(s), pa.array((s >= cut).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return x.mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int")


def good_only(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """The rows of docs, in all their columns, that score `cut` or more. Null and empty texts are judged as texts of no words, repeated rows alike."""
    y = one_label(labels, "quality")
    model = trained(measured(docs.join(y.select("doc_id"), "doc_id", "left_semi")), y)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            s = np.full(batch.num_rows, model) if isinstance(model, float) else model.score(statistics(batch.column("text")))
            yield batch.filter(pa.array(s >= cut))

    return docs.mapInArrow(keep, docs.schema)
