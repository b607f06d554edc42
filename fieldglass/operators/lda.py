"""Latent Dirichlet allocation by online variational Bayes over the whole corpus: in each pass every document with words is in one batch, and every word of every document counts.

A word's number is its place among all words, so neither the numbers nor the first topics depend on how rows lie. The topics (a number a word and topic) are held by the driver and sent to all tasks
for each batch; texts and their topics stay on executors.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldglass.operators.shared import shared_dir, written
from fieldglass.operators.topics import terms, with_facts

#: Rounds of a document's inference at most, the change at which it ends, and the word counts that a task infers from at once.
INNER, STILL, AT_ONCE = 50, 1e-3, 1 << 18


def counted(df: DataFrame, id_col: str, text: str, batches: int, seed: int = 7) -> tuple[DataFrame, int]:
    """id, terms (numbers, ascending), counts, batch (by hash of the id) for each text with words, written by batch; and the number of distinct words."""
    spark = df.sparkSession
    tf = terms(df.select(id_col, text).repartition(id_col), [id_col], text).groupBy(id_col, "term").agg(F.count("*").cast("double").alias("n"))
    tf = written(tf, "terms")
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    words = tf.groupBy("term").agg(F.count("*").alias("df")).orderBy("term").select("term", "df", F.spark_partition_id().alias("part"), place.alias("place"))
    words = written(words, "words")
    sizes = sorted((r["part"], r["n"]) for r in words.groupBy("part").agg(F.count("*").alias("n")).collect())  # a row a partition
    before = np.cumsum([0, *(n for _, n in sizes)])
    first = F.create_map(*[F.lit(x) for (part, _), n in zip(sizes, before.tolist()[:-1], strict=True) for x in (part, n)]) if sizes else F.create_map(F.lit(0), F.lit(0))
    numbers = written(words.select("term", "df", (F.col("place") + first[F.col("part")]).cast("int").alias("number")), "numbers")
    pairs = F.array_sort(F.collect_list(F.struct("number", "n")))
    each = with_facts(tf, numbers, ["term"], "df").groupBy(F.col(id_col).alias("id")).agg(pairs.alias("pairs"))
    batch = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(batches)).cast("int")
    path = f"{shared_dir(spark)}/counts-{uuid.uuid4().hex}"
    rows = each.select("id", F.col("pairs.number").alias("terms"), F.col("pairs.n").alias("counts"), batch.alias("batch"))
    rows.write.partitionBy("batch").parquet(path)
    return spark.read.schema(rows.schema).parquet(path), int(before[-1])


def _digamma(x: np.ndarray) -> np.ndarray:
    out, x = np.zeros_like(x), x.copy()
    for _ in range(6):
        out -= 1 / x
        x += 1
    r = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - r * (1 / 12 - r * (1 / 120 - r * (1 / 252 - r * (1 / 240 - r / 132))))


def expected(a: np.ndarray) -> np.ndarray:
    """exp of the mean of log p for p of a Dirichlet distribution; a row each."""
    return np.exp(_digamma(a) - _digamma(a.sum(axis=1, keepdims=True)))


def infer(size: np.ndarray, term: np.ndarray, count: np.ndarray, beta: np.ndarray, alpha: float) -> np.ndarray:
    """The parameters of each document's topics. size: distinct words of each; term, count: one after another; beta: `expected` topics, a row a word."""
    # a row a topic: all of numpy's loops run along the words
    gamma, live, b = np.ones((len(size), beta.shape[1])), np.arange(len(size)), np.ascontiguousarray(beta[term].T)
    for _ in range(INNER):
        start = np.cumsum(size) - size
        theta = expected(gamma[live])
        norm = np.full(len(count), 1e-100)
        for i, of in enumerate(b):
            norm += np.repeat(theta[:, i], size) * of
        weight = count / norm
        new = alpha + theta * np.stack([np.add.reduceat(of * weight, start) for of in b], axis=1)
        moving = np.abs(new - gamma[live]).mean(axis=1) >= STILL
        gamma[live] = new
        if not moving.any():
            break
        if moving.sum() * 2 < len(live):
            kept = np.repeat(moving, size)
            b, count, size, live = b[:, kept], count[kept], size[moving], live[moving]
    return gamma


def _documents(batch: pa.RecordBatch) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
    """Some documents after another: which, and the size, terms and counts of them."""
    terms_, counts = batch.column("terms"), batch.column("counts")
    end = np.asarray(terms_.offsets)[1:] - terms_.offsets[0].as_py()
    term, count = terms_.flatten().to_numpy(), counts.flatten().to_numpy()
    size = np.diff(end, prepend=0)
    at = 0
    while at < len(size):
        begin = end[at] - size[at]
        to = max(at + 1, int(np.searchsorted(end, begin + AT_ONCE, "right")))
        yield slice(at, to), size[at:to], term[begin : end[to - 1]], count[begin : end[to - 1]]
        at = to


def fitted(rows: DataFrame, words: int, k: int, passes: int = 1, seed: int = 7) -> np.ndarray:
    """The topics: a row for each of k, a weight for each word. rows, words: of `counted`. Step t counts (1 + t) ** -0.5, so the first one replaces the random start."""
    context = rows.sparkSession.sparkContext
    prior = 1 / k
    topics = np.random.default_rng(seed).gamma(100, 0.01, (k, words))
    many = dict(rows.groupBy("batch").agg(F.count("*")).collect())  # a row a batch
    full = sorted(many)
    sums = [f"s{i}" for i in range(k)]
    for step in range(passes * len(full)):
        batch = full[step % len(full)]
        beta = np.ascontiguousarray(expected(topics).T)
        sent = context.broadcast(beta)

        def run(found: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            beta = sent.value
            total, seen = np.zeros((k, len(beta))), np.zeros(len(beta), bool)
            for rows_ in found:
                for _, size, term, count in _documents(rows_):
                    theta = expected(infer(size, term, count, beta, prior))
                    parts = [np.repeat(v, size) for v in theta.T]
                    weight = count / (sum(v * beta[term, i] for i, v in enumerate(parts)) + 1e-100)
                    seen[term] = True
                    for i, v in enumerate(parts):
                        np.add.at(total[i], term, v * weight)
            own = np.flatnonzero(seen)
            for at in range(0, len(own), AT_ONCE):
                n = own[at : at + AT_ONCE]
                yield pa.RecordBatch.from_arrays([pa.array(n), *(pa.array(s[n]) for s in total)], ["n", *sums])

        found = rows.where(F.col("batch") == batch).select("terms", "counts").mapInArrow(run, ", ".join(["n long", *(f"{s} double" for s in sums)]))
        table = found.groupBy("n").agg(*(F.sum(s).alias(s) for s in sums)).toArrow()  # a row a word of the batch
        new = np.full((k, words), prior)
        at = table.column("n").to_numpy()
        for i, s in enumerate(sums):
            new[i, at] += sum(many.values()) / many[batch] * table.column(s).to_numpy() * beta[at, i]
        sent.destroy()
        rate = (1 + step) ** -0.5
        topics = (1 - rate) * topics + rate * new
    return topics


def shares(rows: DataFrame, topics: np.ndarray) -> DataFrame:
    """id, shares: of each topic in each document of `counted`, sum 1."""
    sent = rows.sparkSession.sparkContext.broadcast(np.ascontiguousarray(expected(topics).T))

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            for at, size, term, count in _documents(batch):
                gamma = infer(size, term, count, sent.value, 1 / sent.value.shape[1])
                yield pa.RecordBatch.from_arrays([batch.column("id")[at], pa.array((gamma / gamma.sum(axis=1, keepdims=True)).tolist(), pa.list_(pa.float64()))], ["id", "shares"])

    return rows.select("id", "terms", "counts").mapInArrow(run, f"id {dict(rows.dtypes)['id']}, shares array<double>")
