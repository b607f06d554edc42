"""Languages by naive Bayes over hashed runs of bytes.

A text is its lower-cased UTF-8 bytes between two spaces; each run of WIDTH bytes falls into one of SLOTS slots. Tasks count slots by language,
so the model is languages x SLOTS numbers at any size of the corpus, and each text is scored in one pass.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of a run, slots, and languages at most.
WIDTH, SLOTS, MOST = 3, 1 << 16, 200


def slots(text: str | None) -> np.ndarray:
    """The slot of each run of WIDTH bytes of a text, in order."""
    b = np.frombuffer(b" " + (text or "").lower().encode() + b" ", np.uint8).astype(np.uint64)
    h = np.zeros(max(0, len(b) - WIDTH + 1), np.uint64)
    for k in range(WIDTH):
        h = h * np.uint64(257) + b[k : k + len(h)]
    return ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.int64) % SLOTS


@dataclass
class Languages:
    """Names in order, log prior of each, and log probability of each slot in each (a row a language)."""

    names: list[str]
    prior: np.ndarray
    table: np.ndarray

    def scores(self, text: str | None) -> np.ndarray:
        return self.prior + self.table[:, slots(text)].sum(axis=1)

    def detect(self, df: DataFrame, text: str, into: str = "language", share: str = "probability") -> DataFrame:
        """df with the likeliest language (of equal ones the first name) and its probability; a text without letters or null has neither."""
        names, scores, kind = self.names, self.scores, "language string, probability double"

        @F.pandas_udf(kind)
        def likely(texts):
            out = []
            for x in texts:
                s = scores(x)
                at = int(s.argmax())
                out.append((names[at], float(1 / np.exp(s - s[at]).sum())))
            return pd.DataFrame(out, columns=["language", "probability"])

        known = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
        found = df.withColumn(into, F.when(known, likely(F.coalesce(text, F.lit("")))))
        return found.withColumn(share, F.col(f"{into}.probability")).withColumn(into, F.col(f"{into}.language"))


def learned(df: DataFrame, text: str, language: str, where: Column | None = None) -> Languages:
    """A model of the rows with a language and a text: add-one smoothing of slot counts, priors by rows."""
    rows = df.where((F.lit(True) if where is None else where) & F.col(language).isNotNull() & F.col(text).isNotNull()).select(F.col(language).alias("language"), F.col(text).alias("text"))
    counts = {r["language"]: r["count"] for r in rows.groupBy("language").count().limit(MOST + 1).collect()}
    if not 0 < len(counts) <= MOST:
        raise ValueError(f"{len(counts)} languages")
    names = sorted(counts)
    place = {name: k for k, name in enumerate(names)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(names), SLOTS), np.int64)
        for batch in batches:
            for name, own in zip(batch.column("language").to_pylist(), batch.column("text").to_pylist(), strict=True):
                total[place[name]] += np.bincount(slots(own), minlength=SLOTS)
        at, slot = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(slot.astype(np.int32)), pa.array(total[at, slot])], ["language", "slot", "n"])

    sums = rows.mapInArrow(count, "language int, slot int, n long").groupBy("language", "slot").agg(F.sum("n").alias("n")).toArrow()  # languages x SLOTS rows at most
    table = np.ones((len(names), SLOTS))
    table[sums.column("language").to_numpy(), sums.column("slot").to_numpy()] += sums.column("n").to_numpy()
    all_rows = np.array([counts[x] for x in names], float)
    return Languages(names, np.log(all_rows / all_rows.sum()), np.log(table / table.sum(axis=1, keepdims=True)))
