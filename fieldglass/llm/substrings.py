"""Exact removal of repeated passages by level-wise doubling of windows of words.

Whole copies of a text collapse first: all but the first lose every word that a window covers. The distinct texts are numbered in the order that decides
which occurrence is the earlier one. Then windows grow from a quarter of the final width:

1. Of the windows of 5 words, those that are least by hash in some window of 20 words are counted. Two equal windows of 20 have the same least
   one at the same place, so nothing is lost, and about one position in nine is moved.
2. Windows that repeat are extended to 10 words, inside each window of 20 whose least one they are, and counted again. One that occurs once alone ends here.
3. Those that repeat are extended to 20 words. The first occurrence of each is looked up, and all later ones are removed.

The extension ends early when a level leaves no candidates. Windows of 5 and 10 words are compared by 64-bit hashes, which can only add candidates;
windows of 20 words by 128 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldglass.llm.common import by_weight, discarded, flat, mixed, pieces, staged, to_all, word_hashes, words

WIDTH = 20
_AS_IS = np.arange(256, dtype=np.uint8)
_FACTORS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB))


def rolled(h: np.ndarray, width: int, factor: np.uint64) -> np.ndarray:
    """A hash of each run of `width` word hashes: of half the width at either end, where it is even."""
    if width == 1:
        return h
    half = width // 2
    left = rolled(h, half, factor)
    n = max(0, len(h) - width + 1)
    out = mixed(left[:n] * factor + left[half : half + n])
    return mixed(out * factor + h[width - 1 : width - 1 + n]) if width % 2 else out


def least_places(h: np.ndarray, span: int) -> np.ndarray:
    """For each run of `span` values the place of its least, the first if several are."""
    at = np.arange(len(h))
    width = 1
    while width < span:
        step = min(width, span - width)
        n = len(at) - step
        left, right = at[:n], at[step : step + n]
        at = np.where(h[left] <= h[right], left, right)
        width += step
    return at[: max(0, len(h) - span + 1)]


class _Texts:
    """The words of a batch of texts: row of each word, hashes, and for each window of `width` words inside a text its start and the place of its least part."""

    def __init__(self, column: pa.Array, width: int) -> None:
        self.data, self.offsets = flat(column)
        self.starts, self.lengths, self.rows = words(self.data, self.offsets)
        self.h = word_hashes(self.data, self.starts, self.lengths, fold=_AS_IS)
        self.part = width // 4
        self.parts = rolled(self.h, self.part, _FACTORS[0])
        n = max(0, len(self.h) - width + 1)
        self.windows = np.flatnonzero(self.rows[:n] == self.rows[width - 1 : width - 1 + n])
        self.least = least_places(self.parts, width - self.part + 1)[self.windows]
        self.first = np.searchsorted(self.rows, np.arange(len(column)))  # number of the first word of each text


def _longs(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of each text, and the digest of all of them joined by spaces."""
    for batch in pieces(batches, "text"):
        counts, digests = [], []
        for text in batch.column("text").cast(pa.large_binary()).to_pylist():
            own = (text or b"").split()  # bytes split at the six ASCII spaces
            counts.append(len(own))
            digests.append(hashlib.sha256(b" ".join(own)).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array(counts, pa.int64()), pa.array(digests)], ["doc_id", "text_key", "n_words", "whole"])


def _seeds(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            t = _Texts(batch.column("text"), width)
            at = np.unique(t.least)
            row = t.rows[at]
            yield pa.RecordBatch.from_arrays([_longs(t.parts[at]), batch.column("doc").take(pa.array(row)), pa.array((at - t.first[row]).astype(np.int32))], ["h", "doc", "at"])

    return run


def _extended(width: int):
    """Windows of half the width around the least parts that repeat, each with the windows of full width that hold it there.

    A window that comes earlier in the same text is repeated for sure: it stands in a row without h.
    """
    half = width // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            t = _Texts(batch.column("text"), width)
            places = batch.column("places").combine_chunks() if isinstance(batch.column("places"), pa.ChunkedArray) else batch.column("places")
            marked = np.zeros(len(t.h) + 1, bool)
            owner = np.repeat(np.arange(batch.num_rows), places.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
            marked[t.first[owner] + places.flatten().to_numpy()] = True
            live = marked[t.least]
            start, least = t.windows[live], t.least[live]
            if not len(start):
                continue
            a, b = (rolled(t.h, width, f)[start] for f in _FACTORS[2:])
            # to the right of the least part if it stands in the first half, else to the left
            middle = np.where(least - start <= width - half, least, least + t.part - half)
            row = t.rows[start]
            order = np.lexsort((start, b, a, row))
            again = np.zeros(len(start), bool)
            x, y = order[1:], order[:-1]
            again[x] = (a[x] == a[y]) & (b[x] == b[y]) & (row[x] == row[y])
            h = rolled(t.h, half, _FACTORS[1])[middle]
            # rows: windows of one text with one middle, those that come again apart
            order = np.lexsort((start, again, middle))
            m, g = middle[order], again[order]
            cut = np.flatnonzero(np.r_[True, (m[1:] != m[:-1]) | (g[1:] != g[:-1])])
            ends = pa.array(np.r_[cut, len(order)].astype(np.int32))
            lead = order[cut]
            lists = [pa.ListArray.from_arrays(ends, v) for v in (pa.array((start - t.first[row])[order].astype(np.int32)), _longs(a[order]), _longs(b[order]))]
            where = (middle - t.first[row])[lead].astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(h[lead].view(np.int64), mask=again[lead]), batch.column("doc").take(pa.array(row[lead])), pa.array(where), *lists], ["h", "doc", "at", "starts", "a", "b"]
            )

    return run


def _kept(width: int):
    """Words that are left when all windows that begin at `places` are removed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            removed, digests = [], []
            for text, places in zip(batch.column("text").cast(pa.large_binary()).to_pylist(), batch.column("places"), strict=True):
                own = text.split()
                change = np.zeros(len(own) + 1, np.int64)
                at = places.values.to_numpy()
                np.add.at(change, at, 1)
                np.add.at(change, at + width, -1)
                gone = np.cumsum(change[:-1]) > 0
                removed.append(int(gone.sum()))
                digests.append(hashlib.sha256(b" ".join(own[i] for i in np.flatnonzero(~gone))).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(removed, pa.int64()), pa.array(digests)], ["doc", "removed", "digest"])

    return run


def distinct_texts(docs: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """Rows by id and text (doc_id, text_key, n_words, whole, copies, doc), and the texts that may hold a repeated passage (doc, text).

    Each distinct text of at least `width` words stands for its copies; doc numbers them by their smallest id (null ids last, then by digest) and is null for other rows.
    """
    facts = docs.select("doc_id", "text_key", "text").mapInArrow(_facts, "doc_id long, text_key binary, n_words long, whole string")
    facts = staged(facts.groupBy("doc_id", "text_key").agg(F.first("n_words").alias("n_words"), F.first("whole").alias("whole"), F.count("*").alias("copies")), "facts")
    first = facts.where(F.col("n_words") >= width).groupBy("text_key").agg(F.min("doc_id").alias("doc_id"))
    order = [F.col("doc_id").asc_nulls_last(), F.col("text_key")]
    # numbers rise with the order: ranges by partition, places within
    first = staged(first.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("doc", F.monotonically_increasing_id()), "order")
    named = lambda: first.select(F.col("doc_id").alias("its_id"), F.col("text_key").alias("its_key"), "doc")
    same = lambda: (F.col("text_key") == F.col("its_key")) & F.col("doc_id").eqNullSafe(F.col("its_id"))
    rows = facts.join(named(), same(), "left").drop("its_id", "its_key")
    texts = docs.join(to_all(named()), same()).select("doc", "text")
    if not rows.where("doc is not null and copies > 1").isEmpty():
        texts = texts.dropDuplicates(["doc"])
    return rows, staged(texts, "texts")


def repeated_windows(texts: DataFrame, width: int) -> DataFrame | None:
    """(doc, start) of each window of `width` words that also starts earlier; None if no candidates are left."""
    seeds = staged(texts.mapInArrow(_seeds(width), "h long, doc long, at int"), "seeds")
    twice = staged(seeds.groupBy("h").agg(F.count("*").alias("weight")).where("weight > 1"), "twice")
    if twice.isEmpty():
        return None
    live = by_weight(seeds, twice, ["h"], seeds.count())
    places = staged(live.groupBy("doc").agg(F.collect_list("at").alias("places")), "places")
    some = texts.join(to_all(places.select("doc")), "doc", "left_semi").join(places, "doc")
    discarded(seeds)
    discarded(twice)
    longer = staged(some.select("doc", "text", "places").mapInArrow(_extended(width), "h long, doc long, at int, starts array<int>, a array<long>, b array<long>"), "longer")
    within = longer.where("h is null").select("doc", F.explode("starts").alias("start"))
    once = longer.where("h is not null")
    # windows of one place may stand in two rows
    twice = once.groupBy("h").agg(F.count("*").alias("weight"), F.min("doc").alias("d"), F.max("doc").alias("e"), F.min("at").alias("p"), F.max("at").alias("q"))
    twice = staged(twice.where("d <> e or p <> q").select("h", "weight"), "twice")
    if twice.isEmpty():
        return within
    full = by_weight(once, twice, ["h"], once.count()).select("doc", F.inline(F.arrays_zip("starts", "a", "b")))
    full = staged(full.select("doc", F.col("starts").alias("start"), "a", "b"), "full")
    discarded(twice)
    first = staged(full.groupBy("a", "b").agg(F.count("*").alias("weight"), F.min("doc").alias("first")).where("weight > 1"), "first")
    return by_weight(full, first, ["a", "b"], full.count()).where(F.col("doc") > F.col("first")).select("doc", "start").unionAll(within)


def without_repeats(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for each row of docs; width is a multiple of 4.

    Null and empty texts, and texts without words, have no words; what is kept of them is the empty text. Texts of fewer than width words lose nothing. Order is by doc_id, null
    ids last; texts that share an id follow each other by their MD5; of equal rows one is the first and the others are later copies. An empty table gives no rows.
    Other columns of docs play no part.
    """
    if width % 4 or width < 4:
        raise ValueError("width must be a multiple of 4")
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))).alias("text_key"))
    rows, texts = distinct_texts(own, width)
    windows = repeated_windows(texts, width)
    if windows is None:
        changed = docs.sparkSession.createDataFrame([], "doc long, removed long, digest string")
    else:
        places = staged(windows.groupBy("doc").agg(F.collect_list("start").alias("places")), "removed")
        some = texts.join(to_all(places.select("doc")), "doc", "left_semi").join(places, "doc")
        changed = staged(some.select("doc", "text", "places").mapInArrow(_kept(width), "doc long, removed long, digest string"), "changed")
    nothing = hashlib.sha256(b"").hexdigest()
    found = rows.join(changed, "doc", "left").withColumn("copy", F.explode(F.expr("sequence(1L, copies)")))
    first = (F.col("doc").isNotNull() & (F.col("copy") == 1)) | (F.col("n_words") < width)
    return found.select(
        "doc_id", "n_words", F.when(first, F.coalesce("removed", F.lit(0))).otherwise(F.col("n_words")).cast("long").alias("n_removed"),
        F.when(first, F.coalesce("digest", "whole")).otherwise(F.lit(nothing)).alias("kept_sha256"),
    )
