"""Ranked search of whole texts by terms, scoring each bag of words once.

Documents are restricted to the vocabulary of the items: what counts is how often each of its terms occurs, and the length in terms, which enters as the
integer m. Documents equal in both have equal scores for all items, so they form a class: rows meet by a hash of the bag, and equality of the whole
bag decides. Of a class only the `best` smallest ids can be in a result, and these are cut off before the shuffle as well as after it. Each class is scored once;
of the classes that lead for an item (by score, then by smallest id) the members come out by ascending id.

Items are taken in blocks of a bounded number of terms; what a block needs goes to all tasks.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldglass.llm.common import pieces, staged

#: Bytes of the texts of a block of items, unless it is a single item; cells of a table of scores; results an item; and the largest sum that is exact in doubles.
ITEM_BYTES, CELLS, BEST, EXACT = 8_000_000, 4_000_000, 10, 2**53
#: Term bytes: all but the ASCII bytes that are neither digits nor letters; A-Z become a-z.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or re.match(rb"[0-9a-z]", bytes([c])) else 32 for c in range(256))
_LAST = np.iinfo(np.int64).max


def terms(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_FOLD).split()


def _bags(vocabulary: dict[bytes, int]):
    """Length in terms of each text, and its terms of the vocabulary with their counts, in the vocabulary's order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            sizes, ends, at, counts = [], [0], [], []
            for text in batch.column("text").cast(pa.large_binary()).to_pylist():
                own = terms(text)
                sizes.append(len(own))
                bag = sorted((vocabulary[t], n) for t, n in Counter(own).items() if t in vocabulary)
                at += [t for t, _ in bag]
                counts += [n for _, n in bag]
                ends.append(len(at))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(v, pa.int32())) for v in (at, counts)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), *lists], ["doc_id", "n", "terms", "tfs"])

    return run


def _scores(weights: np.ndarray, items: list[np.ndarray], best: int):
    """The best members of this task for each item. items: places of their terms in the vocabulary."""
    size, chunk = len(weights), 256

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps: list[list[tuple[int, int]]] = [[] for _ in items]  # (score, -id), the worst first
        for batch in batches:
            ends, m = batch.column("terms").offsets.to_numpy(), batch.column("m").to_numpy()
            at, tf = batch.column("terms").flatten().to_numpy(), batch.column("tfs").flatten().to_numpy().astype(np.int64)
            ends = ends - ends[0]
            ids = [np.array([_LAST if x is None else x for x in own], np.int64) for own in batch.column("ids").to_pylist()]
            one = weights[at] * (1_000_000_000 * tf // (1000 * tf + 8 * np.repeat(m, np.diff(ends))))
            step = max(1, CELLS // max(1, size))
            for a in range(0, batch.num_rows, step):
                b = min(batch.num_rows, a + step)
                table = np.zeros((b - a, size))
                table[np.repeat(np.arange(b - a), np.diff(ends[a : b + 1])), at[ends[a] : ends[b]]] = one[ends[a] : ends[b]]
                least = np.array([x[0] for x in ids[a:b]])
                for c in range(0, len(items), chunk):
                    some = items[c : c + chunk]
                    own = np.unique(np.concatenate(some))
                    asked = np.zeros((len(own), len(some)))
                    for j, x in enumerate(some):
                        asked[np.searchsorted(own, x), j] = 1
                    part = table[:, own]
                    if part.sum(axis=1).max(initial=0) < EXACT:  # whole numbers below 2^53: exact in any order
                        scores = (part @ asked).astype(np.int64)
                    else:
                        scores = part.astype(np.int64) @ asked.astype(np.int64)
                    for j in range(len(some)):
                        heap, column = heaps[c + j], scores[:, j]
                        floor = heap[0][0] if len(heap) == best else 1
                        rows = np.flatnonzero(column >= max(floor, 1))
                        for r in rows[np.lexsort((least[rows], -column[rows]))[:best]]:
                            for x in ids[a + r].tolist():
                                entry = (int(column[r]), -x)
                                if len(heap) < best:
                                    heapq.heappush(heap, entry)
                                elif entry > heap[0]:
                                    heapq.heapreplace(heap, entry)
        out = [(i, -x, s) for i, heap in enumerate(heaps) for s, x in heap]
        columns = [pa.array([o[0] for o in out], pa.int32()), pa.array([None if o[1] == _LAST else o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["item", "doc_id", "score"])

    return run


def blocks(items: DataFrame) -> Iterator[list[tuple[object, list[bytes]]]]:
    """Items with their distinct terms, in blocks of ITEM_BYTES of text; one block at a time is held."""
    now, size = [], 0
    for item, text in items.toLocalIterator():
        own = sorted(set(terms((text or "").encode())))
        if own:
            if now and size + len(text.encode()) > ITEM_BYTES:
                yield now
                now, size = [], 0
            now.append((item, own))
            size += len(text.encode())
    if now:
        yield now


def classes(bags: DataFrame, best: int) -> DataFrame:
    """m, terms, tfs, ids: bags that are equal in m and all counts, with their `best` smallest ids. bags: doc_id, m, terms, tfs."""
    key = ["h", "m", "terms", "tfs"]
    hashed = bags.withColumn("h", F.xxhash64("m", "terms", "tfs"))
    place = F.row_number().over(Window.partitionBy(*key).orderBy(F.col("doc_id").asc_nulls_last()))
    few = hashed.withColumn("place", place).where(F.col("place") <= best)
    ids = F.transform(F.array_sort(F.collect_list(F.struct("place", "doc_id"))), lambda x: x["doc_id"]).alias("ids")
    return few.groupBy(*key).agg(ids).drop("h")


def _searched(docs: DataFrame, block: list[tuple[object, list[bytes]]], best: int) -> DataFrame:
    vocabulary = {t: i for i, t in enumerate(sorted({t for _, own in block for t in own}))}
    bags = staged(docs.mapInArrow(_bags(vocabulary), "doc_id long, n long, terms array<int>, tfs array<int>").where("n > 0"), "bags")
    total, length = bags.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(vocabulary), np.int64)
    for t, n in bags.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # a row a term of the block
        df[t] = n
    weights = np.array([math.floor(1000 * math.log((2 * total + 2) / (2 * n + 1))) for n in df.tolist()], np.int64)
    m = F.expr(f"100 - 90 + (90 * n * {total}L) div {max(length, 1)}L")
    found = classes(bags.where(F.size("terms") > 0).select("doc_id", m.alias("m"), "terms", "tfs"), best)
    asked = [np.array([vocabulary[t] for t in own]) for _, own in block]
    scores = found.mapInArrow(_scores(weights, asked, best), "item int, doc_id long, score long")
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last()))
    return scores.withColumn("rank", rank).where(F.col("rank") <= best)


def search(docs: DataFrame, items: DataFrame, best: int = BEST, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: the documents that score highest for each item, `best` at most.

    Null texts have no term, like texts without any; they are in no result and not counted. A null doc_id comes after all others of the same score. Repeated
    rows of docs count each and each have a rank; repeated rows of items, or ones with equal or null ids, are asked each for itself. Items that no document shares a
    term with have no rows, and so have empty tables. Other columns play no part.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out = None
    for block in blocks(items.select(F.col(item_col).cast("long"), item_text)):
        names = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(block)], "item int, item_id long")
        found = _searched(texts, block, best).join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
        out = found if out is None else out.unionAll(found)
    return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long") if out is None else out
