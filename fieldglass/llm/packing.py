"""Harmonic packing of token sequences.

A document's ids are cut at multiples of the capacity C; what remains is cut further so that each piece nearly fills C/k for a whole k
(the largest C/k that fits first, then again on the rest; pieces of TINY ids or fewer, and those that waste no more than SLACK, stay whole). A piece of length L belongs to class
k = C div L, and a bin of class k holds exactly k pieces. Pieces of a class are numbered over all workers by block counts and offsets,
so number div k is the bin and no worker keeps a part-filled one. The fewer than k pieces that are over in a class (about 10,000 in all classes together, at any
input size) are packed together by first fit.
"""

from __future__ import annotations

import base64
import json
import zlib
from collections.abc import Iterator
from functools import cache, partial
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldglass.llm.common import pieces, staged

CAPACITY, END, TINY, SLACK = 2048, 1, 64, 0.01
BLOCK_ROWS, LEAST_BLOCKS, MOST_BLOCKS = 1 << 17, 16, 1 << 17


def vocabulary() -> str:
    """The default vocabulary: byte_bpe_50k, as ranks. With the added tokens of the json file beside it, its ids equal those of byte_bpe_50k.json."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@cache
def encoder(path: str):
    """The encoding of a rank file; added tokens of the json file of the same name, if there is one, are matched in texts."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    whole = Path(path).with_suffix(".json")
    added = {t["content"]: t["id"] for t in json.loads(whole.read_text("utf-8"))["added_tokens"]} if whole.exists() else {}
    return tiktoken.Encoding("bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)


def cuts(n: int, capacity: int = CAPACITY) -> list[int]:
    """Lengths of the pieces of a document of n ids."""
    out = [capacity] * (n // capacity)
    left = n % capacity
    while left:
        if left <= TINY or capacity % left <= SLACK * capacity:
            out.append(left)
            break
        out.append(capacity // -(-capacity // left))
        left -= out[-1]
    return out


def _cut(path: str, with_ids: bool, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = partial(encoder(path).encode, allowed_special="all")
        for batch in pieces(batches, "text"):
            out: list[tuple] = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = np.array([*encode(text or ""), END], "<u4")
                at = 0
                for n in cuts(len(ids), capacity):
                    part = ids[at : at + n]
                    out.append((doc, at, n, zlib.crc32(part.tobytes()), len(ids), *([part.tolist()] if with_ids else [])))
                    at += n
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *(["ids"] if with_ids else [])]
            kinds = [pa.int64()] * 5 + [pa.list_(pa.int64())] * with_ids
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return run


def _first_fit(capacity: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True]).reset_index(drop=True)
        used: list[int] = []
        bins, offsets, first = [], [], 0
        for n in rows["length"]:
            while first < len(used) and used[first] >= capacity:
                first += 1
            at = next((i for i in range(first, len(used)) if used[i] + n <= capacity), len(used))
            if at == len(used):
                used.append(0)
            bins.append(at)
            offsets.append(used[at])
            used[at] += n
        return rows.assign(sequence_id=rows["base"] + np.array(bins, "int64"), offset=np.array(offsets, "int64")).drop(columns=["one", "base"])

    return run


def packed(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids, if asked for).

    A null text counts as empty: its document is the end id alone. Repeated rows are packed once each, in any order among themselves.
    Null ids are ids like any other. An empty table gives no rows. Other columns of docs play no part.
    """
    kinds = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<long>" * with_ids
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    cut = staged(source.mapInArrow(_cut(tokenizer or vocabulary(), with_ids, capacity), kinds).withColumn("k", F.expr(f"{capacity} div length")), "pieces")
    n = cut.count()
    blocks = min(MOST_BLOCKS, max(LEAST_BLOCKS, 1 << (n // BLOCK_ROWS).bit_length()))
    cut = cut.withColumn("block", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(blocks)).cast("int"))
    tally = cut.groupBy("k", "block").agg(F.count("*").alias("n"))
    upto = Window.partitionBy("k").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = tally.select("k", "block", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("ahead"))
    # a row for each class, so at most CAPACITY rows
    classes = tally.groupBy("k").agg(F.sum("n").alias("n")).withColumn("bins", F.expr("n div k"))
    classes = classes.withColumn("base", F.coalesce(F.sum("bins").over(Window.orderBy("k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    classes = classes.withColumn("all_bins", F.sum("bins").over(Window.partitionBy(F.lit(1))))
    inside = Window.partitionBy("k", "block").orderBy("doc_id", "start", "ids_crc32")
    placed = cut.withColumn("within", F.row_number().over(inside) - 1).join(offsets, ["k", "block"]).join(F.broadcast(classes), "k")
    placed = staged(placed.withColumn("number", F.col("ahead") + F.col("within")).drop("ahead", "within", "block", "n"), "numbered")
    columns = [c for c in cut.columns if c not in ("k", "block")]
    kept = placed.where("number < bins * k").withColumn("sequence_id", F.expr("base + number div k"))
    alone = kept.where("k = 1").select(*columns, "sequence_id", F.lit(0).cast("long").alias("offset"))
    along = Window.partitionBy("sequence_id").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    shared = kept.where("k > 1").select(*columns, "sequence_id", F.coalesce(F.sum("length").over(along), F.lit(0)).alias("offset"))
    over = placed.where("number >= bins * k").select(*columns, F.col("all_bins").alias("base"), F.lit(1).alias("one"))
    over = over.groupBy("one").applyInPandas(_first_fit(capacity), kinds + ", sequence_id long, offset long")
    return alone.unionByName(shared).unionByName(over)
