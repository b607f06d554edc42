"""Shards by a Feistel permutation of global row numbers; DataFrame functions only.

Rows are numbered 0..n-1 in an order that the data alone decides (a hash block, then id and text digest), so any layout of the
input gives the same numbers. A Feistel network on the halves (x % a, x div a), a * b >= n, permutes 0..a*b-1; walking its cycle
until a value below n comes up makes that a permutation of 0..n-1. Position p lies in shard p % shards, slot p div shards, so shard
sizes differ by one row at most, and where a row goes can be computed from its number alone.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldglass.llm.common import staged

ROUNDS, SEED, WALK = 8, 7, 64
#: Rows of one numbering block, the number of blocks at least and at most, and copies of a row that one task makes.
BLOCK_ROWS, LEAST_BLOCKS, MOST_BLOCKS, COPIES = 1 << 17, 64, 1 << 17, 1 << 16


def halves(n: int) -> tuple[int, int]:
    """a, b with a * b >= n, and by less than a."""
    a = max(1, math.isqrt(max(n, 1) - 1) + 1)
    return a, max(1, -(-n // a))


def permuted(number: str, n: int, seed: int = SEED) -> Column:
    """The place of row `number` among n rows."""
    a, b = halves(n)
    net = f"""aggregate(sequence(1L, {ROUNDS}L), named_struct('l', p % {a}L, 'r', p div {a}L),
        (s, j) -> if(j % 2 = 1, named_struct('l', (s.l + pmod(xxhash64(s.r, j, {seed}L), {a}L)) % {a}L, 'r', s.r),
                                named_struct('l', s.l, 'r', (s.r + pmod(xxhash64(s.l, j, {seed}L), {b}L)) % {b}L)), s -> s.r * {a}L + s.l)"""
    # a cycle leaves the a * b - n values outside before it comes back to them
    walked = F.expr(f"aggregate(sequence(1, {min(WALK, a * b - n + 1)}), cast({number} as bigint), (p, i) -> if(i > 1 and p < {n}L, p, {net}))")
    return F.when(walked < n, walked).otherwise(F.raise_error(F.lit("cycle walk too long")).cast("long"))


def numbered(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, int]:
    """doc_id, size, text_crc32, row_number for each row, and the number of rows."""
    text = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    facts = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("digest"))
    facts = staged(facts.groupBy("doc_id", "size", "text_crc32", "digest").agg(F.count("*").alias("copies")), "rows")
    n, most = facts.agg(F.coalesce(F.sum("copies"), F.lit(0)), F.coalesce(F.max("copies"), F.lit(0))).first()
    blocks = min(MOST_BLOCKS, max(LEAST_BLOCKS, 1 << max(0, (n // BLOCK_ROWS).bit_length())))
    facts = facts.withColumn("block", F.pmod(F.xxhash64("doc_id", "digest"), F.lit(blocks)).cast("int"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # at most MOST_BLOCKS rows: small enough to send to all tasks
    base = facts.groupBy("block").agg(F.sum("copies").alias("rows")).select("block", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("block").orderBy("doc_id", "digest", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, -1)
    rows = facts.withColumn("start", F.coalesce(F.sum("copies").over(inside), F.lit(0))).join(F.broadcast(base), "block")
    rows = rows.select("doc_id", "size", "text_crc32", "copies", (F.col("base") + F.col("start")).alias("start"))
    if most > 1:
        rows = rows.withColumn("part", F.explode(F.expr(f"sequence(0L, (copies - 1) div {COPIES})")))
        if most > COPIES:
            rows = rows.repartition("doc_id", "start", "part")
        rows = rows.withColumn("copy", F.explode(F.expr(f"sequence(part * {COPIES}, least(copies, (part + 1) * {COPIES}) - 1)")))
    else:
        rows = rows.withColumn("copy", F.lit(0))
    return rows.select("doc_id", "size", "text_crc32", (F.col("start") + F.col("copy")).alias("row_number")), n


def sharded(docs: DataFrame, shards: int = 16, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, row_number for each row of docs.

    A null text counts as empty (size 1, crc32 0). Null ids are ids like any other. Rows equal in id and text take adjacent row numbers,
    one slot each. An empty table gives no rows. Other columns of docs play no part.
    """
    rows, n = numbered(docs, id_col, text_col)
    place = rows.withColumn("position", permuted("row_number", n, seed) if n else F.lit(0).cast("long"))
    return place.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), (F.col("position") % shards).cast("int").alias("shard"),
        F.expr(f"position div {shards}").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "row_number",
    )
