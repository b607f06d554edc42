"""Shared folder, staged tables and byte-level text tools for the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python task handles at once.
CHUNK_BYTES = 2_000_000
#: Keys of at most 16 bytes that may go to all tasks.
FEW_KEYS = 500_000
#: Hot keys that go to all tasks, at most.
MANY_KEYS = 50_000
#: White space that separates words, as ASCII codes (fixed values).
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a new local one in local mode only."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(made := f"file://{tempfile.mkdtemp(prefix='spark-')}")
    return made


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read back: it is computed once and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discarded(df: DataFrame) -> None:
    """Deletes the files of a staged table that nothing reads any more."""
    spark = df.sparkSession
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def to_all(keys: DataFrame) -> DataFrame:
    """keys (staged), to be sent to all tasks by a join if they are FEW_KEYS at most; more are left to a join by shuffle."""
    return F.broadcast(keys) if keys.limit(FEW_KEYS + 1).count() <= FEW_KEYS else keys


def among(df: DataFrame, keys: DataFrame, on: Column, how: str = "left_semi") -> DataFrame:
    """The rows of df whose `on` is among keys (one column, staged); with how="left_anti" the others.

    Up to FEW_KEYS keys go to all tasks, so that df isn't shuffled; more are joined by shuffle.
    """
    own = f"key_{uuid.uuid4().hex}"  # clashes with no column of df
    return df.join(to_all(keys.toDF(own)), on == F.col(own), how)


def by_weight(left: DataFrame, right: DataFrame, on: list[str], total: int) -> DataFrame:
    """left joined with right (staged) on keys that are never null. right has a row a key, and in `weight` how many rows of left have it; total is the rows of left.

    Rows of left with a hot key (at least 1/MANY_KEYS of all) are dealt out, and its row in right is repeated as often. All tasks are told the hot
    keys: there are MANY_KEYS of them at most. So no task gets all rows of a hot key.
    """
    least = max(2, total // MANY_KEYS)
    rooms, room = (f"{c}_{uuid.uuid4().hex}" for c in ("rooms", "room"))  # clash with no column
    hot = right.where(F.col("weight") >= least).select(*on, F.ceil(F.col("weight") / least).alias(rooms))
    own = F.when(F.col(rooms).isNull(), 0).otherwise(F.pmod(F.xxhash64(*left.columns), F.col(rooms)))
    dealt = left.join(F.broadcast(hot), on, "left").withColumn(room, own.cast("int"))
    ready = F.when(F.col("weight") >= least, F.ceil(F.col("weight") / least) - 1).otherwise(0).cast("int")
    repeated = right.withColumn(room, F.explode(F.sequence(F.lit(0), ready)))
    return dealt.join(repeated, [*on, room]).select(*left.columns, *(c for c in right.columns if c not in on))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bucket_of(doc_id: str, mod: int):
    """crc32 of doc_id as text, modulo; a null id counts as the empty text."""
    return (F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % mod).cast("int")


def pieces(batches: Iterable[pa.RecordBatch], column: str, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the texts of one piece stay below `most` bytes, unless a single text is longer."""
    for batch in batches:
        _, offsets = flat(batch.column(column))
        start = 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + most, side="right")) - 1)
            yield batch.slice(start, stop - start)
            start = stop


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column, and where each row begins; nulls are empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit hashes."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and row of each run of bytes that aren't SPACES; rows end words."""
    inside = ~_IS_SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edge = offsets[:-1][offsets[:-1] < len(data)]
    first[edge] = inside[edge]
    starts = np.flatnonzero(first)
    last = inside.copy()
    last[:-1] &= ~inside[1:] | first[1:]
    lengths = np.flatnonzero(last) - starts + 1
    return starts, lengths, np.searchsorted(offsets, starts, side="right") - 1


def word_hashes(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, most: int = CHUNK_BYTES, fold: np.ndarray = _LOWER) -> np.ndarray:
    """64-bit hashes of words with A-Z lower-cased, or as `fold` maps their bytes."""
    out = np.empty(len(starts), np.uint64)
    ends = np.cumsum(lengths)
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
        n = lengths[at:to]
        begin = np.cumsum(n) - n
        place = np.arange(int(n.sum())) - np.repeat(begin, n)
        powers = np.multiply.accumulate(np.full(int(n.max()), 0x9E3779B97F4A7C15, np.uint64))
        chars = fold[data[place + np.repeat(starts[at:to], n)]].astype(np.uint64) + np.uint64(1)
        out[at:to] = mixed(np.add.reduceat(chars * powers[place], begin) ^ n.astype(np.uint64))
        at = to
    return out


def shingle_sets(column: pa.Array, width: int = 5) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row; a row with fewer words than width has one for all its words."""
    data, offsets = flat(column)
    starts, lengths, rows = words(data, offsets)
    sets = [np.zeros(0, np.uint64)] * len(column)
    if not len(starts):
        return sets
    h = word_hashes(data, starts, lengths)
    counts = np.bincount(rows, minlength=len(column))
    begin = np.cumsum(counts) - counts
    factor = np.uint64(0xD6E8FEB86659FD93)
    grams = h[: max(0, len(h) - width + 1)].copy()
    for k in range(1, width):
        grams = grams * factor + h[k : k + len(grams)]
    grams = mixed(grams)
    for i in np.flatnonzero(counts):
        at, n = begin[i], counts[i]
        if n >= width:
            sets[i] = np.unique(grams[at : at + n - width + 1])
        else:
            short = np.uint64(n)
            for x in h[at : at + n]:
                short = np.uint64((int(short) * int(factor) + int(x)) & 0xFFFFFFFFFFFFFFFF)
            sets[i] = mixed(np.array([short], np.uint64))
    return sets
