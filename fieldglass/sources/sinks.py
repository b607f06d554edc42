"""Writers, and jobs that can resume."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS").csv(path, header=True, escape='"')


def write_parquet(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def write_chunked(df: DataFrame, key: str, path: str, process: Callable[[DataFrame], DataFrame], chunks: int) -> None:
    """Process and append df in chunks by hash of the key. A chunk whose folder is complete is skipped, so a stopped job goes on where it was."""
    spark = df.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for k in range(chunks):
        done = hadoop(f"{path}/chunk={k}/_SUCCESS")
        if not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
            process(df.where(F.pmod(F.xxhash64(key), F.lit(chunks)) == k)).write.mode("overwrite").parquet(f"{path}/chunk={k}")
