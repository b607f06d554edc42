"""The folder that driver and executors share, and tables written to it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows of a task that holds them, about.
TASK_ROWS = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a new folder in local mode only."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(made := f"file://{tempfile.mkdtemp(prefix='spark-')}")
    return made


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """df as Parquet in the shared folder, read back: computed once, and lost executors don't matter."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, rows: int, *columns: str) -> DataFrame:
    """df dealt out by the columns so that a task has about TASK_ROWS of the rows at most, however many there are; tables dealt for the same number of rows meet where they lie."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(least, -(-rows // TASK_ROWS)), *columns)


def fresh(name: str) -> str:
    """A column name that no table has."""
    return f"{name}_{uuid.uuid4().hex[:12]}"
