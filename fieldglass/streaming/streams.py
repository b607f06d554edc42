"""Structured Streaming forms of the counts, ratios, scores and duplicates that are computed in batch elsewhere."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from fieldglass.operators.shared import shared_dir
from fieldglass.operators.topics import nearest


#: States that the values of a stream of first rows share.
BUCKETS = 4096


def event_stream(spark: SparkSession, path: str, schema, ts: str = "ts", max_files: int | None = None) -> DataFrame:
    """Parquet files as a stream; its time column as timestamp, which watermarks need."""
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path).withColumn(ts, F.col(ts).cast("timestamp"))


def closing_event(events: DataFrame, ts: str) -> DataFrame:
    """One event ten years after the last: once a stream has it, the watermark has passed all windows before."""
    last = events.agg(F.max_by(F.struct(*events.columns), ts).alias("e")).where("e is not null").select("e.*")
    return last.withColumn(ts, F.col(ts) + F.expr("interval 10 years"))


def frame_alerts(frames: DataFrame, video: str, ts: str, closed, size: str = "10 minutes", slide: str = "5 minutes", late: str = "1 hour") -> DataFrame:
    """Share of closed-eye frames of each video in sliding windows; frames may come in any order within the watermark."""
    w = frames.withWatermark(ts, late).groupBy(video, F.window(ts, size, slide)).agg(F.count("*").alias("frames"), F.avg(closed.cast("double")).alias("closed_share"))
    return w.select(video, F.col("window.start").cast("timestamp_ntz").alias("start"), "frames", "closed_share")


def daily_counts(events: DataFrame, ts: str, kind: str, late: str = "1 day") -> DataFrame:
    w = events.withWatermark(ts, late).groupBy(F.window(ts, "1 day"), kind).agg(F.count("*").alias("n"))
    return w.select(F.to_date("window.start").alias("day"), kind, "n")


def first_of_each(events: DataFrame, keys: list[str], ts: str, late: str = "1 day") -> DataFrame:
    """One row a day for each value of the keys: day and keys. A day's values leave the state when the watermark has passed it."""
    days = events.withWatermark(ts, late).groupBy(F.window(ts, "1 day"), *keys).agg(F.count("*").alias("n"))
    return days.select(F.to_date("window.start").alias("day"), *keys)


def keep_first(events: DataFrame, keys: list[str], ts: str, id_col: str, within: str = "1 day", late: str = "1 day") -> DataFrame:
    """The whole first row (by time, then id) of each value of the keys; a row within `within` of the one kept before it is a duplicate.

    Files may come in any order within `late`: a row waits until the watermark has passed it, so an earlier one that comes later still wins, and the rows kept
    are those of a batch over all events. Timers decide what waits, and forget a value once nothing can be its duplicate any more, so state
    holds only what is young. Values share BUCKETS states by hash, since a call of Python for each value costs far more than its rows. A null key is a value like any other; rows with a null time or id are left out.
    """
    spark = events.sparkSession
    span = int(spark.sql(f"SELECT unix_micros(timestamp'1970-01-01 00:00:00Z' + interval '{within}')").first()[0])

    def decide(_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = {k: (last, [tuple(x) for x in waiting]) for k, last, waiting in state.get[0]} if state.exists else {}
        for batch in batches:
            for k, *r in zip(batch["key"], batch["at"], batch["order"], batch["row"], strict=True):
                held.setdefault(k, (None, []))[1].append((int(r[0]), int(r[1]), r[2]))
        passed, kept, young, timer = state.getCurrentWatermarkMs() * 1000, [], [], None
        for k, (last, waiting) in held.items():
            left = []
            for at, order, row in sorted(waiting):
                if at > passed:
                    left.append((at, order, row))
                elif last is None or at > last + span:
                    kept.append(row)
                    last = at
            until = min([x[0] for x in left], default=last + span if last is not None else passed)
            if left or until > passed:
                young.append((k, last, left))
                timer = until if timer is None else min(timer, until)
        if young:
            state.update((young,))
            state.setTimeoutTimestamp(max(timer, passed) // 1000 + 1)
        else:
            state.remove()
        yield pd.DataFrame({"row": kept}, dtype=object)

    packed = F.to_json(F.struct(*events.columns), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "ignoreNullFields": "false"})
    known = events.where(F.col(ts).isNotNull() & F.col(id_col).isNotNull()).withWatermark(ts, late)
    key = F.to_json(F.struct(*(F.col(c).alias(f"key{k}") for k, c in enumerate(keys))))  # a null has no field
    rows = known.select(key.alias("key"), F.pmod(F.xxhash64(key), F.lit(BUCKETS)).alias("bucket"), F.unix_micros(ts).alias("at"), F.col(id_col).cast("long").alias("order"), packed.alias("row"), ts)
    state = "held array<struct<key: string, last: long, waiting: array<struct<at: long, order: long, row: string>>>>"
    found = rows.groupBy("bucket").applyInPandasWithState(decide, "row string", state, "append", GroupStateTimeout.EventTimeTimeout)
    return found.select(F.from_json("row", events.schema, {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}).alias("r")).select("r.*")


def scored(items: DataFrame, vector: str, labels: DataFrame, label: str, label_vector: str) -> DataFrame:
    """Each item with its nearest label as it arrives: a join with few broadcast labels, without state."""
    return nearest(items, vector, labels, label, label_vector, 1)


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there, and return what it wrote.

    Append mode closes only windows behind the watermark; complete mode gives all groups. The table goes to the shared folder.
    """
    spark = stream.sparkSession
    place = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{place}/state").trigger(availableNow=True)
    if mode == "append":
        writer.format("parquet").option("path", f"{place}/out").start().awaitTermination()
    else:
        writer.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{place}/out")).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{place}/out")
