"""Dates and times."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def date_as_int(ts: Column) -> Column:
    return F.year(ts) * 10000 + F.month(ts) * 100 + F.dayofmonth(ts)


def parse_two_formats(text: Column) -> Column:
    """Timestamps with fractional seconds, else in whole seconds, else null."""
    return F.coalesce(F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss.SSSSSS")), F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss")))


def date_features(df: DataFrame, column: str, fill: str = "1900-01-01") -> DataFrame:
    """Year, month, day, weekday (Monday 0) and weekend flag; a null date counts as `fill`."""
    ts = F.coalesce(F.col(column), F.lit(fill).cast("timestamp_ntz"))
    return df.withColumns({"year": F.year(ts), "month": F.month(ts), "day": F.dayofmonth(ts), "dayofweek": F.weekday(ts), "is_weekend": (F.weekday(ts) >= 5).cast("int")})


def date_cyclic(df: DataFrame, column: str) -> DataFrame:
    """Sine and cosine of month and year; the year's carry no information and are kept for compatibility."""
    turn = lambda x, period: x * (2 * math.pi / period)
    month, year = turn(F.month(column), 12), turn(F.year(column), 1)
    return df.withColumns({f"{name}_{f.__name__}": F.round(f(x), 6) for name, x in (("month", month), ("year", year)) for f in (F.sin, F.cos)})


def days_since_start(df: DataFrame, column: str, into: str = "days") -> DataFrame:
    first = df.agg(F.min(column).alias("_first"))
    return df.crossJoin(F.broadcast(first)).withColumn(into, F.datediff(F.col(column), F.col("_first"))).drop("_first")
