"""Features from neighbouring rows, in a stated order within a partition."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from fieldglass.operators.clean import fill_mean
from fieldglass.operators.features import pair_ratios
from fieldglass.operators.shared import fresh


def along(partition_by: Sequence[str], order_by: Sequence[str]) -> WindowSpec:
    return Window.partitionBy(*partition_by).orderBy(*order_by)


def lag_features(df: DataFrame, columns: Sequence[str], lags: Sequence[int], w: WindowSpec) -> DataFrame:
    return df.withColumns({f"{c}_lag{n}": F.lag(c, n).over(w) for c in columns for n in lags})


def moving_average(df: DataFrame, columns: Sequence[str], size: int, w: WindowSpec) -> DataFrame:
    """Trailing mean; null until there are `size` values."""
    span = w.rowsBetween(-(size - 1), 0)
    return df.withColumns({f"{c}_ma{size}": F.when(F.count(c).over(span) == size, F.avg(c).over(span)) for c in columns})


def diff_features(df: DataFrame, columns: Sequence[str], w: WindowSpec) -> DataFrame:
    return df.withColumns({f"{c}_diff": F.col(c) - F.lag(c).over(w) for c in columns})


def process_series(df: DataFrame, columns: Sequence[str], lags: Sequence[int], size: int, w: WindowSpec) -> DataFrame:
    """Lags, moving averages, differences and pair ratios; their nulls become column means."""
    out = pair_ratios(diff_features(moving_average(lag_features(df, columns, lags, w), columns, size, w), columns, w), columns)
    return fill_mean(out, [c for c in out.columns if c not in df.columns])


def top_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group; WindowGroupLimit keeps k rows a task and group before the shuffle."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col(rank) <= k)


def top_as_columns(df: DataFrame, group: str, value: str, score: str, k: int) -> DataFrame:
    """value_1, score_1, ... of the k best values of each group."""
    best = top_per_group(df, [group], [F.desc(score), F.asc(value)], k)
    pick = lambda c, i: F.max(F.when(F.col("rank") == i, F.col(c))).alias(f"{c}_{i}")
    return best.groupBy(group).agg(*[pick(c, i) for i in range(1, k + 1) for c in (value, score)])


def sample_per_group(df: DataFrame, group: Sequence[str], key: str, n: int, seed: int = 7) -> DataFrame:
    """n rows of each group at random, the same ones in every run."""
    rank = fresh("rank")
    return top_per_group(df, group, [F.xxhash64(F.col(key), F.lit(seed)), F.col(key)], n, rank).drop(rank)
