"""Counts, shares, cross-tabs and the tables behind charts."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldglass.operators.features import equal_width_bin
from fieldglass.operators.ordered import quantiles
from fieldglass.operators.shared import fresh


def value_counts(df: DataFrame, *columns: str) -> DataFrame:
    """Rows of each value, null one of them, most frequent first."""
    return df.groupBy(*columns).agg(F.count("*").alias("n")).orderBy(F.desc("n"), *columns)


def share_of_counts(df: DataFrame, column: str) -> DataFrame:
    """Share of each value among all rows; the window is over as many rows as there are values."""
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("_total"))
    return counts.crossJoin(F.broadcast(total)).select(column, "n", (F.col("n") / F.col("_total")).alias("share"))


def value_share_domain(df: DataFrame, column: str, domain: Sequence[int]) -> DataFrame:
    """Share of each value of a fixed domain among its rows; 0 for a value without rows."""
    all_values = df.sparkSession.range(1).select(F.explode(F.array(*[F.lit(v) for v in domain])).alias(column))
    counts = df.where(F.col(column).isin(*domain)).groupBy(column).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("_total"))
    out = all_values.join(counts, column, "left").crossJoin(F.broadcast(total))
    return out.select(column, F.coalesce(F.col("n") / F.col("_total"), F.lit(0.0)).alias("share"))


def share_equal(df: DataFrame, by: Sequence[str], column: str, value) -> DataFrame:
    """Percent of the rows of each group whose column equals value; null where the column is null throughout."""
    return df.groupBy(*by).agg((F.avg((F.col(column) == value).cast("int")) * 100).alias("percent"))


def counts_by_parts(df: DataFrame, ts: str) -> DataFrame:
    """Rows by year, month, day, weekday and weekend, from one pass: part, value, n."""
    parts = {"year": F.year(ts), "month": F.month(ts), "day": F.dayofmonth(ts), "weekday": F.weekday(ts), "weekend": (F.weekday(ts) >= 5).cast("int")}
    rows = df.select(F.explode(F.array(*[F.struct(F.lit(k).alias("part"), v.alias("value")) for k, v in parts.items()])).alias("s"))
    return rows.groupBy("s.part", "s.value").agg(F.count("*").alias("n"))


def top_plus_other(df: DataFrame, column: Column, k: int, other: str = "other") -> DataFrame:
    """The k most frequent values, and all others as one."""
    counts = df.groupBy(column.cast("string").alias("value")).agg(F.count("*").alias("n"))
    top = counts.orderBy(F.desc("n"), "value").limit(k)
    rest = counts.join(F.broadcast(top.select("value")), "value", "left_anti").agg(F.lit(other).alias("value"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    return top.unionByName(rest)


def pivot_counts(df: DataFrame, row: Column, row_domain: Sequence, column: Column, column_domain: Sequence, prefix: str) -> DataFrame:
    """Counts of row value by column value over fixed domains, 0 where there are none."""
    rows = df.sparkSession.range(1).select(F.explode(F.array(*[F.lit(v) for v in row_domain])).alias("row"))
    counts = df.groupBy(row.alias("row")).agg(*[F.count_if(column == v).alias(f"{prefix}{v}") for v in column_domain])
    return rows.join(counts, "row", "left").na.fill(0)


def group_stats(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    stats = df.groupBy(*by).agg(F.max(value).alias("max"), F.min(value).alias("min"), F.avg(value).alias("mean"))
    return stats.join(quantiles(df, by, value, {"median": 0.5}), list(by), "left")


def melt(df: DataFrame, ids: Sequence[str], values: Sequence[str]) -> DataFrame:
    return df.unpivot(list(ids), list(values), "statistic", "value")


def share_of_buckets(df: DataFrame, slices: Sequence[str], year: str, bucket: str) -> DataFrame:
    """Percent of each bucket among the rows of its slice and year that have a bucket."""
    counts = df.where(F.col(bucket).isNotNull()).groupBy(*slices, year, bucket).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(*slices, year))
    return counts.withColumn("percent", F.col("n") * 100 / total).drop("n")


def box_stats(df: DataFrame, by: str, value: str, fence: float = 1.5) -> DataFrame:
    """Quartiles, whisker ends (last values inside the fence) and the number of values outside, for each group."""
    q = quantiles(df, [by], value, {"q1": 0.25, "q2": 0.5, "q3": 0.75})
    reach = (F.col("q3") - F.col("q1")) * fence
    inside = F.col(value).between(F.col("q1") - reach, F.col("q3") + reach)
    low, high = F.min(F.when(inside, F.col(value))), F.max(F.when(inside, F.col(value)))
    return df.join(q, by).groupBy(by, "q1", "q2", "q3").agg(low.alias("whisker_low"), high.alias("whisker_high"), F.count_if(~inside).alias("n_outside"))


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """Rows in left-closed bins of equal width, the last one closed: bin, n."""
    edges = df.agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    place = F.least(F.floor((F.col(column) - F.col("_lo")) / ((F.col("_hi") - F.col("_lo")) / bins)), F.lit(bins - 1)).cast("int")
    return df.select(column).where(F.col(column).isNotNull()).crossJoin(F.broadcast(edges)).groupBy(place.alias("bin")).agg(F.count("*").alias("n"))


def histogram_2d(df: DataFrame, x: str, y: str, bins: int) -> DataFrame:
    edges = df.agg(*[f(c).alias(f"_{n}{k}") for k, c in (("x", x), ("y", y)) for n, f in (("lo", F.min), ("hi", F.max))])
    place = lambda k, c: F.least(F.floor((F.col(c) - F.col(f"_lo{k}")) / ((F.col(f"_hi{k}") - F.col(f"_lo{k}")) / bins)), F.lit(bins - 1)).cast("int")
    return df.na.drop(subset=[x, y]).crossJoin(F.broadcast(edges)).groupBy(place("x", x).alias("bin_x"), place("y", y).alias("bin_y")).agg(F.count("*").alias("n"))


def kde_curve(df: DataFrame, column: str, points: int, width: float, cells: int = 1000) -> DataFrame:
    """Gaussian kernel density at equally spaced points, from counts in `cells` cells: x, density.

    The counts make the work points * cells at any number of rows.
    """
    edges = df.agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"), F.count(column).alias("_n"))
    cell = F.floor((F.col(column) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * (cells - 1) + 0.5)
    counts = df.select(column).where(F.col(column).isNotNull()).crossJoin(F.broadcast(edges)).groupBy(cell.alias("cell")).agg(F.count("*").alias("w"))
    grid = df.sparkSession.range(points).crossJoin(edges)
    at = F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("id") / (points - 1)
    middle = F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("cell") / (cells - 1)
    z = (F.col("x") - middle) / width
    pairs = grid.withColumn("x", at).crossJoin(F.broadcast(counts))
    return pairs.groupBy("id", "x").agg((F.sum(F.col("w") * F.exp(-z * z / 2)) / (F.first("_n") * width * (2 * 3.141592653589793) ** 0.5)).alias("density")).drop("id")


def corr_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlation of each pair over the rows that have both: a, b, r."""
    pairs = list(combinations_with_replacement(columns, 2))
    wide = df.agg(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias("r")).alias(f"_{i}") for i, (a, b) in enumerate(pairs)])
    return wide.select(F.explode(F.array(*[f"_{i}" for i in range(len(pairs))])).alias("s")).select("s.*")


def regression_line(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"))


def bar_means(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Mean and its standard error by group."""
    return df.groupBy(*by).agg(F.avg(value).alias("mean"), (F.stddev_samp(value) / F.sqrt(F.count(value))).alias("error"))


def column_means(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.agg(*[F.avg(c).alias(c) for c in columns]).unpivot([], list(columns), "column_name", "mean").orderBy("mean")


def class_balance(df: DataFrame, label: str) -> DataFrame:
    """Rows of each class, and how many more make it as large as the largest."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    top = counts.agg(F.max("n").alias("_top"))
    return counts.crossJoin(F.broadcast(top)).select(label, "n", (F.col("_top") - F.col("n")).alias("missing"))


def weighted_share(df: DataFrame, by: Sequence[str], value: Column, weight: str) -> DataFrame:
    return df.groupBy(*by).agg((F.sum(F.col(weight) * value.cast("double")) / F.sum(weight)).alias("share"))


def binned(df: DataFrame, column: str, n: int, into: str = "bin") -> DataFrame:
    """Right-closed equal-width bins over the whole column."""
    low, high = fresh("low"), fresh("high")
    edges = df.agg(F.min(column).alias(low), F.max(column).alias(high))
    return df.crossJoin(F.broadcast(edges)).withColumn(into, equal_width_bin(F.col(column), F.col(low), F.col(high), n)).drop(low, high)
