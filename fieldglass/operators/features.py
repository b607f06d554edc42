"""Numeric, categorical and survey features."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldglass.operators.ordered import quantiles, running
from fieldglass.operators.shared import fresh

EPSILON = 1e-9


def one_hot(df: DataFrame, column: str, values: Sequence | None = None) -> DataFrame:
    """A 0/1 column for each value. Values not given are read from the data, which must have few."""
    if values is None:
        values = sorted(r[0] for r in df.select(column).where(F.col(column).isNotNull()).distinct().limit(1001).collect())
        if len(values) > 1000:
            raise ValueError(f"{column} has more than 1000 values")
    return df.select("*", *[F.when(F.col(column) == v, 1).otherwise(0).alias(f"{column}_{v}") for v in values]).drop(column)


def _with_stats(df: DataFrame, **stats: Column) -> DataFrame:
    """df beside one row of its aggregates, whose names are fresh ones."""
    return df.crossJoin(F.broadcast(df.agg(*[c.alias(k) for k, c in stats.items()])))


def standardize(df: DataFrame, column: str) -> DataFrame:
    """Distance from the mean in population deviations; null where all values are equal."""
    mean, spread = fresh("mean"), fresh("spread")
    out = _with_stats(df, **{mean: F.avg(column), spread: F.stddev_pop(column)})
    return out.withColumn(column, F.try_divide(F.col(column) - F.col(mean), F.col(spread))).drop(mean, spread)


def normalize_minmax(df: DataFrame, column: str, constant: float | None = None) -> DataFrame:
    """(x - min) / (max - min); `constant` where all values are equal."""
    low, high = fresh("low"), fresh("high")
    out = _with_stats(df, **{low: F.min(column), high: F.max(column)})
    scaled = F.when(F.col(high) > F.col(low), (F.col(column) - F.col(low)) / (F.col(high) - F.col(low))).when(F.col(column).isNotNull(), F.lit(constant).cast("double"))
    return out.withColumn(column, scaled).drop(low, high)


def binarize(df: DataFrame, column: str, threshold: float) -> DataFrame:
    """1 above the threshold, else 0; null is 0."""
    return df.withColumn(column, F.when(F.col(column) > threshold, 1).otherwise(0))


def equal_width_bin(x: Column, low: Column, high: Column, n: int) -> Column:
    """Bin 0 to n - 1 of right-closed bins of equal width; the minimum is in bin 0."""
    return (F.greatest(F.ceil((x - low) / ((high - low) / n)), F.lit(1)) - 1).cast("int")


def discretize(df: DataFrame, column: str, n: int) -> DataFrame:
    low, high = fresh("low"), fresh("high")
    out = _with_stats(df, **{low: F.min(column), high: F.max(column)})
    return out.withColumn(column, equal_width_bin(F.col(column), F.col(low), F.col(high), n)).drop(low, high)


def without_outliers(df: DataFrame, column: str, fence: float = 1.5) -> DataFrame:
    """Rows strictly inside the fence around the quartiles."""
    low, high = fresh("low"), fresh("high")
    out = df.crossJoin(F.broadcast(quantiles(df, [], column, {low: 0.25, high: 0.75})))
    reach = (F.col(high) - F.col(low)) * fence
    return out.where((F.col(column) > F.col(low) - reach) & (F.col(column) < F.col(high) + reach)).drop(low, high)


def label_encode(df: DataFrame, column: str, into: str) -> DataFrame:
    """Rank of the value's text among all values, from 0; null counts as the text 'nan'."""
    text, upto = fresh("text"), fresh("upto")
    own = F.coalesce(F.col(column).cast("string"), F.lit("nan")).alias(text)
    codes = running(df.select(own).distinct(), [], [F.col(text)], {upto: F.lit(1)}).select((F.col(upto) - 1).cast("int").alias(into), text)
    return df.select("*", own).join(codes, text).select(*df.columns, into)


def factorize(df: DataFrame, column: str, order: str, into: str) -> DataFrame:
    """Rank of the value by its first appearance in `order`, from 0; null is -1."""
    first, upto = fresh("first"), fresh("upto")
    values = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.min(order).alias(first))
    codes = running(values, [], [F.col(first), F.col(column)], {upto: F.lit(1)}).select((F.col(upto) - 1).cast("int").alias(into), column)
    return df.join(codes, column, "left").withColumn(into, F.coalesce(into, F.lit(-1)))


def map_codes(column: Column, codes: Mapping, keep_unmatched: bool = False) -> Column:
    """Recoded value; an unmatched one is null, or itself."""
    found = F.create_map(*[F.lit(x) for kv in codes.items() for x in kv])[column]
    return F.coalesce(found, column) if keep_unmatched else found


def bucket_answers(column: Column, groups: Mapping[str, Sequence]) -> Column:
    """The group whose answers hold the value, else null."""
    out = None
    for name, values in groups.items():
        hit = column.isin(*values)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def merge_flags(flags: Mapping[int, Column], also: Column, several: int = 7, only_also: int = 6) -> Column:
    """One code from several yes/no flags (null: no).

    More than one flag, or one beside `also`: `several`. One flag: its code. `also` alone: `only_also`. None: null.
    """
    total = sum((f.isNotNull().cast("int") for f in flags.values()), F.lit(0))
    out = F.when((total > 1) | ((total == 1) & also.isNotNull()), several)
    for code, f in flags.items():
        out = out.when((total == 1) & f.isNotNull(), code)
    return out.when(also.isNotNull(), only_also)


def row_mean(*columns: Column) -> Column:
    """Mean over the columns that are present; null if none is."""
    some = F.filter(F.array(*[c.cast("double") for c in columns]), lambda x: x.isNotNull())
    return F.when(F.size(some) > 0, F.aggregate(some, F.lit(0.0), lambda a, x: a + x) / F.size(some))


def combine_pairs(df: DataFrame, pairs: Mapping[str, Sequence[str]]) -> DataFrame:
    """Each name becomes the mean of those of its columns that df has and that are present."""
    made = {name: row_mean(*[F.col(c) for c in columns if c in df.columns]) for name, columns in pairs.items()}
    used = {c for columns in pairs.values() for c in columns}
    return df.withColumns(made).drop(*used)


def interactions(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select("*", *[(F.col(a) * F.col(b)).alias(f"{a}_x_{b}") for a, b in combinations(columns, 2)])


def pair_ratios(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select("*", *[(F.col(a) / (F.col(b) + EPSILON)).alias(f"{a}_per_{b}") for a, b in combinations(columns, 2)])


def within_tolerance(truth: Column, predicted: Column, tolerance: float = 0.1) -> Column:
    """Share of rows whose relative error is below the tolerance."""
    return F.avg((F.try_divide(F.abs(truth - predicted), truth) < tolerance).cast("int"))
