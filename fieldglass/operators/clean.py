"""Column choice, filters, duplicates, profiles and repair of nulls."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldglass.operators.ordered import quantiles
from fieldglass.operators.shared import fresh


def select_by_name(df: DataFrame, prefix: str = "", contains: str = "") -> DataFrame:
    """Columns whose name starts with prefix and contains the other text."""
    return df.select(*[c for c in df.columns if c.startswith(prefix) and contains in c])


def rename_suffix(df: DataFrame, suffix: str, keep: Sequence[str] = ()) -> DataFrame:
    return df.withColumnsRenamed({c: f"{c}{suffix}" for c in df.columns if c not in keep})


def filter_equal_columns(df: DataFrame, *columns: str, equal: bool = True) -> DataFrame:
    """Rows whose columns are all equal, or (equal=False) that have a pair that differs; nulls never qualify."""
    first, *rest = (F.col(c) for c in columns)
    same = first == rest[0]
    for c in rest[1:]:
        same = same & (first == c)
    return df.where(same if equal else ~same)


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """For each key the row that comes first in order, a total order; all columns stay.

    One aggregation with a map-side minimum, so a key that holds most rows needs no large sort.
    """
    order_cols = [F.col(c) if isinstance(c, str) else c for c in order]
    rest = [c for c in df.columns if c not in keys]
    best = F.min(F.struct(*[c.alias(f"_o{i}") for i, c in enumerate(order_cols)], *[F.col(c) for c in rest])).alias("_best")
    return df.groupBy(*keys).agg(best).select(*[F.col(c) if c in keys else F.col(f"_best.{c}").alias(c) for c in df.columns])


def count_duplicates(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """n_duplicates: rows less distinct rows (or distinct values of subset, null a value like others)."""
    keys = list(subset or df.columns)
    return df.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_duplicates"))


def _per_column(df: DataFrame, columns: Sequence[str], measure, name: str) -> DataFrame:
    """One pass over df, then a row for each column."""
    wide = df.agg(*[measure(c).alias(c) for c in columns])
    return wide.unpivot([], list(columns), "column_name", name)


def profile_nunique(df: DataFrame, columns: Sequence[str] | None = None, approximate: bool = False) -> DataFrame:
    count = F.approx_count_distinct if approximate else F.countDistinct
    return _per_column(df, columns or df.columns, lambda c: count(F.col(c)), "n_unique")


def profile_nulls(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return _per_column(df, columns or df.columns, lambda c: F.count_if(F.col(c).isNull()), "n_nulls")


def profile_shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n_rows"), F.lit(len(df.columns)).cast("long").alias("n_columns"))


def describe_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, mean, sample deviation, minimum, exact quartiles and maximum of each column."""
    stats = {"n": lambda c: F.count(c).cast("double"), "mean": F.avg, "std": F.stddev_samp, "min": lambda c: F.min(c).cast("double"), "max": lambda c: F.max(c).cast("double")}
    wide = df.agg(*[F.struct(F.lit(c).alias("column_name"), *[f(F.col(c)).alias(k) for k, f in stats.items()]).alias(c) for c in columns])
    rows = wide.select(F.explode(F.array(*columns)).alias("s")).select("s.*")
    values = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("value")) for c in columns])).alias("s")).select("s.*")
    quarters = quantiles(values, ["column_name"], "value", {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    return rows.join(quarters, "column_name", "left").select("column_name", "n", "mean", "std", "min", "q25", "q50", "q75", "max")


def describe_object(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, distinct, most frequent value (the smallest of several) and its frequency of each text column."""
    rows = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns])).alias("s")).select("s.*").where("value is not null")
    counts = rows.groupBy("column_name", "value").agg(F.count("*").alias("n"))
    top = F.min(F.struct((-F.col("n")).alias("m"), "value"))
    return counts.groupBy("column_name").agg(F.sum("n").alias("n"), F.count("*").alias("n_unique"), top.alias("t")).select("column_name", "n", "n_unique", F.col("t.value").alias("top"), (-F.col("t.m")).alias("freq"))


def schema_info(df: DataFrame) -> DataFrame:
    """Name, type and non-null count of each column."""
    types = dict(df.dtypes)
    kinds = F.create_map(*[F.lit(x) for c in df.columns for x in (c, types[c])])
    return _per_column(df, df.columns, lambda c: F.count(F.col(c)), "n_present").withColumn("type", kinds[F.col("column_name")])


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def split_numeric(df: DataFrame) -> DataFrame:
    """A row for each column: its name, whether it is numeric, and how many values it has."""
    numeric = [F.lit(c) for c in numeric_columns(df)]
    is_numeric = F.array_contains(F.array(*numeric), F.col("column_name")) if numeric else F.lit(False)
    return _per_column(df, df.columns, lambda c: F.count(F.col(c)), "n_present").withColumn("is_numeric", is_numeric)


def non_numeric_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct values of text columns that don't parse as numbers."""
    rows = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("value")) for c in columns])).alias("s")).select("s.*")
    return rows.where("value is not null and try_cast(value as double) is null").distinct()


def blank_to_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.when(F.trim(c) == "", None).otherwise(F.col(c)) for c in columns})


def to_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Text to double; what doesn't parse is null."""
    return df.withColumns({c: F.col(c).try_cast("double") for c in columns})


def _filled(df: DataFrame, columns: Sequence[str], value) -> DataFrame:
    """Nulls of each column become an aggregate of it; the one row of aggregates is broadcast."""
    stats = df.agg(*[value(F.col(c)).alias(f"_{c}") for c in columns])
    out = df.crossJoin(F.broadcast(stats))
    return out.select(*[F.coalesce(F.col(c), F.col(f"_{c}")).alias(c) if c in columns else F.col(c) for c in df.columns])


def fill_median(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    values = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in columns])).alias("s")).select("s.*")
    # a row for each column
    medians = quantiles(values, ["name"], "value", {"median": 0.5}).agg(F.map_from_entries(F.collect_list(F.struct("name", "median"))).alias("_medians"))
    return df.crossJoin(F.broadcast(medians)).withColumns({c: F.coalesce(F.col(c), F.col("_medians")[c]) for c in columns}).drop("_medians")


def fill_mode(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The most frequent value; of several the smallest. Values are counted by group, so a column may have any number of them."""
    out, n, best = df, fresh("n"), fresh("best")
    for c in columns:
        counts = df.where(F.col(c).isNotNull()).groupBy(c).agg(F.count("*").alias(n))
        # one row
        first = counts.agg(F.min(F.struct(-F.col(n), F.col(c))).alias(best)).select(F.col(f"{best}.{c}").alias(best))
        out = out.crossJoin(F.broadcast(first)).withColumn(c, F.coalesce(c, best)).drop(best)
    return out


def fill_mean(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return _filled(df, columns, F.avg)


def in_keys(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    return df.join(keys.select(on), on, "left_semi")

