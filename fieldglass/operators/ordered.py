"""Running sums and exact quantiles in a global order, without a task that sees all rows.

Rows are cut into ranges of the order itself, by Spark's range partitioning, so that values with a long common beginning are spread too and the number of ranges follows
the session's shuffle partitions. The rows are written once with the number of their range; sums run within a range, and each range starts from the
total of those before it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldglass.operators.shared import fresh, written


def running(df: DataFrame, by: Sequence[str], order: Sequence[Column], sums: Mapping[str, Column]) -> DataFrame:
    """df with, for each name of sums, its sum up to the row within `by` in the given order (`name`) and over all rows of `by` (`name_all`).

    The order must tell rows apart within `by`, or rows that it doesn't tell apart may swap their sums. Rows of equal order lie in one range.
    """
    block, own, ahead, its = fresh("block"), fresh("own"), fresh("ahead"), fresh("its")
    rows = written(df.repartitionByRange(*order).withColumn(block, F.spark_partition_id()), "ranges")
    totals = rows.groupBy(*by, block).agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    before, all_ = Window.partitionBy(*by).orderBy(block).rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*by)
    keys = [*by, block]
    bases = totals.select(*[F.col(k).alias(f"{its}_{k}") for k in keys], *[x for n in sums for x in (F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"{ahead}_{n}"), F.sum(n).over(all_).alias(f"{n}_all"))])
    along = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = rows.select("*", *[F.sum(c).over(along).alias(f"{own}_{n}") for n, c in sums.items()])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"{its}_{k}")) for k in keys])
    return summed.join(bases, same).select(*[F.col(c) for c in df.columns], *[x for n in sums for x in ((F.col(f"{own}_{n}") + F.col(f"{ahead}_{n}")).alias(n), F.col(f"{n}_all"))])


def quantiles(df: DataFrame, by: Sequence[str], value: str, shares: Mapping[str, float]) -> DataFrame:
    """Exact quantiles of value, interpolated between neighbours, for each group: by and a column a share. Nulls don't count; a group without values has no row."""
    x, n, upto = fresh("value"), fresh("n"), fresh("upto")
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias(x)).agg(F.count("*").alias(n))
    ranked = running(counts, by, [F.col(x)], {upto: F.col(n)})

    def at(share: float) -> Column:
        place = (F.col(f"{upto}_all") - 1) * share
        low, high = (F.min(F.when(F.col(upto) > f(place), F.col(x))) for f in (F.floor, F.ceil))
        rest = F.max(place - F.floor(place))
        return low + (high - low) * rest

    return ranked.groupBy(*by).agg(*[at(p).alias(name) for name, p in shares.items()])
