"""Agglomeration by average linkage of cosine distances, exactly and without a table of pairs.

The mean cosine distance between two clusters is 1 - m_a . m_b, m being the mean of a cluster's unit vectors, so a cluster is known by its
sum and its size. In each round every cluster finds its nearest; two that are each other's nearest merge, which is what merging the closest pair of all, time
after time, would do as well, since a merger is never nearer to a third cluster than both of its parts. The largest product m_a . m_b is found
as the nearest point, only for clusters that merged or whose nearest did: (m_a, 0) is nearest to the (m_b, sqrt(1 - |m_b|^2)) with the largest. Once what has to look again is little work (as many products of clusters as LITTLE tables of FEW have, HELD numbers in all), one task goes on with the same rounds, which would else cost
more to start than to run; at FEW clusters it takes a table of all pairs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldglass.operators.density import roots
from fieldglass.operators.neighbours import nearest_points
from fieldglass.operators.shared import written

#: Clusters that one task merges to the end by a table of pairs: half a GB. Numbers of all clusters' means, and tables of FEW by FEW products in a round, at which one task takes over; products that it holds at once.
FEW, HELD, LITTLE, AT_ONCE = 8192, 1 << 23, 16, 1 << 22


def _started(df: DataFrame, id_col: str, vector: str) -> DataFrame:
    """id, name (smallest id of all equal unit vectors), unit: rows with a vector that has a length."""
    x = F.col(vector).cast("array<double>")
    rows = df.select(F.col(id_col).cast("long").alias("id"), x.alias("x"), F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v)).alias("length")).where("length > 0")
    unit = rows.select("id", F.transform("x", lambda v: v / F.col("length")).alias("unit"))
    names = unit.groupBy("unit").agg(F.min("id").alias("name"), F.count("*").alias("n"))
    return written(unit.join(names, "unit").select("id", "name", "n", "unit"), "units")


def nearest_clusters(now: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """name, other, height for each cluster (name, n, total), or for those with a name in `of`: the one at the smallest mean cosine distance; of equal ones the smallest name."""
    mean = F.transform("total", lambda v: v / F.col("n"))
    rest = F.sqrt(F.greatest(F.lit(0.0), 1 - F.aggregate("mean", F.lit(0.0), lambda s, v: s + v * v)))
    means = written(now.select("name", mean.alias("mean")), "means")
    asked = (means if of is None else means.join(of, "name", "left_semi")).select(F.concat("mean", F.array(F.lit(0.0))).alias("x"), "name", "mean")
    points = means.select(F.concat("mean", F.array(rest)).alias("x"), F.col("name").alias("label"), F.lit(1).alias("w"))
    # the two nearest points hold the nearest other cluster; the tie's rule needs no more, since of equal distances smaller names come first
    near = nearest_points(asked.select("x").distinct(), points, 2).select("x", F.col("label").alias("other"))
    pairs = asked.join(near, "x").where("name <> other").select("name", "other", "mean")
    pairs = pairs.join(means.select(F.col("name").alias("other"), F.col("mean").alias("its")), "other")
    height = F.round(1 - F.aggregate(F.zip_with("mean", "its", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v), 12)
    best = pairs.select("name", "other", height.alias("height")).groupBy("name").agg(F.min(F.struct("height", "other")).alias("b"))
    return best.select("name", "b.other", "b.height")


def _nearest(mean: np.ndarray, asked: np.ndarray, nearest: np.ndarray, least: np.ndarray) -> None:
    """Sets the nearest, of equal ones the first, and its height for the asked rows."""
    step = max(1, AT_ONCE // len(mean))
    for k in range(0, len(asked), step):
        rows = asked[k : k + step]
        product = mean[rows] @ mean.T
        at = np.arange(len(rows))
        product[at, rows] = -np.inf
        best = product.argmax(axis=1)
        top = product[at, best]
        # others may be as high to 12 digits
        product[at, best] = -np.inf
        for r in np.flatnonzero(product.max(axis=1) >= top - 2e-12):
            product[r, best[r]] = top[r]
            close = np.flatnonzero(product[r] >= top[r] - 2e-12)
            best[r] = close[np.round(1 - product[r, close], 12).argmin()]
        nearest[rows], least[rows] = best, np.round(1 - np.einsum("ij,ij->i", mean[rows], mean[best]), 12)


def _rounds(names: np.ndarray, n: np.ndarray, total: np.ndarray, nearest: np.ndarray, least: np.ndarray, out: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """names, n and total of FEW clusters at most, after rounds as in `linkage`. nearest: rows, -1 if to be found."""
    mean = total / n[:, None]
    asked = np.flatnonzero(nearest < 0)
    while len(names) > FEW:
        _nearest(mean, asked, nearest, least)
        row = np.arange(len(names))
        i = np.flatnonzero((nearest[nearest] == row) & (row < nearest))
        if not len(i):  # as in `linkage`
            low, high = np.minimum(row, nearest), np.maximum(row, nearest)
            first = np.lexsort((high, low, least))[0]
            i, j = low[[first]], high[[first]]
            least[i] = least[first]
        else:
            j = nearest[i]
        out += zip(names[j].tolist(), names[i].tolist(), least[i].tolist(), strict=True)
        total[i] += total[j]
        n[i] += n[j]
        mean[i] = total[i] / n[i, None]
        touched, kept = np.zeros(len(names), bool), np.ones(len(names), bool)
        touched[i] = touched[j] = True
        kept[j] = False
        again = touched | touched[nearest]
        place = np.cumsum(kept) - 1
        names, n, total, mean, nearest, least = names[kept], n[kept], total[kept], mean[kept], place[nearest[kept]], least[kept]
        asked = np.flatnonzero(again[kept])
    return names, n, total


def _ended(rows: pd.DataFrame) -> pd.DataFrame:
    """The rest of the tree: the closest pair merges, of equal ones the one with the smallest names. rows: name, n, total, and other and height where the nearest is known."""
    rows = rows.sort_values("name").reset_index(drop=True)
    names, n, total = rows["name"].to_numpy(), rows["n"].to_numpy(float), np.stack(rows["total"].to_numpy())
    out: list[tuple[int, int, float]] = []
    if len(names) > FEW:
        nearest, least = pd.Index(names).get_indexer(rows["other"]), rows["height"].to_numpy(float)
        del rows
        names, n, total = _rounds(names, n, total, nearest, least, out)
    names = names.tolist()
    mean = total / n[:, None]
    d = mean @ mean.T
    np.subtract(1, d, out=d)
    np.round(d, 12, out=d)
    np.fill_diagonal(d, np.inf)
    nearest = d.argmin(axis=1)
    least = d[np.arange(len(d)), nearest]
    for _ in range(len(names) - 1):
        i = int(least.argmin())
        i, j = sorted((i, int(nearest[i])))
        out.append((names[j], names[i], float(d[i, j])))
        total[i] += total[j]
        n[i] += n[j]
        mean[i] = total[i] / n[i]
        # a cluster that is gone is never nearest
        d[j], d[:, j], least[j] = np.inf, np.inf, np.inf
        alive = np.isfinite(d[i])
        d[i, alive] = d[alive, i] = np.round(1 - mean[alive] @ mean[i], 12)
        closer = (d[i] < least) | ((d[i] == least) & (i < nearest))
        closer[[i, j]] = False
        again = np.flatnonzero((nearest == i) | (nearest == j))
        again = np.append(again[again != j], i)
        nearest[closer], least[closer] = i, d[i, closer]
        nearest[again] = d[again].argmin(axis=1)
        least[again] = d[again, nearest[again]]
    return pd.DataFrame(out, columns=["name", "parent", "height"])


def linkage(start: DataFrame) -> DataFrame:
    """name, parent, height: the cluster called name goes into the one called parent; a cluster is called by its smallest id. start: name, n, total."""
    now, out, best, asked = written(start, "clusters"), None, None, None
    width = (now.select(F.size("total").alias("d")).first() or {"d": 0})["d"]
    while (n := now.count()) > FEW and (n * width > HELD or n * (n if asked is None else asked.count()) > LITTLE * FEW * FEW):
        found = nearest_clusters(now, asked)
        best = written(found if best is None else best.join(asked, "name", "left_anti").unionByName(found), "nearest")
        back = best.select(F.col("name").alias("other"), F.col("other").alias("name"))
        pairs = written(best.join(back, ["name", "other"]).where("name > other").select("name", F.col("other").alias("parent"), "height"), "pairs")
        if pairs.isEmpty():  # heights that differ in digits that don't count: the closest pair of all merges
            one = best.select("height", F.least("name", "other").alias("parent"), F.greatest("name", "other").alias("name")).orderBy("height", "parent", "name").limit(1)
            pairs = written(one.select("name", "parent", "height"), "pairs")
        out = pairs if out is None else out.unionAll(pairs)
        moved = now.join(pairs.select("name", "parent"), "name", "left").select(F.coalesce("parent", "name").alias("name"), "n", "total")
        # two rows a cluster at most
        sums = F.aggregate(F.collect_list("total"), F.transform(F.first("total"), lambda v: v * 0), lambda s, v: F.zip_with(s, v, lambda a, b: a + b))
        now = written(moved.groupBy("name").agg(F.sum("n").alias("n"), sums.alias("total")), "clusters")
        # what merges, is never nearer to others than its parts: only clusters that merged, or whose nearest did, look again
        gone = pairs.select("name").unionAll(pairs.select("parent"))
        best = best.join(pairs.select("name"), "name", "left_anti")
        touched = best.join(gone.withColumnRenamed("name", "other"), "other", "left_semi").select("name")
        asked = written(touched.unionAll(pairs.select(F.col("parent").alias("name"))).distinct(), "asked")
    known = now.select("name", F.lit(None).cast("long").alias("other"), F.lit(None).cast("double").alias("height")).limit(0) if best is None else best.join(asked, "name", "left_anti")
    rest = now.join(known, "name", "left").withColumn("one", F.lit(1)).groupBy("one").applyInPandas(_ended, "name long, parent long, height double")
    return written(rest if out is None else out.unionAll(rest), "tree")


def average_linkage(df: DataFrame, id_col: str, vector: str, k: int) -> DataFrame:
    """id, cluster (its smallest id) for each row: k clusters by average linkage of cosine distances, or as many as there are directions.

    Equal unit vectors are at distance 0 and start together. Rows whose vector is null or has no length have a null cluster. Distances count to 12 digits; of equal ones the
    pair with the smaller names merges first.
    """
    rows = _started(df, id_col, vector)
    start = rows.groupBy("name").agg(F.first("n").alias("n"), F.first("unit").alias("unit")).select("name", "n", F.transform("unit", lambda v: v * F.col("n")).alias("total"))
    tree = linkage(start)
    # the k - 1 last merges are undone: heights never fall towards the root
    undone = tree.orderBy(F.desc("height"), F.desc("name")).limit(k - 1) if k > 1 else tree.limit(0)
    kept = tree.join(undone.select("name"), "name", "left_anti").select("name", "parent")
    top = roots(start.select("name").join(kept, "name", "left").select("name", F.coalesce("parent", "name").alias("parent")))
    member = rows.join(top, "name").select(F.col("id").alias(id_col), F.col("root").alias("cluster"))
    return df.select(F.col(id_col).cast("long").alias(id_col)).join(member, id_col, "left")
