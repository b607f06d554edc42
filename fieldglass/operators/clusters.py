"""Dimension reduction, clustering and the quality of clusters."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import BisectingKMeans, KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldglass.functions.vectors import distance
from fieldglass.operators.neighbours import BLOCK, homes, meeting, packed, paired_distances, parts_of, pivots_of, squares, values, vectors
from fieldglass.operators.shared import fresh, shared_dir, written
from fieldglass.operators.topics import centroids

#: Products of two vectors that a task of the similarity join holds at once.
CELLS = 1 << 20
#: Rows among which the first centres of mini-batches are chosen.
SAMPLE = 4096


#: Columns that models read and write, dropped again; no table has them.
_V, _R = fresh("vector"), fresh("reduced")


def _vectors(df: DataFrame, vector: str) -> DataFrame:
    return df.withColumn(_V, array_to_vector(F.col(vector).cast("array<double>")))


def pca_reduce(df: DataFrame, vector: str, k: int, into: str = "reduced") -> DataFrame:
    model = PCA(k=k, inputCol=_V, outputCol=_R).fit(vs := _vectors(df, vector))
    return model.transform(vs).withColumn(into, vector_to_array(_R)).drop(_V, _R)


def pca_optimal_k(df: DataFrame, vector: str, dimensions: int, threshold: float = 0.95) -> DataFrame:
    """The fewest components whose variance reaches the threshold, and that share."""
    explained = PCA(k=dimensions, inputCol=_V, outputCol=_R).fit(_vectors(df, vector)).explainedVariance.toArray().cumsum()
    k = next((i for i, x in enumerate(explained, 1) if x >= threshold), dimensions)
    return df.sparkSession.createDataFrame([(k, float(explained[k - 1]))], "k int, variance double")


def kmeans_cluster(df: DataFrame, vector: str, k: int, seed: int = 7, into: str = "cluster") -> DataFrame:
    model = KMeans(k=k, seed=seed, featuresCol=_V, predictionCol=into).fit(vs := _vectors(df, vector))
    return model.transform(vs).drop(_V)


def kmeans_minibatch(df: DataFrame, vector: str, k: int, batch_rows: int, epochs: int = 3, seed: int = 7) -> np.ndarray:
    """Centres (rows) by mini-batches: each batch moves the centres nearest to its rows towards them, the less the more rows a centre has seen.

    Rows with a null vector play no part. Batches are parts of about batch_rows rows by hash, written apart, so that each step reads its own rows only. The first centres are spread
    out among SAMPLE rows at most (each next one by its squared distance to those before). With fewer distinct rows in it than k there are fewer centres.
    """
    spark = df.sparkSession
    rows = df.where(F.col(vector).isNotNull()).select(F.col(vector).cast("array<double>").alias("x"))
    n = rows.count()
    batches = max(1, -(-n // batch_rows))
    path = f"{shared_dir(spark)}/batches-{uuid.uuid4().hex}"
    # a batch's rows may lie in several files, each of which a task reads
    rows.withColumn("batch", F.pmod(F.xxhash64("x", F.lit(seed)), F.lit(batches)).cast("int")).repartition("batch").write.partitionBy("batch").parquet(path)
    parts = spark.read.schema("x array<double>, batch int").parquet(path)
    few = parts.select("x").orderBy(F.xxhash64("x", F.lit(seed + 1)), "x").limit(SAMPLE).toArrow().column("x").combine_chunks()
    sample, rng = np.asarray(few.flatten()).reshape(len(few), -1) if len(few) else np.zeros((0, 1)), np.random.default_rng(seed)
    centres = sample[:1].copy()
    while 0 < len(centres) < k:
        far = ((sample[:, None] - centres[None]) ** 2).sum(-1).min(axis=1)
        if not far.any():
            break
        centres = np.vstack([centres, sample[rng.choice(len(sample), p=far / far.sum())]])
    seen = np.zeros(len(centres))

    def sums(now: np.ndarray):
        def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, count = np.zeros_like(now), np.zeros(len(now), np.int64)
            for batch in found:
                if batch.num_rows:
                    x = np.asarray(batch.column("x").flatten()).reshape(batch.num_rows, -1)
                    at = (((now**2).sum(axis=1)[None] - 2 * x @ now.T)).argmin(axis=1)
                    np.add.at(total, at, x)
                    count += np.bincount(at, minlength=len(now))
            yield pa.RecordBatch.from_arrays([pa.array(range(len(now)), pa.int32()), pa.array(count), pa.array(total.tolist(), pa.list_(pa.float64()))], ["i", "n", "s"])

        return run

    for step in range(epochs * batches if len(centres) else 0):
        own = parts.where(F.col("batch") == step % batches).select("x").mapInArrow(sums(centres), "i int, n long, s array<double>")
        for r in own.collect():  # a row a centre and task of the batch
            seen[r["i"]] += r["n"]
            if r["n"]:
                centres[r["i"]] += (np.array(r["s"]) - r["n"] * centres[r["i"]]) / seen[r["i"]]
    return centres


def assigned(df: DataFrame, vector: str, centres: np.ndarray, into: str = "cluster") -> DataFrame:
    """df with the number of the nearest centre (of equal ones the first); null for a null vector."""

    @F.pandas_udf("int")
    def near(vectors: pd.Series) -> pd.Series:
        x = np.stack(vectors.to_numpy()).astype(float) if len(vectors) else np.zeros((0, centres.shape[1]))
        return pd.Series(((centres**2).sum(axis=1)[None] - 2 * x @ centres.T).argmin(axis=1), dtype="int32")

    known = df.where(F.col(vector).isNotNull()).withColumn(into, near(F.col(vector).cast("array<double>")))
    return known.unionByName(df.where(F.col(vector).isNull()), allowMissingColumns=True)


def kmeans_elbow(df: DataFrame, vector: str, ks: Sequence[int], seed: int = 7) -> DataFrame:
    vs = _vectors(df, vector).cache()
    rows = [(k, float(KMeans(k=k, seed=seed, featuresCol=_V).fit(vs).summary.trainingCost)) for k in ks]
    vs.unpersist()
    return df.sparkSession.createDataFrame(rows, "k int, cost double")


def hierarchical_cluster(df: DataFrame, vector: str, k: int, seed: int = 7, measure: str = "euclidean", into: str = "cluster") -> DataFrame:
    model = BisectingKMeans(k=k, seed=seed, distanceMeasure=measure, featuresCol=_V, predictionCol=into).fit(vs := _vectors(df, vector))
    return model.transform(vs).drop(_V)


def hierarchical_batches(df: DataFrame, id_col: str, vector: str, batch_rows: int, k: int) -> DataFrame:
    """Average-linkage clusters within batches of about batch_rows rows (by hash of the id), numbered apart over all batches (not without gaps): id, cluster."""
    batches = max(1, -(-df.count() // batch_rows))

    def link(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(id_col).reset_index(drop=True)
        x = np.stack(rows[vector].to_numpy()).astype(float)
        d = np.sqrt(np.maximum(((x[:, None] - x[None]) ** 2).sum(-1), 0))
        np.fill_diagonal(d, np.inf)
        size, of = np.ones(len(x)), np.arange(len(x))
        for _ in range(max(0, len(x) - k)):
            i, j = sorted(np.unravel_index(np.argmin(d), d.shape))
            d[i] = d[:, i] = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
            d[j] = d[:, j] = d[i, i] = np.inf
            size[i] += size[j]
            of[of == j] = i
        return pd.DataFrame({id_col: rows[id_col], "batch": rows["batch"], "local": pd.factorize(of)[0]})

    source = df.select(F.col(id_col).cast("long"), vector, F.pmod(F.xxhash64(id_col), F.lit(batches)).alias("batch"))
    found = source.groupBy("batch").applyInPandas(link, f"{id_col} long, batch long, local long")
    # a batch has k clusters at most, so this numbers them all apart
    return found.select(id_col, (F.col("batch") * k + F.col("local")).alias("cluster"))


def _units(column: pa.Array) -> np.ndarray:
    """Rows of unit vectors; vectors without length stay zero."""
    x = np.asarray(column.flatten(), float).reshape(len(column), -1) if len(column) else np.zeros((0, 1))
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def _similar(threshold: float, id_type: pa.DataType):
    """The pairs of two blocks of unit vectors that reach the threshold; of a block with itself each once."""

    def cosines(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        step = max(1, CELLS // max(1, x.shape[1]))
        return np.round(np.concatenate([np.einsum("ij,ij->i", x[i[k : k + step]], y[j[k : k + step]]) for k in range(0, len(i), step)]), 6)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                a, b = values(batch, "id", i), values(batch, "its_id", i)
                x, y = vectors(batch, "x", i, len(a)), vectors(batch, "its_x", i, len(b))
                own = batch.column("block")[i].as_py() == batch.column("its_block")[i].as_py()
                few_x, few_y, step = x.astype(np.float32), y.astype(np.float32), max(1, CELLS // len(b))
                least = threshold - 5e-7 - 2.5e-7 * (x.shape[1] + 8)  # what rounding may hide
                for k in range(0, len(a), step):
                    left, right = np.nonzero(few_x[k : k + step] @ few_y.T >= least)
                    left += k
                    if own:
                        left, right = left[left < right], right[left < right]
                    if len(left):
                        near = cosines(x, y, left, right)
                        p, q = a[left], b[right]
                        hit = (near >= threshold) & (p != q)
                        p, q = p[hit], q[hit]
                        swap = p > q
                        yield pa.RecordBatch.from_arrays([pa.array(np.where(swap, q, p), id_type), pa.array(np.where(swap, p, q), id_type), pa.array(near[hit])], ["a", "b", "similarity"])

    return run


def similar_pairs_exact(df: DataFrame, id_col: str, vector: str, threshold: float) -> DataFrame:
    """All pairs a < b with cosine of at least the threshold; rows with a null id or vector have none, nor do vectors with an entry that is no number.

    Unit vectors lie in blocks of near ones, each with a centre and a radius, and every two blocks that could hold a pair meet once, as rows of a cross join: no vector is copied
    by a shuffle. Products in single precision tell which pairs matter, and those are computed in double; a task holds CELLS products at once.
    """
    spark = df.sparkSession
    source = df.where(F.col(vector).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vector).alias("v"))
    kind = dict(source.dtypes)["id"]

    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _units(batch.column("v"))
            known = np.flatnonzero(np.isfinite(x).all(axis=1))
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(known)), pa.array(list(x[known]), pa.list_(pa.float64()))], ["id", "x"])

    points = written(source.mapInArrow(units, f"id {kind}, x array<double>"), "units")
    n = points.count()
    if not n:
        return spark.createDataFrame([], f"a {kind}, b {kind}, similarity double")
    pivots = pivots_of(points, n)
    blocks = packed(homes(points, pivots), ["id"], BLOCK, parts_of(points, n, BLOCK))
    reach = math.sqrt(max(0.0, 2 - 2 * (threshold - 5e-7))) + 1e-7
    # no gap is as small as -10
    once = F.when(F.col("block") <= F.col("its_block"), F.lit(reach)).otherwise(F.lit(-10.0))
    id_type = spark.createDataFrame([], f"id {kind}").toArrow().schema.field("id").type
    return meeting(blocks, blocks, once, 8 * n * pivots.shape[1], _similar(threshold, id_type), f"a {kind}, b {kind}, similarity double")


def communities(pairs: DataFrame, least: int) -> DataFrame:
    """Groups of similar rows without overlap, large ones first: id, centre. pairs: a, b, all that are similar enough.

    A row's community is itself and the rows similar to it. In each round a row whose community is the largest (of equals the smallest id)
    among all within two steps of it claims its members, which leave; until no community has `least` members. Rows in none have no row.
    """
    pairs = written(pairs.select("a", "b"), "pairs")
    both = pairs.unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    shared_dir(pairs.sparkSession)  # where checkpoints go
    edges = both.unionAll(both.select("a", F.col("a").alias("b"))).distinct().checkpoint()
    out = None
    while True:
        size = edges.groupBy("a").agg(F.count("*").alias("n")).where(F.col("n") >= least)
        rank = F.struct(-F.col("n"), F.col("a")).alias("rank")
        best = edges.join(size, "a").groupBy("b").agg(F.min(rank).alias("rank"))  # of the communities that a row is in
        second = edges.join(best, "b").groupBy("a").agg(F.min("rank").alias("first"))
        won = size.join(second, "a").where(F.col("first") == F.struct(-F.col("n"), F.col("a"))).select("a")
        claimed = edges.join(won, "a").select(F.col("b").alias("id"), F.col("a").alias("centre")).checkpoint()
        if claimed.isEmpty():
            return out if out is not None else claimed
        out = claimed if out is None else out.unionAll(claimed)
        gone = claimed.select("id")
        left = edges.join(gone.withColumnRenamed("id", "a"), "a", "left_anti")
        edges = left.join(gone.withColumnRenamed("id", "b"), "b", "left_anti").select("a", "b").checkpoint()


def density_cluster(df: DataFrame, id_col: str, pairs: DataFrame, min_neighbours: int, min_cluster: int) -> DataFrame:
    """id, cluster (smallest id of its core component), -1 for noise: core points have enough neighbours; others join a neighbouring core.

    Labels spread along edges until none changes; each round is a join and an aggregate on the edges. All joins are merges: no table with a row a point is built in the driver to be sent to
    tasks, as Spark does by itself with what is small when compressed.
    """
    pairs = written(pairs.select("a", "b"), "pairs")
    both = pairs.unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    shared_dir(df.sparkSession)  # where checkpoints go
    core = both.groupBy("a").agg(F.count("*").alias("n")).where(F.col("n") + 1 >= min_neighbours).select(F.col("a").alias("id"))
    core = written(core, "core")
    edges = both.join(core.select(F.col("id").alias("a")).hint("merge"), "a").join(core.select(F.col("id").alias("b")).hint("merge"), "b").checkpoint()
    labels = core.withColumn("cluster", F.col("id"))
    moved = True
    while moved:
        near = edges.join(labels.hint("merge"), edges.b == labels.id).groupBy("a").agg(F.min("cluster").alias("low"))
        new = labels.join(near.hint("merge"), labels.id == near.a, "left").select("id", F.least("cluster", "low").alias("new"), "cluster")
        jump = new.select(F.col("id").alias("new"), F.col("new").alias("hop"))
        new = new.join(jump.hint("merge"), "new", "left").select("id", F.least("new", "hop").alias("new"), "cluster").checkpoint()
        moved = not new.where("new <> cluster").isEmpty()
        labels = new.select("id", F.col("new").alias("cluster"))
    border = both.join(labels.hint("merge"), both.b == labels.id).groupBy("a").agg(F.min("cluster").alias("cluster")).select(F.col("a").alias("id"), "cluster")
    member = labels.unionByName(border.join(labels.select("id").hint("merge"), "id", "left_anti"))
    large = member.groupBy("cluster").agg(F.count("*").alias("n")).where(F.col("n") >= min_cluster).select("cluster")
    member = member.join(large.hint("merge"), "cluster")
    return df.select(F.col(id_col).alias("id")).join(member.hint("merge"), "id", "left").select(F.col("id").alias(id_col), F.coalesce("cluster", F.lit(-1)).alias("cluster"))


def silhouette(df: DataFrame, cluster: str, vector: str) -> DataFrame:
    """Mean silhouette by squared Euclidean distance, exact at any size: distances to a cluster follow from its count, sum and sum of squares.

    A row alone in its cluster counts 0.
    """
    v = df.select(F.col(cluster).alias("c"), F.col(vector).cast("array<double>").alias("v")).withColumn("q", F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    sums = v.select("c", F.posexplode("v").alias("d", "x")).groupBy("c", "d").agg(F.sum("x").alias("x")).groupBy("c").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "x"))), lambda s: s["x"]).alias("sum"))
    stats = v.groupBy("c").agg(F.count("*").alias("n"), F.sum("q").alias("sq")).join(sums, "c")
    listed = F.broadcast(stats.agg(F.collect_list(F.struct("c", "n", "sq", "sum")).alias("_s")))
    total = lambda s: s["n"] * F.col("q") + s["sq"] - 2 * F.aggregate(F.zip_with(F.col("v"), s["sum"], lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    own = F.filter("_s", lambda s: s["c"] == F.col("c"))[0]
    a = F.try_divide(total(own), own["n"] - 1)
    b = F.array_min(F.transform(F.filter("_s", lambda s: s["c"] != F.col("c")), lambda s: total(s) / s["n"]))
    score = F.when(own["n"] == 1, 0.0).otherwise(F.try_divide(b - a, F.greatest(a, b)))
    return v.crossJoin(listed).agg(F.avg(score).alias("silhouette"))


def _distance_sums(k: int):
    """For each asking block: of each point the sum of its distances to the points, by weight, of each of k clusters that it meets in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sums, held = None, np.zeros(0), None

        def found() -> pa.RecordBatch:
            lists = [pa.array([v], pa.list_(kind)) for v, kind in zip((*held, sums.ravel()), (pa.int64(), pa.int64(), pa.float64()), strict=True)]
            return pa.RecordBatch.from_arrays([pa.array([at]), *lists], ["block", "c", "w", "sums"])

        for batch in batches:
            for i in range(batch.num_rows):
                if (block := batch.column("block")[i].as_py()) != at:
                    if at is not None:
                        yield found()
                    at, held = block, (values(batch, "c", i), values(batch, "w", i))
                    x, centre = vectors(batch, "x", i, len(held[0])), np.array(batch.column("centre")[i].as_py())
                    sums = np.zeros((len(x), k))
                c, w = values(batch, "its_c", i), values(batch, "its_w", i)
                y = vectors(batch, "its_x", i, len(c))
                of = np.zeros((len(c), k))
                of[np.arange(len(c)), c] = w
                step = max(1, CELLS // len(c))
                for r in range(0, len(x), step):
                    square, off = squares(x[r : r + step], y, centre)
                    near = np.nonzero(square < 1e6 * off)  # products leave them too few digits
                    d = np.sqrt(np.maximum(square, 0))
                    d[near] = paired_distances(x[r : r + step], y, *near)
                    sums[r : r + step] += d @ of
        if at is not None:
            yield found()

    return run


def silhouette_euclidean(df: DataFrame, cluster: str, vector: str) -> DataFrame:
    """Mean silhouette by Euclidean distance, from all pairs: one row, null with fewer than two clusters. Rows with a null cluster or vector play no part.

    A row alone in its cluster counts 0. Equal rows of a cluster meet others once, by weight. Points lie in blocks that meet as rows of a cross join, so no point is copied by a shuffle, and a task
    holds CELLS distances at once, and for each point a sum of distances to each cluster; time grows with the square of the distinct points.
    """
    spark = df.sparkSession
    rows = df.where(F.col(cluster).isNotNull() & F.col(vector).isNotNull()).select(F.col(cluster).alias("own"), F.col(vector).cast("array<double>").alias("x"))
    points = written(rows.groupBy("own", "x").agg(F.count("*").alias("w")), "points")
    sizes = sorted((r["own"], r["n"]) for r in points.groupBy("own").agg(F.sum("w").alias("n")).collect())  # a row a cluster
    if len(sizes) < 2:
        return spark.createDataFrame([(None,)], "silhouette double")
    numbers = spark.createDataFrame([(own, i) for i, (own, _) in enumerate(sizes)], f"own {dict(points.dtypes)['own']}, c long")
    size, n = np.array([v for _, v in sizes], float), points.count()
    pivots = pivots_of(points, n)
    blocks = packed(homes(points.join(F.broadcast(numbers), "own").select("x", "c", "w"), pivots), ["c", "w"], BLOCK, parts_of(points, n, BLOCK))
    sums = meeting(blocks, blocks.drop("block"), F.lit(math.inf), 8 * n * pivots.shape[1], _distance_sums(len(size)), "block long, c array<long>, w array<long>, sums array<double>")

    def scores(found: pd.DataFrame) -> pd.DataFrame:
        c, w = found["c"].iloc[0], found["w"].iloc[0]
        total = np.sum(found["sums"].to_list(), axis=0).reshape(len(c), -1)
        row = np.arange(len(c))
        a = total[row, c] / np.maximum(size[c] - 1, 1)
        mean = total / size
        mean[row, c] = np.inf
        b = mean.min(axis=1)
        top = np.maximum(a, b)
        s = np.where((size[c] > 1) & (top > 0), (b - a) / np.where(top > 0, top, 1), 0)
        return pd.DataFrame({"s": [float((w * s).sum())]})

    return sums.groupBy("block").applyInPandas(scores, "s double").agg((F.sum("s") / F.lit(float(size.sum()))).alias("silhouette"))


def davies_bouldin(df: DataFrame, cluster: str, vector: str) -> DataFrame:
    """Mean over clusters of the worst (spread + spread) / distance of centroids."""
    middle = centroids(df, cluster, vector)
    spread = df.join(middle, cluster).groupBy(cluster).agg(F.avg(distance(F.col(vector), F.col("centroid"))).alias("spread"))
    k = middle.join(spread, cluster)
    a, b = k.select(F.col(cluster).alias("a"), F.col("centroid").alias("ca"), F.col("spread").alias("sa")), k.select(F.col(cluster).alias("b"), F.col("centroid").alias("cb"), F.col("spread").alias("sb"))
    # clusters are few; every two of them are compared
    worst = a.join(F.broadcast(b), F.col("a") != F.col("b")).groupBy("a").agg(F.max((F.col("sa") + F.col("sb")) / distance(F.col("ca"), F.col("cb"))).alias("r"))
    return worst.agg(F.avg("r").alias("davies_bouldin"))
