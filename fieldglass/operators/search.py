"""A search over settings of density clusters of texts, with all that is needed to choose one."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldglass.operators.clusters import davies_bouldin, pca_reduce, silhouette
from fieldglass.operators.density import hdbscan, reachability_tree
from fieldglass.operators.shared import shared_dir, written
from fieldglass.operators.topics import ctfidf, topic_words, topics_meet_criteria


def clustering_facts(rows: DataFrame, cluster: str, vector: str, text: str, groups: Mapping[str, Sequence[str]], n: int = 10, least_topics: int = 3) -> DataFrame:
    """One row: rows, clusters, outliers, outlier_share, silhouette and davies_bouldin without outliers, meets, topics (cluster, size, its n best words; large first).

    Outliers are in cluster -1; a null cluster or vector counts as one. The two measures are null with fewer than two clusters. A null text adds no words, and a
    cluster without words has an empty list. meets: every keyword group is among the words of some topic, of at least least_topics topics together.
    """
    known = F.col(vector).isNotNull() & F.col(cluster).isNotNull() & (F.col(cluster) != -1)
    rows = rows.select(F.when(known, F.col(cluster)).alias("cluster"), F.col(vector).alias("vector"), F.col(text).alias("text"))
    inner = rows.where("cluster is not null")
    counts = rows.agg(F.count("*").alias("rows"), F.countDistinct("cluster").alias("clusters"), F.count_if(F.col("cluster").isNull()).alias("outliers"))
    words = written(topic_words(ctfidf(inner, "cluster", "text"), "cluster", n), "words")
    lists = words.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda s: s["term"]).alias("words"))
    each = inner.groupBy("cluster").agg(F.count("*").alias("size")).join(lists, "cluster", "left")
    listed = F.struct((-F.col("size")).alias("order"), "cluster", "size", F.coalesce("words", F.array().cast("array<string>")).alias("words"))
    # a least size that is a share of all rows bounds the number of clusters
    topics = each.agg(F.transform(F.array_sort(F.collect_list(listed)), lambda s: F.struct(s["cluster"], s["size"], s["words"])).alias("topics"))
    two = F.col("clusters") >= 2
    out = counts.join(silhouette(inner, "cluster", "vector")).join(davies_bouldin(inner, "cluster", "vector")).join(topics_meet_criteria(words, "cluster", groups, least_topics)).join(topics)  # a row each
    return out.select(
        "rows", "clusters", "outliers", F.try_divide("outliers", "rows").alias("outlier_share"), F.when(two, F.col("silhouette")).alias("silhouette"),
        F.when(two, F.col("davies_bouldin")).alias("davies_bouldin"), "meets", "topics",
    )


def topic_search(
    docs: DataFrame, id_col: str, text: str, vector: str, settings: Sequence[tuple[int, float, int]], groups: Mapping[str, Sequence[str]], least_topics: int = 3
) -> DataFrame:
    """The log of a search: of each setting (components, least share of a cluster, neighbours) the clustering_facts.

    Vectors are reduced once for each number of components, and their spanning tree is found once for each number of neighbours; each result is appended to the log as it comes, so a lost driver leaves what was found. id_col: unique.
    """
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/search-{uuid.uuid4().hex}"
    reduced, trees = {}, {}
    for components, share, neighbours in settings:
        if components not in reduced:
            rows = docs.where(F.col(vector).isNotNull()).select(id_col, text, vector)
            reduced[components] = written(pca_reduce(rows, vector, components, "point").select(id_col, text, "point"), "reduced")
        if (components, neighbours) not in trees:
            trees[components, neighbours] = reachability_tree(reduced[components], id_col, "point", neighbours)
        found = hdbscan(reduced[components], id_col, "point", share, neighbours, trees[components, neighbours]).select(id_col, "cluster")
        rows = written(reduced[components].join(found, id_col), "clusters")
        facts = clustering_facts(rows, "cluster", "point", text, groups, least_topics=least_topics)
        setting = {"components": F.lit(components), "least_share": F.lit(share), "neighbours": F.lit(neighbours)}
        facts.select(*(v.alias(k) for k, v in setting.items()), "*").write.mode("append").parquet(path)
    return spark.read.parquet(path)
