"""Hierarchical density clustering: core distances, a minimum spanning tree of mutual reachability, a condensed tree, clusters by stability.

The tree comes from rounds in which every component but the largest finds its lightest edge to another one. Most have it among the edges to near points, which are listed once; points that may have
a lighter one meet the others in blocks, so that no table of all pairs is made and no point is copied by a shuffle. The edges are then taken in order of weight, in blocks of a bounded
number of edges whose ends are the components so far: one task merges a block, and the labels of all points move on by a join. Clusters of at least
`least` points are nodes of the condensed tree; there are fewer than 2 * rows / least, and only these come to the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldglass.operators.neighbours import ASKING, BLOCK, homes, meeting, nearest_points, packed, paired_distances, parts_of, pivots_of, squares, values, vectors
from fieldglass.operators.shared import written

#: Edges of a block that one task merges, the least distance, so that its inverse is a number, and near points of each that are listed.
EDGES, TINY, LISTED = 1 << 20, 1e-9, 16


def core_distances(points: DataFrame, neighbours: int) -> tuple[DataFrame, DataFrame]:
    """points (id, x) with core, the distance to the nearest `neighbours`-th other point (to the farthest, if there are fewer), and known, a distance below which all other points
    are among the edges; and the edges to near points: a, b, w (the mutual reachability), from either end."""
    distinct = written(points.groupBy("x").agg(F.min("id").alias("label"), F.count("*").alias("w")), "distinct")
    k = max(LISTED, neighbours) + 1
    near = written(nearest_points(distinct.select("x"), distinct, k).join(distinct.select("x", F.col("label").alias("own")), "x").select("own", "d", "label", "w"), "near")
    upto = Window.partitionBy("own").orderBy("d", "label").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    core = F.coalesce(F.min(F.when(F.col("n") > neighbours, F.col("d"))), F.max("d")).alias("core")
    # of equal points only one is listed
    known = F.least(F.when(F.count("*") >= k, F.max("d")).otherwise(math.inf), F.coalesce(F.min(F.when(F.col("w") > 1, F.col("d"))), F.lit(math.inf))).alias("known")
    far = written(near.withColumn("n", F.sum("w").over(upto)).groupBy("own").agg(core, known), "far")
    ends = near.where("own <> label").join(far.select("own", F.col("core").alias("p")), "own").join(far.select(F.col("own").alias("label"), F.col("core").alias("q")), "label")
    edges = ends.select(F.col("own").alias("a"), F.col("label").alias("b"), F.greatest("d", "p", "q").alias("w"))
    edges = written(edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "w")), "known")
    return points.join(distinct.select("x", F.col("label").alias("own")), "x").join(far, "own").select("id", "x", "core", "known"), edges


def _lightest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each component that has points in an asking block: its lightest edge to a point of another one in the blocks met; of equal ones the one with the smallest ids."""
    at, top = None, None

    def found() -> pa.RecordBatch:
        own, w, a, b, other = top
        return pa.RecordBatch.from_arrays([pa.array(v) for v in (names[own], w, a, b, other)], ["label", "w", "a", "b", "other"])

    for batch in batches:
        for i in range(batch.num_rows):
            if (block := batch.column("block")[i].as_py()) != at:
                if top is not None:
                    yield found()
                at, top = block, None
                gid, gcore, glabel, gbound = (values(batch, c, i) for c in ("id", "core", "label", "bound"))
                gx, centre = vectors(batch, "x", i, len(gid)), np.array(batch.column("centre")[i].as_py())
                names, own = np.unique(glabel, return_inverse=True)
                best = np.full(len(names), np.inf)  # squares
                np.minimum.at(best, own, gbound**2)
            ids, core, label = (values(batch, f"its_{c}", i) for c in ("id", "core", "label"))
            x = vectors(batch, "its_x", i, len(ids))
            square, off = squares(gx, x, centre)
            np.maximum(square, (core**2)[None], out=square)
            np.maximum(square, (gcore**2)[:, None], out=square)
            square[glabel[:, None] == label[None]] = np.inf
            np.minimum.at(best, own, square.min(axis=1) + off)
            g, p = np.nonzero((square <= (best * (1 + 1e-9) + 2 * off)[own][:, None]) & (square < np.inf))
            w = np.maximum(np.maximum(paired_distances(gx, x, g, p), gcore[g]), core[p])
            new = own[g], w, np.minimum(gid[g], ids[p]), np.maximum(gid[g], ids[p]), label[p]
            new = new if top is None else tuple(np.concatenate(v) for v in zip(top, new, strict=True))
            order = np.lexsort((new[3], new[2], new[1], new[0]))
            first = order[np.flatnonzero(np.diff(new[0][order], prepend=-1) != 0)]
            top = tuple(v[first] for v in new)
            best[top[0]] = np.minimum(best[top[0]], top[1] ** 2)
    if top is not None:
        yield found()


def roots(parents: DataFrame) -> DataFrame:
    """(name, root) for a table (name, parent) without cycles but name = parent: jumps of doubled length until none moves."""
    now = written(parents.select("name", F.col("parent").alias("root")), "roots")
    while True:
        step = now.select(F.col("name").alias("root"), F.col("root").alias("next"))
        new = written(now.join(step, "root", "left").select("name", F.coalesce("next", "root").alias("root"), (F.col("next") != F.col("root")).alias("moved")), "roots")
        now = new.select("name", "root")
        if new.where("moved").isEmpty():
            return now


def spanning_tree(points: DataFrame, edges: DataFrame) -> DataFrame:
    """a, b, w: the minimum spanning tree of points (id, x, core, known) by mutual reachability; of equal edges the one with the smallest ids counts as lighter. edges: a, b, w, the known ones.

    In each round every component but the largest takes its lightest edge. Only points that could have an edge beyond the known ones as light as the lightest known one of their component look for it.
    """
    n, tree = points.count(), None
    pivots = pivots_of(points, n) if n else None
    placed = written(homes(points, pivots).drop("far"), "placed") if n else points
    names = points.select("id", F.col("id").alias("label"))
    while True:
        sizes = names.groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label").limit(2).collect()
        if len(sizes) < 2:
            return tree if tree is not None else points.sparkSession.createDataFrame([], "a long, b long, w double")
        small = F.col("label") != sizes[0]["label"]
        now = written(placed.join(names, "id"), "points")
        ends = edges.join(names.withColumnsRenamed({"id": "a"}), "a").join(names.select(F.col("id").alias("b"), F.col("label").alias("other")), "b").where("label <> other")
        edges = written(ends.select("a", "b", "w", "label", "other"), "known")
        least = F.min(F.struct("w", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "other")).alias("e")
        listed = written(edges.where(small).groupBy("label").agg(least).select("label", "e.*"), "listed")
        edges = edges.select("a", "b", "w")
        bound = F.coalesce("w", F.lit(math.inf))
        asking = now.where(small).join(listed.select("label", "w"), "label", "left").withColumn("bound", bound).where(F.greatest("known", "core") <= bound * (1 + 1e-9))
        asking = written(asking.select("x", "cell", "id", "core", "label", "bound"), "asking")
        if many := asking.count():
            held = packed(now, ["id", "core", "label"], BLOCK, parts_of(now, n, BLOCK)).drop("block")
            guests = packed(asking, ["id", "core", "label", "bound"], ASKING, parts_of(now, many, ASKING))
            more = meeting(guests, held, F.array_max("bound"), 8 * n * pivots.shape[1], _lightest, "label long, w double, a long, b long, other long")
            listed = listed.unionByName(more)
        best = written(listed.groupBy("label").agg(F.min(F.struct("w", "a", "b", "other")).alias("e")).select("label", "e.*"), "edges")
        taken = best.select("a", "b", "w").distinct()
        tree = taken if tree is None else tree.unionAll(taken)
        # two components that chose the same edge: the smaller name leads
        back = best.select(F.col("label").alias("other"), F.col("other").alias("label"), F.lit(True).alias("mutual"))
        leads = F.col("mutual").isNotNull() & (F.col("label") < F.col("other"))
        heads = best.join(back, ["label", "other"], "left").select(F.col("label").alias("name"), F.when(leads, F.col("label")).otherwise(F.col("other")).alias("parent"))
        top = roots(heads).withColumnsRenamed({"name": "label", "root": "new"})
        names = written(names.join(top, "label", "left").select("id", F.coalesce("new", "label").alias("label")), "labels")


def _merged(least: int, block: int):
    """Merges a block of edges in order. Rows: kind 0, a component as the block began: its name now, its size and node at the end, and the distance and
    node at which it became part of a large one, if it did so here; kind 1, a node of the condensed tree: its first child or none, and the distance of its birth."""

    def run(edges: pd.DataFrame) -> pd.DataFrame:
        edges = edges.sort_values(["w", "a", "b"])
        parent: dict[int, int] = {}
        size: dict[int, int] = {}
        node: dict[int, int] = {}
        members: dict[int, list[int]] = {}
        for end in ("a", "b"):
            for label, n, own in zip(edges[f"label_{end}"].tolist(), edges[f"size_{end}"].tolist(), edges[f"node_{end}"].tolist(), strict=True):
                parent[label], size[label], node[label] = label, n, own
                members[label] = [label]
        entered: dict[int, tuple[float, int]] = {}
        nodes: list[tuple] = []

        def root(v: int) -> int:
            while parent[v] != v:
                parent[v] = parent[parent[v]]
                v = parent[v]
            return v

        for w, p, q in zip(edges["w"].tolist(), edges["label_a"].tolist(), edges["label_b"].tolist(), strict=True):
            p, q = root(p), root(q)
            n, old = size[p] + size[q], (node[p], node[q])
            if n >= least:
                if min(old) < 0 and max(old) >= 0:
                    now = max(old)  # a large one takes in a small one
                else:
                    now = (block << 24) + len(nodes)
                    nodes.append((now, w, n, *old))
                for v, own in zip((p, q), old, strict=True):
                    if own < 0:
                        entered.update(dict.fromkeys(members[v], (w, now)))
                        members[v] = []
            else:
                now = -1
            if len(members[p]) < len(members[q]):
                p, q = q, p
            parent[q], size[p], node[p] = p, n, now
            members[p] += members.pop(q)
        out = [(0, v, r := root(v), size[r], node[r], *entered.get(v, (math.nan, -1)), -1, -1) for v in parent]
        out += [(1, -1, -1, n, now, w, -1, x, y) for now, w, n, x, y in nodes]
        return pd.DataFrame(out, columns=["kind", "label", "name", "size", "node", "distance", "entered", "left", "right"])

    return run


def condensed(tree: DataFrame, points: DataFrame, least: int) -> tuple[DataFrame, list]:
    """(id, distance, node) of each point that is ever in a component of `least` points or more, and the nodes: node, birth distance, size at birth, left, right (-1: none)."""
    n = points.count()
    blocks = max(1, -(-n // EDGES))
    edges = written(tree.repartitionByRange(blocks, "w", "a", "b").withColumn("block", F.spark_partition_id()), "tree")
    now = points.select("id", F.col("id").alias("label"), F.lit(1).cast("long").alias("size"), F.lit(-1).cast("long").alias("node"), F.lit(None).cast("double").alias("distance"), F.lit(-1).cast("long").alias("entered"))
    kind = "kind int, label long, name long, size long, node long, distance double, entered long, left long, right long"
    nodes: list = []
    for block in sorted(r["block"] for r in edges.select("block").distinct().collect()):
        ends = edges.where(F.col("block") == block)
        for end in ("a", "b"):
            ends = ends.join(now.select(F.col("id").alias(end), *(F.col(c).alias(f"{c}_{end}") for c in ("label", "size", "node"))), end)
        # EDGES rows, about
        done = written(ends.groupBy("block").applyInPandas(_merged(least, block), kind), "merged")
        nodes += [(r["node"], r["distance"], r["size"], r["left"], r["right"]) for r in done.where("kind = 1").collect()]
        moves = done.where("kind = 0").select("label", "name", F.col("size").alias("s"), F.col("node").alias("o"), F.col("distance").alias("d"), F.col("entered").alias("e"))
        first = (F.col("entered") < 0) & (F.col("e") >= 0)
        now = now.join(moves, "label", "left").select(
            "id", F.coalesce("name", "label").alias("label"), F.coalesce("s", "size").alias("size"), F.coalesce("o", "node").alias("node"),
            F.when(first, F.col("d")).otherwise(F.col("distance")).alias("distance"), F.when(first, F.col("e")).otherwise(F.col("entered")).alias("entered"),
        )
        now = written(now, "labels")
    return now.where("entered >= 0").select("id", "distance", F.col("entered").alias("node")), nodes


def chosen(nodes: list, direct: dict[int, tuple[int, float]]) -> dict[int, int]:
    """For each node the chosen cluster it belongs to, if any. direct: points that enter at a node, and the sum of their inverse distances.

    A cluster's stability is the sum over its points of how long they stay: from its end (when it joins another large one) down to the distance at which they enter.
    From the leaves up, a cluster is chosen if it is at least as stable as the best choice below it; the root is not.
    """
    inverse = lambda d: 1 / max(d, TINY)
    up = {child: now for now, *_, left, right in nodes for child in (left, right) if child >= 0}
    birth = {now: d for now, d, *_ in nodes}
    order = sorted(nodes, key=lambda x: (x[1], x[0]))  # children come before parents
    value: dict[int, float] = {}
    own: dict[int, bool] = {}
    held: dict[int, int] = {}  # points that enter at a node or below it
    for now, d, _, left, right in order:
        ends = inverse(birth[up[now]]) if now in up else 0.0
        count, total = direct.get(now, (0, 0.0))
        below = [c for c in (left, right) if c >= 0]
        stays = total - count * ends
        stays += sum(held[c] for c in below) * (inverse(d) - ends)
        held[now] = count + sum(held[c] for c in below)
        best = sum(value[c] for c in below)
        own[now] = now in up and (not below or stays >= best)
        value[now] = stays if own[now] else best
    cluster: dict[int, int] = {}
    for now, *_ in reversed(order):
        above = cluster.get(up.get(now, -1))
        if above is not None:
            cluster[now] = above
        elif own[now]:
            cluster[now] = now
    return cluster


def reachability_tree(df: DataFrame, id_col: str, vector: str, min_samples: int) -> tuple[DataFrame, DataFrame]:
    """Points (id, x, core, known) of the rows with a vector, and their minimum spanning tree of mutual reachability: a, b, w. A core distance is that to the min_samples-th other row.

    It doesn't depend on the least size of a cluster, so clusters of several sizes can come from one tree.
    """
    points = written(df.where(F.col(vector).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("x")), "vectors")
    points, edges = core_distances(points, min_samples)
    points = written(points, "cores")
    return points, spanning_tree(points, edges)


def hdbscan(df: DataFrame, id_col: str, vector: str, min_cluster: float, min_samples: int, tree: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """id, cluster, probability for each row: cluster is its smallest id, -1 is noise.

    A cluster has min_cluster of all rows at least (a share below 1, or a number), and two rows. A core distance is that to the min_samples-th other row. The whole
    table is never one cluster: without any split all is noise. probability is a row's inverse entry distance against the largest of its cluster, 0 for noise. Rows
    with a null vector are noise and not counted. Equal vectors have distance 0, which counts as 1e-9 where it is inverted. tree: the reachability_tree of these rows, if it is there.
    """
    n = df.where(F.col(vector).isNotNull()).count()
    least = max(2, int(n * min_cluster) if min_cluster < 1 else int(min_cluster))
    kept = df.select(F.col(id_col).cast("long").alias(id_col))
    if n < 2:
        return kept.select(id_col, F.lit(-1).cast("long").alias("cluster"), F.lit(0.0).alias("probability"))
    points, edges = tree or reachability_tree(df, id_col, vector, min_samples)
    entries, nodes = condensed(edges, points, least)
    strength = (1 / F.greatest("distance", F.lit(TINY))).alias("strength")
    entries = written(entries.select("id", "node", strength), "entries")
    direct = {r["node"]: (r["n"], r["s"]) for r in entries.groupBy("node").agg(F.count("*").alias("n"), F.sum("strength").alias("s")).collect()}  # a row a node
    cluster = chosen(nodes, direct)
    if not cluster:
        return kept.select(id_col, F.lit(-1).cast("long").alias("cluster"), F.lit(0.0).alias("probability"))
    names = df.sparkSession.createDataFrame(list(cluster.items()), "node long, top long")
    member = entries.join(F.broadcast(names), "node")
    tops = member.groupBy("top").agg(F.min("id").alias("cluster"), F.max("strength").alias("most"))
    member = member.join(F.broadcast(tops), "top").select(F.col("id").alias(id_col), "cluster", (F.col("strength") / F.col("most")).alias("probability"))
    return kept.join(member, id_col, "left").select(id_col, F.coalesce("cluster", F.lit(-1)).alias("cluster"), F.coalesce("probability", F.lit(0.0)).alias("probability"))
