"""Clusterings against versions over all pairs, boosting on planted labels, keep-first on streams against the batch."""

import collections
import math
import random
import zipfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fieldglass.operators import agglomerate, boosting, clusters, density, features, language, learning, neighbours, ordered, search, topics
from fieldglass.sources import readers
from fieldglass.streaming import streams
from tests import brute


def three_densities(rng):
    x = np.concatenate([rng.normal(size=(60, 2)) * 0.2, rng.normal(size=(50, 2)) * 0.6 + [5, 0], rng.normal(size=(40, 2)) * 1.5 + [0, 9], rng.uniform(-8, 14, size=(20, 2)), np.full((5, 2), 0.01)])
    return rng.permutation(len(x)).tolist(), x


def table(spark, ids, x, more=()):
    return spark.createDataFrame([(i, v.tolist(), 1, 2.0) for i, v in zip(ids, x, strict=True)] + list(more), "id long, v array<double>, label int, core double").repartition(4)


@pytest.mark.parametrize(("least", "neighbours", "edges", "block"), [(12, 3, 1 << 20, 2048), (0.1, 5, 40, 8)])
def test_density_clusters_equal_all_pairs(spark, monkeypatch, least, neighbours, edges, block):
    monkeypatch.setattr(density, "EDGES", edges)
    monkeypatch.setattr(density, "BLOCK", block)
    ids, x = three_densities(np.random.default_rng(1))
    want = brute.hdbscan(ids, x, least if least >= 1 else int(len(x) * least), neighbours)
    assert len({c for c, _ in want.values()} - {-1}) >= 3 and -1 in {c for c, _ in want.values()}
    got = density.hdbscan(table(spark, ids, x, [(900, None, 1, 2.0)]), "id", "v", least, neighbours).collect()
    assert {r["id"]: r["cluster"] for r in got} == {i: c for i, (c, _) in want.items()} | {900: -1}
    assert all(abs(r["probability"] - want[r["id"]][1]) < 1e-9 for r in got if r["id"] != 900)


def test_density_clusters_of_little(spark):
    one = table(spark, [1], np.ones((1, 2)), [(2, None, 1, 2.0)])
    assert {tuple(r) for r in density.hdbscan(one, "id", "v", 2, 3).collect()} == {(1, -1, 0.0), (2, -1, 0.0)}
    assert density.hdbscan(one.limit(0), "id", "v", 2, 3).count() == 0
    same = table(spark, list(range(6)), np.ones((6, 2)))
    assert {r["cluster"] for r in density.hdbscan(same, "id", "v", 4, 2).collect()} == {-1}  # no split: the whole table is no cluster


@pytest.mark.parametrize(("few", "k"), [(1024, 1), (1024, 4), (16, 4), (16, 25)])
def test_average_linkage_equals_all_pairs(spark, monkeypatch, few, k):
    monkeypatch.setattr(agglomerate, "FEW", few)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(110, 6)) + rng.normal(size=(5, 6))[rng.integers(0, 5, 110)] * 2
    x = np.concatenate([x, x[:6] * 2])
    ids = rng.permutation(len(x)).tolist()
    got = {r["id"]: r["cluster"] for r in agglomerate.average_linkage(table(spark, ids, x, [(900, None, 1, 2.0), (901, [0.0] * 6, 1, 2.0)]), "id", "v", k).collect()}
    assert got == brute.average_linkage(ids, x, k) | {900: None, 901: None}


def test_boosting_stops_early_and_learns_all_classes(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(900, 4))
    y = np.where(x[:, 0] > 0, "a", np.where(x[:, 1] > 0.3, "b", "c"))
    noisy = np.where(rng.random(900) < 0.05, rng.choice(list("abc"), 900), y)
    rows = [(i, v.tolist(), str(own), bool(i % 3 == 0)) for i, (v, own) in enumerate(zip(x, noisy, strict=True))] + [(1000, None, "a", False), (1001, [0.0] * 4, None, False), (1002, [0.0] * 4, "new", True)]
    df = spark.createDataFrame(rows, "id long, v array<double>, y string, held boolean").repartition(3)
    model = boosting.boosted(df, "v", "y", F.col("held"), rounds=60, patience=4)
    assert model.classes == ["a", "b", "c"] and len(model.trees) < 60 and model.best <= len(model.trees) - 4
    losses = [r[2] for r in model.log]
    assert losses.index(min(losses)) == model.best and all(a > b for a, b in zip([r[1] for r in model.log], [r[1] for r in model.log[1:]], strict=False))
    got = {r["id"]: r for r in model.transform(df, "v").collect()}
    assert np.mean([got[i]["prediction"] == y[i] for i in range(0, 900, 3)]) > 0.95
    assert got[1000]["prediction"] is None and abs(sum(got[5]["probabilities"]) - 1) < 1e-9
    # the log's losses are those of the trees
    parts = model.binned(x[[i for i in range(900) if i % 3 == 0]])
    p = boosting._softmax(model.scores(parts, model.trees[: model.best]))
    held = [list("abc").index(noisy[i]) for i in range(0, 900, 3)]
    assert abs(-np.log(p[np.arange(300), held]).mean() - losses[model.best]) < 1e-9


def test_boosting_without_a_validation_part_uses_all_rounds(spark):
    df = spark.createDataFrame([(i, [float(i % 7), 1.0], int(i % 7 > 3)) for i in range(60)], "id long, v array<double>, y int")
    model = boosting.boosted(df, "v", "y", F.lit(False), rounds=3, depth=1)
    assert model.best == 3 and {(r["y"], r["prediction"]) for r in model.transform(df, "v").collect()} == {(0, 0), (1, 1)}
    with pytest.raises(ValueError):
        boosting.boosted(df.limit(0), "v", "y", F.lit(False))


def batch_keep_first(rows, span):
    last, out = {}, []
    for at, i, user in sorted((r[1], r[0], r[2]) for r in rows if r[1] is not None and r[0] is not None):
        if user not in last or (at - last[user]).total_seconds() > span:
            last[user] = at
            out.append((i, user))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_keep_first_on_a_stream_equals_the_batch_in_any_order_of_files(spark, tmp_path, seed):
    import datetime

    rng = random.Random(seed)
    zero = datetime.datetime(2024, 1, 1)
    rows = [(i, zero + datetime.timedelta(hours=rng.randrange(240), microseconds=rng.choice([0, 1])), rng.choice(["a", "b", None, "c"]), f"row {i}") for i in range(150)]
    rows += [(200, rows[3][1], rows[3][2], "tie"), (None, zero, "a", "no id"), (201, None, "a", "no time")]
    rng.shuffle(rows)
    kind = "event_id long, ts timestamp, user string, _key string"
    for k in range(6):
        spark.createDataFrame(rows[k::6], kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    closing = spark.createDataFrame([(999, zero + datetime.timedelta(days=4000), "z", "last")], kind)
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    found = streams.keep_first(stream, ["user"], "ts", "event_id", "1 day", "30 days")
    run = lambda: found.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    (first := run()).awaitTermination()
    held = max(p["stateOperators"][0]["numRowsTotal"] for p in first.recentProgress if p["stateOperators"])
    closing.write.mode("append").parquet(f"{tmp_path}/in")
    (second := run()).awaitTermination()
    got = spark.read.schema(kind).parquet(f"{tmp_path}/out").collect()
    assert sorted(((r["event_id"], r["user"]) for r in got), key=str) == batch_keep_first(rows, 86400)
    assert {r["event_id"]: (r["ts"], r["_key"]) for r in got}.items() <= {r[0]: (r[1], r[3]) for r in rows}.items()
    left = [p["stateOperators"][0]["numRowsTotal"] for p in second.recentProgress if p["stateOperators"]][-1]
    assert held == 4 and left == 1  # only the closing event's user is still known


def test_language_odds_equal_brute_force(spark):
    rows = [("a", "The cat sat"), ("a", "the mat É"), ("b", "le chat"), ("b", None), (None, "the"), ("b", "")]
    model = language.learned(spark.createDataFrame(rows, "lang string, text string").repartition(3), "text", "lang")
    assert model.names == ["a", "b"] and np.allclose(np.exp(model.prior), [0.5, 0.5])
    count = collections.defaultdict(collections.Counter)
    for name, text in rows:
        if name and text is not None:
            count[name].update(language.slots(text).tolist())
    for k, name in enumerate("ab"):
        total = sum(count[name].values()) + language.SLOTS
        assert all(math.isclose(math.exp(model.table[k, s]), (count[name][s] + 1) / total) for s in [*count["a"], *count["b"], 7])
    b = b" abca "
    assert len(language.slots("ABCA")) == len(b) - 2 and (language.slots("abca") == language.slots("ABCA")).all() and len(language.slots("")) == 0
    asked = spark.createDataFrame([(1, "the the cat"), (2, "le chat"), (3, None), (4, "12 !"), (5, "le " * 5000)], "id int, text string")
    got = {r["id"]: (r["language"], r["probability"]) for r in model.detect(asked, "text").collect()}
    assert [got[k][0] for k in range(1, 6)] == ["a", "b", None, None, "b"] and got[3][1] is None
    s = model.scores("le chat")
    assert math.isclose(got[2][1], math.exp(s[1]) / (math.exp(s[0]) + math.exp(s[1])), rel_tol=1e-9)
    with pytest.raises(ValueError):
        language.learned(asked.selectExpr("text", "cast(null as string) as lang"), "text", "lang")


def test_mini_batches_move_centres_by_their_counts(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=(200, 3)) * 0.1 + c for c in ([0, 0, 0], [5, 0, 0], [0, 5, 0])])
    df = table(spark, list(range(600)), x, [(900, None, 1, 2.0)])
    centres = clusters.kmeans_minibatch(df, "v", 3, 100)
    assert np.allclose(sorted(centres.round(1).tolist()), [[0, 0, 0], [0, 5, 0], [5, 0, 0]], atol=0.15)
    got = {r["id"]: r["cluster"] for r in clusters.assigned(df, "v", centres).collect()}
    assert got.pop(900) is None and all(len({got[i] for i in range(a, a + 200)}) == 1 for a in (0, 200, 400)) and len(set(got.values())) == 3
    assert len(clusters.kmeans_minibatch(table(spark, [1, 2], np.ones((2, 2))), "v", 3, 10)) == 1
    assert len(clusters.kmeans_minibatch(df.limit(0), "v", 3, 10)) == 0


def test_ranges_part_values_with_a_long_common_beginning(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # which joins ranges while they are small
    values = [f"Customer#{k:09d}" for k in range(400)]
    df = spark.createDataFrame([(v, k) for k, v in enumerate(values)], "v string, k int").repartition(5)
    got = ordered.running(df, [], [F.col("v")], {"upto": F.lit(1)}).collect()
    assert all(r["upto"] == r["k"] + 1 and r["upto_all"] == 400 for r in got)
    rows = ordered.written(df.repartitionByRange("v").withColumn("block", F.spark_partition_id())).groupBy("block").count().collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(rows) > 4 and max(r["count"] for r in rows) < 150


def test_columns_with_the_names_of_helpers_keep_their_values(spark):
    df = spark.createDataFrame([(i, i % 3, i + 0.5, -i, [float(i), 1.0], i * 2, 7, 8, 9) for i in range(30)], "key int, label int, _block double, _top int, _v array<double>, _text int, _hash int, _upto int, _least int")
    value = {r["key"]: tuple(r) for r in df.collect()}
    assert all(tuple(r) == value[r["key"]] for r in learning.random_oversample(df.where("key < 25"), "key", "label").collect())
    assert all(tuple(r)[:-1] == value[r["key"]] for r in learning.split_stratified(df, "key", "label", [("a", 0.5), ("b", 0.5)]).collect())
    assert all(tuple(r)[:-1] == value[r["key"]] for r in learning.balanced(df, "key", "label", 0.5).collect())
    assert all(tuple(r)[:-1] == value[r["key"]] for r in features.label_encode(df, "label", "code").collect())
    assert all(tuple(r)[:-1] == value[r["key"]] for r in clusters.kmeans_cluster(df, "_v", 2).collect())
    assert all(tuple(r) == value[r["key"]] for r in features.without_outliers(df, "_top").collect())


def test_curves_of_each_class(spark):
    rows = [("a", 0.9, 0.1), ("a", 0.8, 0.4), ("b", 0.8, 0.6), ("b", 0.1, None), (None, 0.5, 0.5)]
    found = learning.class_scores(spark.createDataFrame(rows, "t string, x double, y double"), "t", {"a": F.col("x"), "b": F.col("y"), "c": F.lit(0.5)})
    got = {r["class"]: (r["auc"], r["average_precision"]) for r in learning.class_areas(found).collect()}
    assert got["a"] == pytest.approx((7 / 8, 0.5 + 0.5 * 2 / 3)) and got["b"] == pytest.approx((1, 1)) and got["c"] == (None, None)
    assert got[None] == pytest.approx((15 / 16, (0.5 + 1 / 3 + 1) / 2))
    assert {tuple(r)[1:] for r in learning.class_curves(found).where("class = 'a'").collect()} == {(0.9, 0.5, 0.0, 1.0), (0.8, 1.0, 0.5, 2 / 3), (0.1, 1.0, 1.0, 0.5)}


def test_sentences_keep_the_case_of_names(spark):
    names = spark.createDataFrame([("berlin",), ("mary",), ("mary",)], "word string")
    rows = [(1, "The Cat, in (Berlin), Rome/Mary saw <b>Mary's</b> x 12 http://a.b"), (1, "MARY berlin Mary."), (2, None), (3, ""), (4, "!! 7")]
    got = topics.sentences_with_names(spark.createDataFrame(rows, "id int, text string"), "id", "text", names).collect()
    assert collections.Counter(tuple(r) for r in got) == collections.Counter([(1, "the cat in Berlin rome Mary saw marys"), (1, "MARY berlin Mary"), (2, None), (3, ""), (4, "")])


def test_zipped_csv_is_read_back_by_member(spark, tmp_path):
    for k in range(3):
        with zipfile.ZipFile(tmp_path / f"part{k}.zip", "w") as z:
            z.writestr("a.csv", 'id,name,score,more\n' + "".join(f'{10 * k + i},"x, ""{i}""\ny",{i}.5,z\n' for i in range(3)))
            z.writestr("b/b.csv", f"name,id\n,{10 * k + 9}\nq,bad\n")
            z.writestr("notes.txt", "id\n5\n")
    df = readers.read_zipped_csv(spark, str(tmp_path), "id long, name string, score double")
    want = [(10 * k + i, f'x, "{i}"\ny', i + 0.5) for k in range(3) for i in range(3)] + [x for k in range(3) for x in ((10 * k + 9, None, None), (None, "q", None))]
    assert collections.Counter(tuple(r) for r in df.collect()) == collections.Counter(want)
    assert df.rdd.getNumPartitions() == 6
    assert {r["score"] for r in readers.read_zipped_csv(spark, f"file://{tmp_path}/part1.zip", "score float").collect()} == {0.5, 1.5, 2.5, None}


def test_representatives_and_words_of_bins(spark):
    rows = [(1, "t", 0, "red red blue"), (2, "t", 0, "red blue"), (3, "t", 1, "green green"), (4, "u", 0, "grey"), (5, None, 0, "red"), (6, "t", None, "blue"), (7, "t", 0, None), (8, "t", 0, "")]
    df = spark.createDataFrame(rows, "id int, topic string, bin int, text string")
    got = {(r["topic"], r["bin"], r["rank"]): r["term"] for r in topics.evolving_words(df, "topic", "bin", "text", 2).collect()}
    assert got == {("t", 0, 1): "red", ("t", 0, 2): "blue", ("t", 1, 1): "green", ("t", 1, 2): "red", ("u", 0, 1): "grey"}
    best = topics.representatives(df, "topic", "id", "text", 1).collect()
    assert {(r["topic"], r["rank"]) for r in best} == {("t", 1), ("u", 1)} and next(r for r in best if r["topic"] == "u")["similarity"] == 1.0


def test_facts_of_a_clustering_equal_those_by_hand(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(c, 0.3, (n, 2)) for c, n in ((0, 8), (4, 6), (9, 3))])
    cluster = [1] * 8 + [2] * 6 + [-1] * 3
    text = ["the cat sat"] * 8 + ["der hund", None] * 3 + ["outlier words"] * 3
    rows = [*zip(cluster, x.tolist(), text, strict=True), (None, [0.0, 0.0], "lost"), (1, None, "lost")]
    df = spark.createDataFrame(rows, "cluster int, v array<double>, t string").withColumns({"size": F.lit(7), "words": F.lit("w")})
    got = search.clustering_facts(df, "cluster", "v", "t", {"feline": ["cat"], "german": ["der"]}, 2, 2).first()
    assert (got["rows"], got["clusters"], got["outliers"], got["meets"]) == (19, 2, 5, True) and abs(got["outlier_share"] - 5 / 19) < 1e-12
    assert [(r["cluster"], r["size"], sorted(r["words"])) for r in got["topics"]] == [(1, 8, ["cat", "sat"]), (2, 6, ["der", "hund"])]
    a, b = x[:8], x[8:14]
    far = lambda p, q: np.sqrt(((p - q) ** 2).sum(-1))
    spread = far(a, a.mean(0)).mean() + far(b, b.mean(0)).mean()
    assert abs(got["davies_bouldin"] - spread / far(a.mean(0), b.mean(0))) < 1e-9
    square = ((x[:14, None] - x[None, :14]) ** 2).sum(-1)
    one = np.arange(14) < 8
    s = []
    for i in range(14):
        own, other = one == one[i], one != one[i]
        p, q = square[i, own].sum() / (own.sum() - 1), square[i, other].mean()
        s.append((q - p) / max(p, q))
    assert abs(got["silhouette"] - np.mean(s)) < 1e-9
    none = search.clustering_facts(df.where("cluster = -1"), "cluster", "v", "t", {"english": ["the"]}).first()
    assert (none["clusters"], none["outliers"], none["silhouette"], none["davies_bouldin"], none["meets"], none["topics"]) == (0, 3, None, None, False, [])


def test_near_points_and_trees_copy_no_point_to_each_cell(spark, monkeypatch):
    """In 40 dimensions no cell can be left out: what blocks give stays near the number of points, and points go through no shuffle but those that sort them."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(900, 40))
    points = spark.createDataFrame([(v.tolist(), i, 1) for i, v in enumerate(x)], "x array<double>, label long, w long")
    seen = []
    real = neighbours.meeting
    monkeypatch.setattr(neighbours, "meeting", lambda *a: seen.append(real(*a)) or seen[-1])
    got = neighbours.nearest_points(points.select("x"), points, 3)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    found = {}
    for r in got.collect():
        found.setdefault(tuple(r["x"]), []).append((r["d"], r["label"]))
    for i, v in enumerate(x):
        assert [j for _, j in sorted(found[tuple(v)])] == d[i].argsort(kind="stable")[:3].tolist()
    assert seen and seen[0].count() <= 3 * len(x) and "CartesianProduct" in seen[0]._jdf.queryExecution().toString()


def test_only_clusters_whose_nearest_is_gone_look_again(spark, monkeypatch):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(150, 8))
    monkeypatch.setattr(agglomerate, "FEW", 16)
    asked, real = [], agglomerate.nearest_clusters
    monkeypatch.setattr(agglomerate, "nearest_clusters", lambda now, of=None: asked.append((now.count(), None if of is None else of.count())) or real(now, of))
    ids = list(range(len(x)))
    got = {r["id"]: r["cluster"] for r in agglomerate.average_linkage(table(spark, ids, x), "id", "v", 7).collect()}
    assert got == brute.average_linkage(ids, x, 7)
    assert asked[0][1] is None and all(of < n for n, of in asked[1:]) and len(asked) > 1


def test_rounds_of_little_work_are_made_by_one_task(spark, monkeypatch):
    rng = np.random.default_rng(10)
    x = np.concatenate([rng.normal(size=(120, 5)), rng.integers(-1, 2, size=(80, 5)) + 0.0, np.eye(5)])
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    x = np.unique(x[np.abs(x).sum(axis=1) > 0], axis=0)
    x = x[rng.permutation(len(x))]
    rows = pd.DataFrame({"name": np.arange(len(x)) * 3, "n": 1, "total": list(x), "other": np.full(len(x), np.nan), "height": np.nan})
    want = agglomerate._ended(rows.copy())
    monkeypatch.setattr(agglomerate, "FEW", 16)
    monkeypatch.setattr(agglomerate, "AT_ONCE", 1000)
    d = np.round(1 - x @ x.T, 12)
    np.fill_diagonal(d, np.inf)
    known = rows.assign(other=d.argmin(axis=1) * 3.0, height=d.min(axis=1))
    known.loc[::4, ["other", "height"]] = np.nan
    columns = ["height", "parent", "name"]
    for got in (agglomerate._ended(rows), agglomerate._ended(known)):
        pd.testing.assert_frame_equal(got.sort_values(columns)[columns].reset_index(drop=True), want.sort_values(columns)[columns].reset_index(drop=True))
    # 205 clusters of FEW = 64 need no round of Spark's
    monkeypatch.setattr(agglomerate, "FEW", 64)
    monkeypatch.setattr(agglomerate, "nearest_clusters", None)
    got = {r["id"]: r["cluster"] for r in agglomerate.average_linkage(table(spark, list(range(len(x))), x), "id", "v", 7).collect()}
    assert got == brute.average_linkage(list(range(len(x))), x, 7)
