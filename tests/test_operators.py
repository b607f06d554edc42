"""Hand-computed cases of the table, text, window, join and evaluation operators."""

import datetime
import math
import random

import pytest
from pyspark.sql import functions as F

from fieldglass.functions import text as X
from fieldglass.operators import clean, clusters, features, frames, learning, neighbours, tables, topics, windows
from fieldglass.sources import scorers, sinks


def values(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def test_bins_at_exact_edges(spark):
    df = spark.createDataFrame([(float(x),) for x in (0, 1, 2, 5, 9, 10)], "x double")
    assert values(features.discretize(df, "x", 5), "x") == [(0,), (0,), (0,), (2,), (4,), (4,)]
    assert sorted(values(tables.histogram(df, "x", 5), "bin", "n")) == [(0, 2), (1, 1), (2, 1), (4, 2)]


def test_constant_column_and_nulls(spark):
    df = spark.createDataFrame([(5.0,), (5.0,), (None,)], "x double")
    assert values(features.normalize_minmax(df, "x"), "x") == [(None,), (None,), (None,)]
    assert values(features.normalize_minmax(df, "x", 0.0), "x") == [(0.0,), (0.0,), (None,)]
    assert values(features.standardize(df, "x"), "x") == [(None,), (None,), (None,)]
    assert values(features.binarize(df, "x", 4), "x") == [(1,), (1,), (0,)]


def test_race_codes(spark):
    rows = [(None, None, None), (1, None, None), (1, 1, None), (None, 1, 1), (None, None, 1)]
    df = spark.createDataFrame(rows, "a int, b int, h int")
    assert values(df, features.merge_flags({1: F.col("a"), 2: F.col("b")}, F.col("h"))) == [(None,), (1,), (7,), (7,), (6,)]


def test_negations(spark):
    df = spark.createDataFrame([("not not good",), ("no",), ("never again",), ("",)], "t string")
    assert values(df, X.handle_negations(X.tokens(F.col("t")))) == [(["not_good"],), ([],), (["not_again"],), ([],)]


def test_keep_first(spark):
    df = spark.createDataFrame([("k", "b", 2), ("k", "a", 1), (None, "z", 3), (None, "y", 4)], "k string, v string, i int")
    assert sorted(values(clean.keep_first(df, ["k"], ["i"]), "k", "v", "i"), key=str) == [("k", "a", 1), (None, "z", 3)]


def test_lag_runs_along_the_order(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 3.0), ("a", 3, 8.0), ("b", 1, 5.0)], "p string, o int, x double")
    w = windows.along(["p"], ["o"])
    out = windows.moving_average(windows.diff_features(windows.lag_features(df, ["x"], [1], w), ["x"], w), ["x"], 2, w)
    assert sorted(values(out, "p", "o", "x_lag1", "x_diff", "x_ma2"), key=str) == [("a", 1, None, None, None), ("a", 2, 1.0, 2.0, 2.0), ("a", 3, 3.0, 5.0, 5.5), ("b", 1, None, None, None)]


def test_cooccurrence_counts_windows(spark):
    df = spark.createDataFrame([(1, "a b c d"), (2, "a b a c d e f")], "id int, t string")
    words = spark.createDataFrame([("a",), ("b",)], "word string")

    def brute(text, size=5):
        w, out = text.split(), {}
        for s in range(len(w) - size + 1):
            for i in range(s, s + size):
                for j in range(i + 1, s + size):
                    if w[i] in "ab" and w[j] in "ab":
                        k = tuple(sorted((w[i], w[j])))
                        out[k] = out.get(k, 0) + 2
        return out

    assert {(r["w1"], r["w2"]): r["weight"] for r in topics.cooccurrence(df, "id", "t", words).collect()} == brute("a b a c d e f")


def test_keywords_are_whole_words_of_any_script(spark, tmp_path):
    from fieldglass.plans import ALL_ORACLES, ALL_QUERIES

    rows = [(1, "die größe für für für den öl-pegel"), (2, "the the the and sea 42 42"), (3, "größe öl"), (4, None), (5, "the and"), (6, "b c a1 a2 a3 a4")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    df = ALL_QUERIES["tfidf_keywords"](spark, str(tmp_path))
    assert {r["doc_id"]: r["keywords"] for r in df.collect()} == {1: "für den die", 2: "42 sea", 3: "größe öl", 6: "a1 a2 a3"}
    sql = ALL_ORACLES["tfidf_keywords"].replace("FROM documents", f"FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    import duckdb

    assert sorted(duckdb.sql(f"SELECT doc_id, top3, keywords FROM ({sql})").fetchall()) == sorted((r["doc_id"], r["top3"], r["keywords"]) for r in df.collect())


def test_density_clusters_send_no_table_of_points_to_all_tasks(spark, monkeypatch):
    frame, plans = type(spark.range(0)), []

    def noted(df):
        df.count()
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return df

    monkeypatch.setattr(frame, "checkpoint", lambda self, *a, real=frame.checkpoint: real(noted(self), *a))
    pairs = spark.createDataFrame([(i, i + 1) for i in range(0, 20)] + [(30, 31), (31, 32)], "a long, b long")
    found = clusters.density_cluster(spark.range(40), "id", pairs, 3, 4)
    rows = {r["id"]: r["cluster"] for r in found.collect()}
    noted(found)
    assert rows == {i: 1 if i <= 20 else -1 for i in range(40)}
    assert len(plans) > 3 and not any("Broadcast" in p for p in plans)


def test_share_over_a_domain(spark):
    df = spark.createDataFrame([(1,), (1,), (3,), (9,)], "x int")
    assert sorted(values(tables.value_share_domain(df, "x", [1, 2, 3]), "x", "share")) == [(1, pytest.approx(2 / 3)), (2, 0.0), (3, pytest.approx(1 / 3))]


def test_cluster_quality(spark):
    df = spark.createDataFrame([(0, [0.0, 0.0]), (0, [0.0, 2.0]), (1, [10.0, 0.0]), (1, [10.0, 2.0]), (2, [50.0, 50.0])], "c int, v array<double>")
    s = (1 - 4 / 102) * 4 / 5
    assert clusters.silhouette(df, "c", "v").first()[0] == pytest.approx(s)
    two = df.where("c < 2")
    assert clusters.davies_bouldin(two, "c", "v").first()[0] == pytest.approx(0.2)


def test_silhouette_by_euclidean_distance_equals_all_pairs(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=(60, 3)), rng.normal(size=(40, 3)) + 2, np.full((5, 3), 0.25), [[9.0, 9, 9]]])
    c = np.array([int(v) for v in rng.integers(0, 3, 105)] + [7])
    monkeypatch.setattr(clusters, "BLOCK", 16)
    df = spark.createDataFrame([(int(k), v.tolist(), 1, 1) for k, v in zip(c, x)] + [(None, [0.0, 0.0, 0.0], 1, 1), (1, None, 1, 1)], "k int, v array<double>, own int, w int").repartition(5)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    s = []
    for i in range(len(x)):
        mean = {k: d[i, c == k].sum() / max(1, (c == k).sum() - (k == c[i])) for k in set(c)}
        a, b = mean[c[i]], min(v for k, v in mean.items() if k != c[i])
        s.append((b - a) / max(a, b) if (c == c[i]).sum() > 1 else 0)
    assert clusters.silhouette_euclidean(df, "k", "v").first()[0] == pytest.approx(np.mean(s), abs=1e-12)
    assert clusters.silhouette_euclidean(df.where("k = 0"), "k", "v").collect() == [(None,)]


def test_cluster_pipeline_measures_plain_distances(spark, monkeypatch):
    import numpy as np

    from fieldglass.plans import ALL_QUERIES, mining

    seen = []
    monkeypatch.setattr(mining.K, "kmeans_cluster", lambda *a, real=mining.K.kmeans_cluster: seen.append(real(*a)) or seen[-1])
    got = ALL_QUERIES["cluster_pipeline"](spark, "/root/testdata/sf0.001").first()[0]
    rows = seen[0].select("cluster", "r").collect()
    x, c = np.array([r["r"] for r in rows]), np.array([r["cluster"] for r in rows])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    mean = np.stack([d[:, c == k].sum(axis=1) / np.maximum(1, (c == k).sum() - (c == k)) for k in range(8) if (c == k).any()], axis=1)
    own = np.searchsorted(np.unique(c), c)
    a = mean[np.arange(len(x)), own]
    mean[np.arange(len(x)), own] = np.inf
    b = mean.min(axis=1)
    assert got == pytest.approx(np.where(np.bincount(c)[c] > 1, (b - a) / np.maximum(a, b), 0).mean(), abs=1e-9)


def test_exact_similar_pairs_lose_none(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    x = rng.normal(size=(150, 6)).round(3)
    df = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "id long, v array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {(i, j) for i in range(150) for j in range(i + 1, 150) if round(float(u[i] @ u[j]), 6) >= 0.85}
    assert {(r["a"], r["b"]) for r in clusters.similar_pairs_exact(df, "id", "v", 0.85).collect()} == want


def test_curves_with_ties(spark):
    df = spark.createDataFrame([(0.9, 1), (0.8, 0), (0.8, 1), (0.3, 0), (0.1, 1)], "s double, y int")
    y = F.col("y") == 1
    # pairs: 6, won 1+1+... : 0.9 beats both, 0.8 ties one and beats one, 0.1 beats none
    assert learning.auc(df, "s", y).first()[0] == pytest.approx(3.5 / 6)
    assert learning.average_precision(df, "s", y).first()[0] == pytest.approx(1 / 3 + (1 / 3) * (2 / 3) + (1 / 3) * (3 / 5))


def test_report_of_a_class_never_predicted(spark):
    df = spark.createDataFrame([(0, 1), (1, 1), (1, 1), (2, 1)], "t int, p int")
    got = {r["class"]: (r["precision"], r["recall"], r["support"]) for r in learning.classification_report(df, "t", "p").collect()}
    assert got == {0: (0.0, 0.0, 1), 1: (0.5, 1.0, 2), 2: (0.0, 0.0, 1)}


def test_oversampling_is_exact(spark):
    df = spark.createDataFrame([(i, int(i < 3)) for i in range(10)], "id int, y int")
    assert sorted(values(learning.random_oversample(df, "id", "y").groupBy("y").count(), "y", "count")) == [(0, 7), (1, 7)]


def test_eye_ratio_of_a_square(spark):
    df = spark.createDataFrame([([0.0, 0.0, 2.0, 0.0, 1.0, 1.0, 1.0, -1.0] * 2,)], "v array<double>")
    assert values(df, F.round(frames.eye_ratio(frames.points(F.col("v"))), 6)) == [(round(2 / (2 + 1e-4), 6),)]


def test_kde_integrates_to_one(spark):
    df = spark.createDataFrame([(float(x),) for x in range(11)], "x double")
    curve = sorted(values(tables.kde_curve(df, "x", 101, 0.3), "x", "density"))
    area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(curve, curve[1:], strict=False))
    assert area == pytest.approx(10 / 11, abs=0.01) and math.isclose(curve[50][0], 5.0)


def test_scorer_failures_get_the_default(spark):
    def model(texts):
        if "bad" in texts:
            raise ValueError
        return [(t.upper(), 1.0) for t in texts]

    df = spark.createDataFrame([("a",), ("bad",), (None,), ("a",)], "t string")
    got = sorted(values(scorers.score_distinct(df, "t", model, "label string, p double", ("None", 0.0)), "t", "label", "p"), key=str)
    assert got == [("a", "A", 1.0), ("a", "A", 1.0), ("bad", "None", 0.0), (None, None, None)]


def test_chunked_writes_resume(spark, tmp_path):
    df, path, seen = spark.range(100), f"file://{tmp_path}/out", []
    for _ in range(2):
        sinks.write_chunked(df, "id", path, lambda part: seen.append(1) or part, 3)
    assert len(seen) == 3 and spark.read.parquet(path).count() == 100


def test_top_plus_other(spark):
    day = datetime.date(2020, 1, 1)
    df = spark.createDataFrame([(day,), (day,), (day + datetime.timedelta(1),), (day + datetime.timedelta(2),)], "d date")
    assert sorted(values(tables.top_plus_other(df, F.col("d"), 1), "value", "n")) == [("2020-01-01", 2), ("other", 2)]


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column).first()[0]


def test_topic_labels_are_cut_as_computed_by_hand(spark):
    for label, want in {
        "1. Gun Control: laws and limits": "Gun Control", "- Drugs - a summary": "Drugs", "12. 'Crypto', money a b": "Crypto; money", "Travel Explanation: they travel": "Travel ", "Hate  speech, 3. groups": "Hate speech; groups", "well-being": "well",
    }.items():
        assert one(spark, X.clean_topic_label(F.col("s")), s=label) == want


def test_sentences_are_cleaned_as_computed_by_hand(spark):
    for s, want in {
        "Don't visit WWW.Spam.com or HTTPS://x.org/a?b now!": "dont visit or now", "either/or <b>Bold</b> 2nd part": "either or bold nd part", "é naïve x_y a 42": "nave xy", "new\tline\nhere": "new line here",
    }.items():
        assert one(spark, X.clean_sentences(F.col("s")), s=s) == want


def test_negation_in_any_case_marks_the_next_word(spark):
    assert one(spark, X.handle_negations(F.split("s", " ")), s="NOT Good Never no way but not") == ["not_Good", "not_way", "but"]


def test_confidence_is_rounded_half_to_even_without_padding(spark):
    df = spark.createDataFrame([(0, 0.5), (0, 0.125), (1, 0.375), (0, 1.0), (2, 0.9)], "c int, p double")
    assert [r["label"] for r in frames.detection_labels(df, "c", "p", {0: "a", 1: "b"}).collect()] == ["a: 0.5", "a: 0.12", "b: 0.38", "a: 1.0"]


def test_quantiles_and_running_sums_equal_sorting(spark):
    import numpy as np

    from fieldglass.operators import ordered

    rng = np.random.default_rng(3)
    rows = [(str(g), float(v)) for g in range(3) for v in rng.integers(-20, 20, 400 * g + 1)] + [("x", None), (None, 2.0), (None, 5.0)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    found = {r["g"]: (r["a"], r["b"], r["c"]) for r in ordered.quantiles(df, ["g"], "v", {"a": 0.25, "b": 0.5, "c": 0.9}).collect()}
    for g in ("0", "1", "2", None):
        assert np.allclose(found[g], np.quantile([v for k, v in rows if k == g], [0.25, 0.5, 0.9]))
    assert set(found) == {"0", "1", "2", None}
    words = sorted({"".join(rng.choice(list("abé"), rng.integers(0, 9))) for _ in range(500)}, key=lambda w: w.encode())
    coded = features.label_encode(spark.createDataFrame([(w,) for w in words], "w string").repartition(3), "w", "code").collect()
    assert {r["w"]: r["code"] for r in coded} == {w: i for i, w in enumerate(words)}


@pytest.mark.parametrize("block", [2048, 7])
def test_similar_pairs_equal_all_pairs(spark, monkeypatch, block):
    import numpy as np

    monkeypatch.setattr(clusters, "BLOCK", block)
    rng = np.random.default_rng(8)
    middle = rng.normal(size=(12, 16))
    x = np.concatenate([middle[rng.integers(0, 12, 400)] + 0.35 * rng.normal(size=(400, 16)), np.repeat(middle[:1], 5, axis=0)])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(999, None)], "id long, v array<float>").repartition(4)
    u = x.astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    near = np.round(u @ u.T, 6)
    want = {(i, j) for i in range(405) for j in range(i + 1, 405) if near[i, j] >= 0.8}
    got = [(r["a"], r["b"]) for r in clusters.similar_pairs_exact(df, "id", "v", 0.8).collect()]
    assert len(got) == len(want) > 1000 and {*got} == want
    assert clusters.similar_pairs_exact(df.limit(0), "id", "v", 0.8).count() == 0
    names = df.where("v is not null").select(F.concat(F.lit("n"), F.col("id").cast("string")).alias("id"), "v")
    assert clusters.similar_pairs_exact(names, "id", "v", 0.8).count() == len(want)


def test_communities_equal_claiming_one_after_another(spark):
    import random

    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    rng = random.Random(4)
    pairs = sorted({tuple(sorted(rng.sample(range(60), 2))) for _ in range(110)})
    near = {i: {i} for i in range(60)}
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)
    want = {}
    while True:
        size, centre = max(((len(v), -k) for k, v in near.items()), default=(0, 0))
        if size < 3:
            break
        members = set(near[-centre])
        want |= {m: -centre for m in members}
        near = {k: v - members for k, v in near.items() if k not in members}
    got = clusters.communities(spark.createDataFrame(pairs, "a long, b long"), 3).collect()
    assert len(got) == len(want) and {r["id"]: r["centre"] for r in got} == want


def test_smote_raises_every_class_to_the_largest(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(learning, "CELL_ROWS", 40)
    rng = np.random.default_rng(6)
    rows = [(i, i % 3 if i % 7 else 0, (rng.normal(size=4) + 5 * (i % 3)).tolist()) for i in range(200)] + [(500, 9, [1.0, 2.0, 3.0, 4.0]), (501, None, [0.0] * 4), (502, 1, None)]
    df = spark.createDataFrame(rows, "id long, c int, v array<double>")
    made = learning.smote(df, "id", "c", "v").collect()
    count = lambda xs: {c: sum(x == c for x in xs) for c in {*xs} - {None}}
    own = count([c for _, c, v in rows if v])
    more = count([r["c"] for r in made])
    assert {c: own[c] + more.get(c, 0) for c in own} == dict.fromkeys(own, max(own.values()))
    x = {i: np.array(v) for i, c, v in rows if v}
    for r in made:
        if r["c"] == 9:
            assert r["v"] == [1.0, 2.0, 3.0, 4.0]
            continue
        a, p = x[r["id"]], np.array(r["v"])
        between = [np.linalg.norm(a - p) + np.linalg.norm(p - x[i]) - np.linalg.norm(a - x[i]) for i, c, v in rows if v and c == r["c"]]
        assert min(between) < 1e-6
    assert learning.smote(df.limit(0), "id", "c", "v").count() == 0


def test_lemmas_and_lexicon_and_language(spark):
    df = spark.createDataFrame([(1, ["cats", "run", "cats"], "good good bad"), (2, [], "none"), (3, None, None)], "id long, w array<string>, t string")
    lemmas = spark.createDataFrame([("cats", "cat")], "word string, lemma string")
    assert {r["id"]: r["w"] for r in topics.with_lemmas(df, "id", "w", lemmas).collect()} == {1: ["cat", "run", "cat"], 2: [], 3: None}
    lexicon = spark.createDataFrame([("good", 1), ("bad", -3)], "term string, weight int")
    assert {r["id"]: r["score"] for r in topics.lexicon_score(df, ["id"], "t", lexicon).collect()} == {1: -1, 2: 0}
    hints = spark.createDataFrame([("good", "en"), ("bad", "de"), ("none", "fr"), ("none", "en")], "term string, k string")
    assert {r["id"]: r["guess"] for r in topics.language_by_words(df, "id", "t", hints, "k").collect()} == {1: "en", 2: "en", 3: None}


@pytest.mark.parametrize("window", [4, 110])
def test_cv_coherence_equals_counting_every_window(spark, window):
    texts = ["a b c a d e f a b", "a", "", None, "c c b e e e e e e e a", "f d a c", " ".join("ab cd a f b".split() * 9)]
    topic_terms = {"one": ["a", "b", "c"], "two": ["f", "d", "a", "absent"]}
    seen = []
    for text in texts:
        words = (text or "").split()
        seen += [set(words[s : s + window]) for s in range(max(1, len(words) - window + 1))]
    share = lambda *ws: sum(all(w in s for w in ws) for s in seen) / len(seen)

    def npmi(a, b):
        p = share(a, b) + 1e-12
        return math.log(p / (share(a) * share(b))) / -math.log(p) if share(a) and share(b) else 0.0

    want = {}
    for name, words in topic_terms.items():
        rows = [[npmi(a, b) for b in words] for a in words]
        total = [sum(c) for c in zip(*rows, strict=True)]
        length = lambda v: math.sqrt(sum(x * x for x in v))
        want[name] = sum(sum(x * y for x, y in zip(r, total, strict=True)) / (length(r) * length(total)) if any(r) else 0.0 for r in rows) / len(rows)
    words = spark.createDataFrame([(k, w, i) for k, v in topic_terms.items() for i, w in enumerate(v, 1)], "topic string, term string, rank int")
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = dict(values(topics.coherence_cv(words, "topic", df, "id", "text", window), "topic", "coherence"))
    assert got == pytest.approx(want, abs=1e-9)


@pytest.mark.parametrize("block", [7, 2048])
def test_nearest_points_equal_comparing_all(spark, monkeypatch, block):
    monkeypatch.setattr(neighbours, "BLOCK", block)
    rng = random.Random(3)
    rows = [(i, float(rng.randrange(12)), float(rng.randrange(9)) if rng.random() < 0.9 else 40.0 + rng.random(), rng.choice("xyz")) for i in range(700)]
    rows += [(1000, None, 1.0, "x"), (1001, 1.0, 1.0, None)]
    df = spark.createDataFrame(rows, "id long, p double, q double, label string")
    parts = dict(values(learning.split(df, "id", [("train", 80), ("test", 20)]), "id", "part"))
    for k in (1, 5, 5000):
        got = {r[0]: r[2] for r in values(learning.knn_classify(df, ("p", "q"), "label", "id", k), "id", "label", "prediction")}
        full = [r for r in rows if None not in r]
        want = {}
        for i, p, q, _ in (r for r in full if parts[r[0]] == "test"):
            near = sorted((math.sqrt((p - r[1]) ** 2 + (q - r[2]) ** 2), r[3]) for r in full if parts[r[0]] == "train")[:k]
            votes = {c: (-sum(x[1] == c for x in near), min(x[0] for x in near if x[1] == c), c) for c in {x[1] for x in near}}
            want[i] = min(votes.values())[2]
        assert got == want
    assert learning.knn_classify(df.where("id < 0"), ("p", "q"), "label", "id").count() == 0


def test_density_clusters_equal_a_walk(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(f"file://{tmp_path}")
    rng = random.Random(5)
    pairs = sorted({tuple(sorted(rng.sample(range(120), 2))) for _ in range(75)})
    near = {i: {b for a, b in pairs if a == i} | {a for a, b in pairs if b == i} for i in range(120)}
    core = {i for i in near if len(near[i]) + 1 >= 3}
    of = {}
    for i in sorted(core):
        todo = [] if i in of else [i]
        while todo:
            if (x := todo.pop()) not in of:
                of[x] = i
                todo += near[x] & core
    of |= {i: min(of[x] for x in near[i] & core) for i in set(near) - core if near[i] & core}
    want = {i: of[i] if i in of and sum(c == of[i] for c in of.values()) >= 4 else -1 for i in near}
    df = spark.createDataFrame([(i,) for i in near], "id long")
    found = clusters.density_cluster(df, "id", spark.createDataFrame(pairs, "a long, b long"), 3, 4)
    assert dict(values(found, "id", "cluster")) == want and len(set(want.values())) > 3


def test_helper_columns_clash_with_none_of_the_caller(spark):
    names = ["_lo", "_hi", "_m", "_s", "_rank"]
    df = spark.createDataFrame([(float(i), i % 2, *[i * 10 + k for k in range(5)]) for i in range(8)], ["x", "g", *names])
    want = sorted(tuple(r) for r in df.select(names).collect())
    for out in (features.standardize(df, "x"), features.normalize_minmax(df, "x"), features.discretize(df, "x", 4), tables.binned(df, "x", 4)):
        assert sorted(tuple(r) for r in out.select(names).collect()) == want and out.columns[: len(df.columns)] == df.columns
    assert sorted(r["x"] for r in features.normalize_minmax(df, "x").collect()) == pytest.approx([i / 7 for i in range(8)])
    assert sorted(tuple(r) for r in tables.histogram(df, "x", 2).collect()) == [(0, 4), (1, 4)]
    kept = windows.sample_per_group(df, ["g"], "x", 2)
    assert kept.columns == df.columns and kept.count() == 4 and {tuple(r) for r in kept.select(names).collect()} <= {*want}


def test_best_caption_of_equal_scores_goes_by_its_own_name(spark, tmp_path):
    from fieldglass.plans import ALL_ORACLES, ALL_QUERIES
    from tests.compare import differences

    at = datetime.datetime(2024, 1, 1)
    rows = [(0, at, 3, "purchase", 90.0), (1, at, 3, "view", 90.0), (2, at, 4, "error", 95.0), (3, at, 4, "view", 95.0), (4, at, 6, "signup", 9.0), (5, at, 7, "click", 86.0), (6, at, 9, None, 99.0), (7, at, 9, "view", 99.0)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").coalesce(1).write.parquet(f"{tmp_path}/all")
    next((tmp_path / "all").glob("*.parquet")).rename(tmp_path / "events.parquet")
    for name in ("benchmark", "conversations", "customer", "documents", "embeddings", "labels", "lineitem", "nation", "orders", "pages", "part", "region", "supplier"):
        (tmp_path / f"{name}.parquet").symlink_to(f"/root/testdata/sf0.001/{name}.parquet")
    found = ALL_QUERIES["zero_shot_frames"](spark, str(tmp_path))
    day = at.date()
    assert sorted(values(found, "user_id", "day", "kind")) == [(3, day, "drowsiness"), (6, day, "drowsiness"), (7, day, "distraction"), (9, day, "distraction")]
    assert differences(found, ALL_ORACLES["zero_shot_frames"], str(tmp_path)) is None
