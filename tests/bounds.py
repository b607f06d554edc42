"""What must hold of the rows of queries that SQL can't express. Each check takes (rows, ask): ask(sql) gives DuckDB rows over the same tables."""

import numpy as np
import pytest

from fieldglass.plans import ALL_ORACLES
from tests import brute


def vectors(ask):
    ids, x = zip(*ask("SELECT vec_id, embedding::DOUBLE[] FROM embeddings"), strict=True)
    return dict(zip(ids, map(np.array, x), strict=True))


def eigenvalues(ask):
    x = np.stack(list(vectors(ask).values()))
    return np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1]


def scatter(x):
    return float(((x - x.mean(axis=0)) ** 2).sum())


def clustered(most):
    """All vectors once, at most so many clusters, which scatter less than all together."""

    def check(rows, ask):
        x = vectors(ask)
        assert sorted(r["vec_id"] for r in rows) == sorted(x)
        groups = {}
        for r in rows:
            groups.setdefault(r["cluster"], []).append(x[r["vec_id"]])
        assert 1 < len(groups) <= most(len(x))
        assert sum(scatter(np.stack(g)) for g in groups.values()) < scatter(np.stack(list(x.values())))

    return check


def pca_reduce(rows, ask):
    x = np.stack([r["reduced"] for r in rows])
    spread = np.cov(x.T)
    assert np.diag(spread) == pytest.approx(eigenvalues(ask)[:5], rel=1e-6)
    assert np.abs(spread - np.diag(np.diag(spread))).max() < 1e-8


def pca_optimal_k(rows, ask):
    share = np.cumsum(eigenvalues(ask)) / eigenvalues(ask).sum()
    k = int(np.argmax(share >= 0.95)) + 1
    assert [tuple(r) for r in rows] == [(k, pytest.approx(share[k - 1]))]


def kmeans_elbow(rows, ask):
    costs = [r["cost"] for r in sorted(rows, key=lambda r: r["k"])]
    assert [scatter(np.stack(list(vectors(ask).values()))), *costs] == sorted([*costs, scatter(np.stack(list(vectors(ask).values())))], reverse=True)


def pair_sample(rows, ask):
    known = set(ask("SELECT DISTINCT l_quantity::DOUBLE, l_extendedprice::DOUBLE FROM lineitem"))
    assert rows and all(tuple(map(float, r)) in known for r in rows)


def sample_per_group(rows, ask):
    owner = dict(ask("SELECT event_id, user_id FROM events"))
    want = dict(ask("SELECT user_id, least(count(*), 3) FROM events GROUP BY 1"))
    assert len({r["event_id"] for r in rows}) == len(rows) and all(owner[r["event_id"]] == r["user_id"] for r in rows)
    got = {}
    for r in rows:
        got[r["user_id"]] = got.get(r["user_id"], 0) + 1
    assert got == want


def top_n_keywords(rows, ask):
    want = {doc: top for doc, top in ask(f"SELECT doc_id, top3 FROM ({ALL_ORACLES['tfidf_keywords']})")}
    for r in rows:
        found = [w for w in (r["weight_1"], r["weight_2"], r["weight_3"]) if w is not None]
        assert found == sorted(found, reverse=True) and sum(found) == pytest.approx(want.get(r["doc_id"], 0), abs=2e-5)


def mmr(rows, ask):
    best = {source: name.removeprefix(f"{source}_").split("_")[0] for source, name in ask(f"SELECT source, name FROM ({ALL_ORACLES['topic_info']})")}
    for source in best:
        mine = sorted((r["place"], r["term"]) for r in rows if r["source"] == source)
        assert mine[0][1] == best[source] and [p for p, _ in mine] == list(range(1, len(mine) + 1)) and len({w for _, w in mine}) == len(mine) <= 10


def lda_topics(rows, ask):
    assert {r["topic"] for r in rows} <= {0, 1, 2, 3}
    assert len({r["doc_id"] for r in rows}) == len(rows) <= ask("SELECT count(*) FROM documents")[0][0]


def silhouettes(many):
    def check(rows, ask):
        assert len(rows) == many and all(-1 <= r["silhouette"] <= 1 for r in rows)

    return check


def lda_grid_search(rows, ask):
    silhouettes(2)(rows, ask)
    assert {r["num_topics"] for r in rows} == {3, 4} and [r["silhouette"] for r in rows] == sorted((r["silhouette"] for r in rows), reverse=True)


def topic_model(rows, ask):
    for r in rows:
        assert len(set(r["words"])) == len(r["words"]) <= 10 and r["name"] == "_".join([str(r["cluster"]), *r["words"][:4]])


def good_as_majority(rows, ask):
    """Not worse than always guessing the more frequent quality, but for the chance of a small held-out part."""
    share = ask("SELECT max(n) / sum(n) FROM (SELECT count(*) AS n FROM labels GROUP BY quality)")[0][0]
    assert all(share - 0.05 <= r["accuracy"] <= 1 for r in rows)


def chance(classes):
    """Labels that don't depend on the features: near 1 / classes."""

    def check(rows, ask):
        assert len(rows) == 1 and 0 <= rows[0]["accuracy"] <= 1 / classes + 0.15

    return check


def rf_per_subject(rows, ask):
    assert {r["subject"] for r in rows} == {"length", "form"} and all(0 < r["n_positive"] <= ask("SELECT count(*) FROM labels")[0][0] for r in rows)


def feature_importance(rows, ask):
    found = [r["importance"] for r in rows]
    assert found == sorted(found, reverse=True) and min(found) >= 0 and sum(found) == pytest.approx(1)


def gbm_multiclass(rows, ask):
    assert {r["class"] for r in rows} == {float(x) for (x,) in ask("SELECT DISTINCT label FROM embeddings")}
    for r in rows:
        p, q = r["precision"], r["recall"]
        assert 0 <= min(p, q) and max(p, q) <= 1 and r["f1"] == pytest.approx(2 * p * q / (p + q) if p + q else 0)


def training_log(rows, ask):
    rows = sorted(rows, key=lambda r: r["round"])
    assert [r["round"] for r in rows] == [1, 2, 3, 4, 5] and [r["train"] for r in rows] == sorted((r["train"] for r in rows), reverse=True)


def regression(rows, ask):
    (r,) = rows
    spread = ask("SELECT var_pop(o_totalprice) FROM orders")[0][0]
    assert r["mae"] ** 2 <= r["mse"] < 1.5 * spread and -0.5 < r["r2"] <= 1 and 0 <= r["within"] <= 1


def multi_target_best(rows, ask):
    spread = dict(zip(("o_totalprice", "year"), ask("SELECT stddev_pop(o_totalprice), stddev_pop(year(o_orderdate)) FROM orders")[0], strict=True))
    assert {r["target"] for r in rows} == set(spread) and all(0 < r["rmse"] < 1.2 * spread[r["target"]] and r["model"] in ("random_forest", "gbt") for r in rows)


def grid_search_cv(rows, ask):
    assert {(r["max_depth"], r["n_trees"]) for r in rows} == {(2, 10), (4, 10)}
    good_as_majority(rows, ask)


def k_fold_recall(rows, ask):
    assert {r["fold"] for r in rows} == {0, 1, 2} and len({(r["fold"], r["label"]) for r in rows}) == len(rows) and all(0 <= r["recall"] <= 1 for r in rows)


def community_detection(rows, ask):
    assert len({r["vec_id"] for r in rows}) == len(rows)
    size = {}
    for r in rows:
        size[r["centre"]] = size.get(r["centre"], 0) + 1
    x = vectors(ask)
    cosine = lambda a, b: a @ b / np.sqrt(a @ a * (b @ b))
    assert all(n >= 2 for n in size.values()) and all(r["vec_id"] == r["centre"] or cosine(x[r["vec_id"]], x[r["centre"]]) > 0.7999 for r in rows)


def topic_search_log(rows, ask):
    """Two settings over all documents with a vector; sizes reach the least one, and add up with the outliers."""
    ((n,),) = ask("SELECT count(*) FROM documents JOIN embeddings ON vec_id = doc_id WHERE embedding IS NOT NULL")
    assert sorted(r["least_share"] for r in rows) == [0.02, 0.05]
    for r in rows:
        sizes = [x["size"] for x in r["topics"]]
        assert r["rows"] == n == sum(sizes) + r["outliers"] and len(sizes) == r["clusters"] and sizes == sorted(sizes, reverse=True)
        assert all(x >= max(2, int(n * r["least_share"])) for x in sizes) and abs(r["outlier_share"] - r["outliers"] / n) < 1e-12
        assert all(0 < len(set(x["words"])) == len(x["words"]) <= 10 for x in r["topics"])
        assert (r["davies_bouldin"] is not None) == (r["silhouette"] is not None) == (len(sizes) > 1)


def density_cluster_tree(rows, ask):
    x = vectors(ask)
    want = brute.hdbscan(list(x), np.stack(list(x.values())), max(2, int(len(x) * 0.02)), 3)
    assert {r["vec_id"]: r["cluster"] for r in rows} == {i: c for i, (c, _) in want.items()}
    assert all(r["probability"] == pytest.approx(want[r["vec_id"]][1], rel=1e-9) for r in rows)


def hierarchical_average(rows, ask):
    x = vectors(ask)
    assert {r["vec_id"]: r["cluster"] for r in rows} == brute.average_linkage(list(x), np.stack(list(x.values())), 10)


def gbm_early_stopping(rows, ask):
    log = sorted((r["round"], r["train_loss"], r["valid_loss"], r["kept"]) for r in rows)
    assert [r[0] for r in log] == list(range(len(log))) and len(log) < 41 and all(a[1] > b[1] for a, b in zip(log, log[1:], strict=False))
    best = min(log, key=lambda r: r[2])
    assert all(r[3] == (r[0] <= best[0]) for r in log) and {r["accuracy"] > 0.9 for r in rows} == {True}


def kmeans_minibatch(rows, ask):
    """Scatter within 5 % of what plain k-means reaches from several beginnings."""
    x = vectors(ask)
    clustered(lambda n: 10)(rows, ask)
    groups = {}
    for r in rows:
        groups.setdefault(r["cluster"], []).append(x[r["vec_id"]])
    mine, all_, rng, costs = sum(scatter(np.stack(g)) for g in groups.values()), np.stack(list(x.values())), np.random.default_rng(1), []
    for _ in range(5):
        centres = all_[rng.choice(len(all_), 10, replace=False)]
        for _ in range(30):
            at = ((all_[:, None] - centres[None]) ** 2).sum(-1).argmin(axis=1)
            centres = np.stack([all_[at == k].mean(axis=0) if (at == k).any() else centres[k] for k in range(10)])
        costs.append(((all_ - centres[at]) ** 2).sum())
    assert mine < 1.05 * np.median(costs)


def detect_language_model(rows, ask):
    truth = dict(ask("SELECT doc_id, lang FROM documents WHERE lang IS NOT NULL AND regexp_matches(text, '[A-Za-z]')"))
    hits = dict(ask(ALL_ORACLES["detect_language"]))
    held = [r for r in rows if r["held_out"] and r["doc_id"] in truth]
    right = sum(r["language"] == truth[r["doc_id"]] for r in held)
    assert len(rows) == ask("SELECT count(*) FROM documents")[0][0] and right / len(held) > 0.97 and right >= sum(hits[r["doc_id"]] == truth[r["doc_id"]] for r in held)


def multi_target_filled(rows, ask):
    for target in ("price", "year"):
        own = [r for r in rows if r["target"] == target]
        best = min(own, key=lambda r: r["rmse"])
        assert [r["model"] for r in own if r["chosen"]] == [best["model"]] and len(own) == 2
        assert all(r["left_null"] == 0 and r["changed"] == 0 and r["filled"] > 0 for r in own) and best["error"] < 1.5 * best["rmse"]
    # the price follows from the day: spread 1,050 or so
    assert min(r["error"] for r in rows if r["target"] == "price") < 100


BOUNDS = {
    "kmeans_minibatch": kmeans_minibatch, "detect_language_model": detect_language_model, "multi_target_filled": multi_target_filled,
    "topic_search_log": topic_search_log, "density_cluster_tree": density_cluster_tree, "hierarchical_average": hierarchical_average, "gbm_early_stopping": gbm_early_stopping,
    "pair_sample": pair_sample, "sample_per_group": sample_per_group, "top_n_keywords": top_n_keywords, "mmr": mmr, "lda_topics": lda_topics, "lda_silhouette": silhouettes(1),
    "lda_grid_search": lda_grid_search, "text_clf_vectors": good_as_majority, "pca_reduce": pca_reduce, "pca_optimal_k": pca_optimal_k, "kmeans_cluster": clustered(lambda n: 10),
    "kmeans_elbow": kmeans_elbow, "hierarchical_cluster": clustered(lambda n: 6), "hierarchical_batches": clustered(lambda n: 5 * -(-n // 200)), "community_detection": community_detection,
    "cluster_pipeline": silhouettes(1), "topic_grid_search": silhouettes(2), "topic_model": topic_model, "training_log": training_log, "store_model": good_as_majority, "random_forest": good_as_majority,
    "rf_per_subject": rf_per_subject, "feature_importance": feature_importance, "gbm_multiclass": gbm_multiclass, "mlp_with_time": chance(10), "one_vs_rest": chance(10), "knn_classify": chance(3),
    "random_forest_reg": regression, "gbt_reg": regression, "voting_reg": regression, "multi_target_best": multi_target_best, "grid_search_cv": grid_search_cv, "k_fold_recall": k_fold_recall,
}
