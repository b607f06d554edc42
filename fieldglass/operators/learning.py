"""Splits, resampling, models and their evaluation."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier, OneVsRest, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldglass.operators.neighbours import nearest_points
from fieldglass.operators.ordered import running
from fieldglass.operators.shared import fresh, written

#: Rows among which the nearest of a class are looked for.
CELL_ROWS = 2000


def hash_bucket(key: str, buckets: int = 100, seed: int = 7) -> Column:
    return F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(buckets)).cast("int")


def split(df: DataFrame, key: str, shares: Sequence[tuple[str, int]], seed: int = 7, into: str = "part") -> DataFrame:
    """Parts by hash of the key, in percent; rows of a key stay together, in every run the same."""
    bucket, upto, out = hash_bucket(key, 100, seed), 0, None
    for name, share in shares:
        upto += share
        out = F.when(bucket < upto, name) if out is None else out.when(bucket < upto, name)
    return df.withColumn(into, out)


def _by_hash(df: DataFrame, key: str, label: str, seed: int) -> tuple[DataFrame, Column, Column]:
    """df and more columns, the row's number in its class by hash of the key (from 1), and the size of the class."""
    hashed, upto = fresh("hash"), fresh("upto")
    ranked = running(df.withColumn(hashed, F.xxhash64(F.col(key), F.lit(seed))), [label], [F.col(hashed), F.col(key)], {upto: F.lit(1)})
    return ranked, F.col(upto), F.col(f"{upto}_all")


def split_stratified(df: DataFrame, key: str, label: str, shares: Sequence[tuple[str, float]], seed: int = 7, into: str = "part") -> DataFrame:
    """The same shares of each class, by rank of the key's hash within the class."""
    end, out = 0.0, None
    ranked, upto, size = _by_hash(df, key, label, seed)
    place = F.coalesce(F.try_divide(upto - 1, size - 1), F.lit(0.0))
    for name, share in shares:
        end += share
        hit = place <= end + 1e-12
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return ranked.select(*[c for c in df.columns if c != into], F.coalesce(out, F.lit(shares[-1][0])).alias(into))


def assembled(df: DataFrame, features: Sequence[str] | str) -> DataFrame:
    """A vector column `features` from number columns, or from one array column (many columns make Catalyst's constraints explode)."""
    if isinstance(features, str):
        return df.withColumn("features", array_to_vector(F.col(features).cast("array<double>")))
    return VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="skip").transform(df)


CLASSIFIERS = {
    "random_forest": lambda **k: RandomForestClassifier(**({"numTrees": 50, "seed": 7} | k)),
    "gbt": lambda **k: OneVsRest(classifier=GBTClassifier(**({"maxIter": 10, "seed": 7} | k))),
    "logistic": lambda **k: LogisticRegression(**k),
    "mlp": lambda **k: MultilayerPerceptronClassifier(**({"seed": 7, "maxIter": 60} | k)),
    "one_vs_rest": lambda **k: OneVsRest(classifier=LogisticRegression(**k)),
}
REGRESSORS = {"random_forest": lambda **k: RandomForestRegressor(**({"numTrees": 30, "seed": 7} | k)), "gbt": lambda **k: GBTRegressor(**({"maxIter": 20, "seed": 7} | k))}


def classify(df: DataFrame, features: Sequence[str] | str, label: str, key: str, model: str = "random_forest", train_percent: int = 80, **params) -> tuple[DataFrame, object]:
    """Predictions (key, label, prediction) on the held-out part, and the fitted model."""
    rows = split(assembled(df, features), key, [("train", train_percent), ("test", 100 - train_percent)]).withColumn("label", F.col(label).cast("double"))
    fitted = CLASSIFIERS[model](**params).fit(rows.where("part = 'train'"))
    return fitted.transform(rows.where("part = 'test'")).select(key, "label", "prediction"), fitted


def regress(df: DataFrame, features: Sequence[str], target: str, key: str, models: Sequence[str] = ("random_forest",), train_percent: int = 80) -> DataFrame:
    """Held-out predictions: the mean of the models' (one: that model's)."""
    rows = split(assembled(df, features), key, [("train", train_percent), ("test", 100 - train_percent)]).withColumn("label", F.col(target).cast("double"))
    out, names = rows.where("part = 'test'"), []
    for name in models:
        fitted = REGRESSORS[name]().setPredictionCol(f"_{name}").fit(rows.where("part = 'train'"))
        out, names = fitted.transform(out), [*names, f"_{name}"]
    return out.select(key, "label", (sum(F.col(n) for n in names) / len(names)).alias("prediction"))


def feature_importance(fitted, features: Sequence[str], spark) -> DataFrame:
    rows = sorted(zip(features, map(float, fitted.featureImportances.toArray()), strict=True), key=lambda r: (-r[1], r[0]))
    return spark.createDataFrame(rows, "feature string, importance double")


def grid_search(df: DataFrame, features: Sequence[str], label: str, depths: Sequence[int], trees: Sequence[int], folds: int = 3) -> DataFrame:
    """Mean accuracy of each setting of a random forest over the folds."""
    rows = assembled(df, features).withColumn("label", F.col(label).cast("double"))
    forest = RandomForestClassifier(seed=7)
    grid = ParamGridBuilder().addGrid(forest.maxDepth, list(depths)).addGrid(forest.numTrees, list(trees)).build()
    fitted = CrossValidator(estimator=forest, estimatorParamMaps=grid, evaluator=MulticlassClassificationEvaluator(metricName="accuracy"), numFolds=folds, seed=7, parallelism=2).fit(rows)
    found = [(g[forest.maxDepth], g[forest.numTrees], float(m)) for g, m in zip(grid, fitted.avgMetrics, strict=True)]
    return df.sparkSession.createDataFrame(found, "max_depth int, n_trees int, accuracy double")


def best_per_target(df: DataFrame, features: Sequence[str], targets: Sequence[str], key: str) -> DataFrame:
    """For each target the regressor with the least error on a held-out part: target, model, rmse."""
    out = []
    for target in targets:
        rows = df.where(F.col(target).isNotNull())
        error = {m: RegressionEvaluator(metricName="rmse").evaluate(regress(rows, features, target, key, [m])) for m in REGRESSORS}
        best = min(error, key=error.get)
        out.append((target, best, float(error[best])))
    return df.sparkSession.createDataFrame(out, "target string, model string, rmse double")


def filled_targets(df: DataFrame, features: Sequence[str], targets: Sequence[str], key: str, parallel: int = 4) -> tuple[DataFrame, DataFrame]:
    """df with every null of a target filled by a model, and what was chosen: target, model, rmse, filled (rows), chosen.

    For each target all candidates are trained on the rows that have it and compared on a held-out part; the one with the least error is fitted again on all rows that have the
    target, and predicts those that lack it. Targets are worked on side by side. A row with a null feature keeps its null; so does a target that no row has.
    """
    keys = [fresh("filled") for _ in targets]

    def one(target: str, name: str) -> tuple[DataFrame | None, list[tuple]]:
        known = df.where(F.col(target).isNotNull())
        if known.isEmpty():
            return None, []
        error = {m: RegressionEvaluator(metricName="rmse").evaluate(regress(known, features, target, key, [m])) for m in REGRESSORS}
        best = min(error, key=error.get)
        fitted = REGRESSORS[best]().setPredictionCol(name).fit(assembled(known, features).withColumn("label", F.col(target).cast("double")))
        guesses = written(fitted.transform(assembled(df.where(F.col(target).isNull()), features)).select(key, name).dropDuplicates([key]), "filled")
        return guesses, [(target, m, float(e), guesses.count(), m == best) for m, e in error.items()]

    with ThreadPoolExecutor(parallel) as pool:
        done = list(pool.map(one, targets, keys))
    out = df
    for target, name, (guesses, _) in zip(targets, keys, done, strict=True):
        if guesses is not None:
            out = out.join(guesses, key, "left").withColumn(target, F.coalesce(F.col(target).cast("double"), F.col(name))).drop(name)
    log = [row for _, rows in done for row in rows]
    return out, df.sparkSession.createDataFrame(log, "target string, model string, rmse double, filled long, chosen boolean")


def knn_classify(df: DataFrame, features: Sequence[str], label: str, key: str, k: int = 5, train_percent: int = 80) -> DataFrame:
    """Majority vote of the k nearest training rows; ties go to the smaller distance, then label. Rows with a null have no part.

    Equal feature points are counted first, so that what is compared are distinct points: survey codes have few.
    """
    rows = split(df.na.drop(subset=[*features, label]), key, [("train", train_percent), ("test", 100 - train_percent)])
    rows = rows.select(F.col(key), F.col(label), "part", F.array(*[F.col(f).cast("double") for f in features]).alias("x"))
    points = rows.where("part = 'train'").groupBy("x", F.col(label).alias("label")).agg(F.count("*").alias("w"))
    near = nearest_points(rows.where("part = 'test'").select("x").distinct(), points, k)
    ahead = F.coalesce(F.sum("w").over(Window.partitionBy("x").orderBy("d", "label").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    votes = near.withColumn("vote", F.least(F.col("w"), k - ahead)).where("vote > 0").groupBy("x", "label").agg(F.sum("vote").alias("votes"), F.min("d").alias("d"))
    best = votes.groupBy("x").agg(F.min(F.struct((-F.col("votes")).alias("v"), "d", F.col("label").alias("prediction"))).alias("s"))
    asked = rows.where("part = 'test'").select(F.col(key), F.col(label), "x")
    return asked.join(best.select("x", "s.prediction"), "x").select(key, label, "prediction")


def smote(df: DataFrame, key: str, label: str, vector: str, k: int = 5, seed: int = 7) -> DataFrame:
    """Synthetic rows that raise every class to the largest one's size: key (of the row it begins at), label, vector.

    Each lies between a row and one of its k nearest of the class (all others, if they are fewer); a row alone in its class is repeated. How many begin at a row follows
    from its rank by hash. Rows meet in cells of the class by nearest pivot, cut to CELL_ROWS by hash where they are larger, so no row is compared with a whole class;
    a row alone in its cell is repeated. Rows with a null label or vector have no part.
    """
    rows = df.where(F.col(label).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).alias("key"), F.col(label).alias("class"), F.col(vector).cast("array<double>").alias("v"))
    ranked, upto, size = _by_hash(rows, "key", "class", seed)
    top = rows.groupBy("class").agg(F.count("*").alias("n")).agg(F.max("n").alias("top"))
    want = F.floor((F.col("top") - size) / size) + F.when(upto <= (F.col("top") - size) % size, 1).otherwise(0)
    ranked = ranked.crossJoin(F.broadcast(top)).select("key", "class", "v", want.cast("int").alias("times"))
    pivots = rows.orderBy(F.xxhash64("key"), "key").limit(max(1, min(1024, rows.count() // CELL_ROWS))).toPandas()["v"]
    middle = np.stack(pivots.to_list()) if len(pivots) else np.zeros((1, 1))

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            if len(part):
                x = np.stack(part["v"].to_list())
                yield part.assign(cell=((x**2).sum(1)[:, None] - 2 * x @ middle.T + (middle**2).sum(1)).argmin(axis=1))

    def drawn(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("key").reset_index(drop=True)
        x = np.stack(part["v"].to_list())
        d = (x**2).sum(1)[:, None] - 2 * x @ x.T + (x**2).sum(1)
        np.fill_diagonal(d, np.inf)
        near = d.argsort(axis=1, kind="stable")[:, : min(k, len(x) - 1)]
        out = []
        for i in np.flatnonzero(part["times"]):
            rng = np.random.default_rng([seed, int(part["draw"][i]) & 0xFFFFFFFF])
            for _ in range(part["times"][i]):
                y = x[near[i, rng.integers(near.shape[1])]] if near.shape[1] else x[i]
                out.append((part["key"][i], part["class"][i], (x[i] + (y - x[i]) * rng.random()).tolist()))
        return pd.DataFrame(out, columns=["key", "class", "v"])

    kinds = {c: k_ for c, k_ in rows.dtypes}
    cells = ranked.mapInPandas(placed, f"key {kinds['key']}, class {kinds['class']}, v array<double>, times int, cell long").withColumn("draw", F.xxhash64("key", F.lit(seed)))
    sizes = cells.groupBy("class", "cell").agg(F.ceil(F.count("*") / CELL_ROWS).alias("parts"))
    cut = cells.join(sizes, ["class", "cell"]).withColumn("part", F.expr("pmod(draw, parts)")).drop("parts")
    made = cut.groupBy("class", "cell", "part").applyInPandas(drawn, f"key {kinds['key']}, class {kinds['class']}, v array<double>")
    return made.toDF(key, label, vector)


def random_oversample(df: DataFrame, key: str, label: str, seed: int = 7) -> DataFrame:
    """Rows repeated until each class is as large as the largest; which rows are used once more follows from their hash."""
    n, top = fresh("n"), fresh("top")
    ranked, upto, size = _by_hash(df, key, label, seed)
    most = df.groupBy(label).agg(F.count("*").alias(n)).agg(F.max(n).alias(top))
    times = (F.floor(F.col(top) / size) + F.when(upto <= F.col(top) % size, 1).otherwise(0)).cast("int")
    return ranked.crossJoin(F.broadcast(most)).withColumn(n, F.explode(F.sequence(F.lit(1), times))).select(*df.columns)


def balanced(df: DataFrame, key: str, label: str, train: float, seed: int = 7, into: str = "part") -> DataFrame:
    """As many rows of each class as the smallest has, by hash of the key: the share `train` (rounded down) for training, the others for validation."""
    n, least = fresh("n"), fresh("least")
    ranked, upto, _ = _by_hash(df, key, label, seed)
    few = df.groupBy(label).agg(F.count("*").alias(n)).agg(F.min(n).alias(least))
    part = F.when(upto <= F.floor(F.col(least) * train), "train").otherwise("valid")
    return ranked.crossJoin(F.broadcast(few)).where(upto <= F.col(least)).select(*[c for c in df.columns if c != into], part.alias(into))


def confusion_matrix(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    return df.groupBy(truth, predicted).agg(F.count("*").alias("n"))


def classification_report(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Precision, recall, F1 and support of each class, from the counts of the confusion matrix; 0 where a class is never predicted."""
    cells = confusion_matrix(df.na.drop(subset=[truth, predicted]), truth, predicted)
    rows = cells.select(F.explode(F.array(
        F.struct(F.col(truth).alias("class"), F.col("n").alias("support"), F.lit(0).cast("long").alias("guessed"), F.when(F.col(truth) == F.col(predicted), F.col("n")).otherwise(0).alias("hit")),
        F.struct(F.col(predicted).alias("class"), F.lit(0).cast("long").alias("support"), F.col("n").alias("guessed"), F.lit(0).cast("long").alias("hit")),
    )).alias("s")).groupBy("s.class").agg(*[F.sum(f"s.{c}").alias(c) for c in ("support", "guessed", "hit")])
    p, r = F.coalesce(F.try_divide("hit", "guessed"), F.lit(0.0)), F.coalesce(F.try_divide("hit", "support"), F.lit(0.0))
    return rows.select("class", p.alias("precision"), r.alias("recall"), F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)).alias("f1"), "support")


def report_means(report: DataFrame) -> DataFrame:
    """Rows "macro" (mean over classes), "weighted" (by support) and "accuracy" of a classification report, with the support of all."""
    n = F.sum("support")
    names = ("precision", "recall", "f1")
    sums = report.agg(n.alias("n"), *[F.avg(c).alias(f"macro_{c}") for c in names], *[(F.sum(F.col(c) * F.col("support")) / n).alias(f"weighted_{c}") for c in names])
    # of all rows those of their class that are found: recall by support
    rows = [F.struct(F.lit(m).alias("class"), *[F.col(f"{m}_{c}").alias(c) for c in names], F.col("n").alias("support")) for m in ("macro", "weighted")]
    rows.append(F.struct(F.lit("accuracy").alias("class"), *[F.col("weighted_recall").alias(c) for c in names], F.col("n").alias("support")))
    return sums.select(F.inline(F.array(*rows)))


def class_scores(df: DataFrame, truth: str, scores: Mapping[object, Column]) -> DataFrame:
    """class, score, positive: each row once for each class, with its score for that class and whether it is one; for curves of one class against the rest.

    Rows without truth, and null scores, are left out.
    """
    each = [F.struct(F.lit(c).alias("class"), s.cast("double").alias("score"), (F.col(truth) == F.lit(c)).alias("positive")) for c, s in scores.items()]
    return df.where(F.col(truth).isNotNull()).select(F.inline(F.array(*each))).where("score is not null")


def class_curves(rows: DataFrame) -> DataFrame:
    """class, score, tpr, fpr, precision down to each distinct score of each class; a rate is null where a class has no positives or no negatives."""
    steps = _steps(rows, "score", F.col("positive"), ["class"])
    rate = lambda a, b: F.try_divide(F.col(a), F.col(b))
    return steps.select("class", "score", rate("tp", "all_positive").alias("tpr"), rate("fp", "all_negative").alias("fpr"), (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"))


def class_areas(rows: DataFrame) -> DataFrame:
    """class, auc, average_precision of each class, and of class null their means over all classes that have both."""
    area = F.try_divide(F.col("q"), F.col("all_negative")) * F.try_divide(2 * F.col("tp") - F.col("p"), F.col("all_positive")) / 2
    precise = F.try_divide(F.col("p"), F.col("all_positive")) * F.col("tp") / (F.col("tp") + F.col("fp"))
    each = _steps(rows, "score", F.col("positive"), ["class"]).groupBy("class").agg(F.sum(area).alias("auc"), F.sum(precise).alias("average_precision"))
    kind = dict(each.dtypes)["class"]
    return each.unionAll(each.where("auc is not null and average_precision is not null").select(F.lit(None).cast(kind).alias("class"), F.col("auc"), F.col("average_precision")).groupBy("class").agg(F.avg("auc"), F.avg("average_precision")))


def accuracy(df: DataFrame, truth: str, predicted: str, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.avg((F.col(truth) == F.col(predicted)).cast("int")).alias("accuracy"))


def _steps(df: DataFrame, score: str, positive: Column, by: Sequence[str] = ()) -> DataFrame:
    """Positives and negatives down to each distinct score, and of all rows, within each value of `by`."""
    each = df.groupBy(*by, F.col(score).alias("score")).agg(F.count_if(positive).alias("p"), F.count_if(~positive).alias("q"))
    out = running(each, by, [F.desc("score")], {"tp": F.col("p"), "fp": F.col("q")})
    return out.withColumnsRenamed({"tp_all": "all_positive", "fp_all": "all_negative"})


def roc_curve(df: DataFrame, score: str, positive: Column) -> DataFrame:
    return _steps(df, score, positive).select("score", (F.col("fp") / F.col("all_negative")).alias("fpr"), (F.col("tp") / F.col("all_positive")).alias("tpr"))


def auc(df: DataFrame, score: str, positive: Column) -> DataFrame:
    """Area under the ROC curve by trapezoids; equal scores are one step."""
    step = F.col("q") / F.col("all_negative") * (2 * F.col("tp") - F.col("p")) / F.col("all_positive") / 2
    return _steps(df, score, positive).agg(F.sum(step).alias("auc"))


def pr_curve(df: DataFrame, score: str, positive: Column) -> DataFrame:
    return _steps(df, score, positive).select("score", (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"), (F.col("tp") / F.col("all_positive")).alias("recall"))


def average_precision(df: DataFrame, score: str, positive: Column) -> DataFrame:
    step = F.col("p") / F.col("all_positive") * F.col("tp") / (F.col("tp") + F.col("fp"))
    return _steps(df, score, positive).agg(F.sum(step).alias("average_precision"))


def regression_metrics(df: DataFrame, truth: str, predicted: str, tolerance: float = 0.1) -> DataFrame:
    """MSE, MAE, R2 and the share of rows within the tolerance, in one pass."""
    t, p = F.col(truth).cast("double"), F.col(predicted).cast("double")
    mse = F.avg((t - p) * (t - p))
    close = F.avg((F.try_divide(F.abs(t - p), t) < tolerance).cast("int"))
    return df.agg(mse.alias("mse"), F.avg(F.abs(t - p)).alias("mae"), (1 - mse / F.var_pop(t)).alias("r2"), close.alias("within"))


def k_fold_recall(df: DataFrame, features: Sequence[str], label: str, key: str, folds: int = 3) -> DataFrame:
    """Recall of each class in each fold: fold, label, recall."""
    rows = assembled(df, features).withColumns({"label": F.col(label).cast("double"), "fold": hash_bucket(key, folds, 11)})
    rows = written(rows.select("features", "label", "fold"), "folds")
    out = None
    for k in range(folds):
        fitted = RandomForestClassifier(numTrees=20, seed=7).fit(rows.where(F.col("fold") != k))
        hit = fitted.transform(rows.where(F.col("fold") == k)).groupBy("fold", "label").agg(F.avg((F.col("label") == F.col("prediction")).cast("int")).alias("recall"))
        out = hit if out is None else out.unionByName(hit)
    return out


def k_fold_summary(recalls: DataFrame) -> DataFrame:
    """Mean and sample deviation over the classes of each fold."""
    return recalls.groupBy("fold").agg(F.avg("recall").alias("mean"), F.stddev_samp("recall").alias("std"))


def align_clusters(df: DataFrame, cluster: str, label: str) -> DataFrame:
    """Each cluster with the label most of its rows have (the smallest of several) and the share that have it."""
    counts = df.groupBy(cluster, label).agg(F.count("*").alias("n"))
    return counts.groupBy(cluster).agg(F.min(F.struct((-F.col("n")).alias("m"), F.col(label).alias("label"))).alias("s"), F.sum("n").alias("n")).select(cluster, F.col("s.label").alias("label"), (-F.col("s.m") / F.col("n")).alias("share"))


def training_log(df: DataFrame, features: Sequence[str], target: str, key: str, rounds: int = 10) -> DataFrame:
    """Mean squared error after each boosting round on the training and the validation part."""
    rows = split(assembled(df, features), key, [("train", 80), ("valid", 20)]).withColumn("label", F.col(target).cast("double"))
    parts = {p: rows.where(F.col("part") == p).select("features", "label") for p in ("train", "valid")}
    model = GBTRegressor(maxIter=rounds, maxDepth=3, seed=7).fit(parts["train"])
    loss = {p: model.evaluateEachIteration(d, "squared") for p, d in parts.items()}
    found = [(i, float(a), float(b)) for i, (a, b) in enumerate(zip(loss["train"], loss["valid"], strict=True), 1)]
    return df.sparkSession.createDataFrame(found, "round int, train double, valid double")


def stored_and_loaded(model, path: str):
    """A fitted model, saved and read back."""
    model.write().overwrite().save(path)
    return type(model).load(path)
