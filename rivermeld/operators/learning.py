"""Spatial folds, classifiers and cross-validation with Spark ML."""

from __future__ import annotations

from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import IndexToString, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rivermeld.operators import boosting, forest
from rivermeld.operators.agreement import class_scores, confusion, report, weighted_f1
from rivermeld.operators.matrix import filled_features
from rivermeld.session import shared_folder, written
from rivermeld.settings import FEATURES, FOLDS, SEED, TREES

#: Distinct positions that one task holds; iterations of a run of k-means, and the step that counts as none.
SPOTS_HELD = 2_000_000
ITERATIONS = 100
TOLERANCE = 1e-4
KINDS = {"logreg": "Logistic Regression", "rf": "Random Forest", "gbt": "Gradient Boosted Trees"}


# ---- folds ---------------------------------------------------------------------------------------
def fold_centres(df: DataFrame, folds: int = FOLDS, seed: int = SEED, restarts: int = 10) -> list[tuple[float, float]]:
    """Centres of the best of several k-means runs on positions, in coordinate order.

    Distinct positions are clustered with their row counts as weights, which is the same problem on far
    fewer rows.
    """
    spots = written(df.groupBy("easting", "northing").agg(F.count("*").cast("double").alias("w")), "spots")
    if spots.count() <= SPOTS_HELD:
        return sorted(_centres_in_tasks(spots, folds, seed, restarts))
    ready = VectorAssembler(inputCols=["easting", "northing"], outputCol="position").transform(
        spots).select("position", "w").persist(StorageLevel.MEMORY_AND_DISK)
    best = None
    try:
        for i in range(restarts):
            means = KMeans(k=folds, seed=seed + i, maxIter=ITERATIONS, tol=TOLERANCE, featuresCol="position", weightCol="w")
            fitted = means.fit(ready)
            if best is None or fitted.summary.trainingCost < best[0]:
                best = (fitted.summary.trainingCost, [tuple(map(float, c)) for c in fitted.clusterCenters()])
    finally:
        ready.unpersist()
    return sorted(best[1])


def _centres_in_tasks(spots: DataFrame, folds: int, seed: int, restarts: int) -> list[tuple[float, float]]:
    """The same where one task can hold all positions: a task per restart, the cheapest result."""

    def restart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = {}  # by restart: a task may be given several
        for batch in batches:
            number = batch.column("restart").to_numpy()
            columns = np.stack([batch.column(c).to_numpy() for c in ("easting", "northing", "w")], axis=1)
            for i in np.unique(number):
                parts.setdefault(int(i), []).append(columns[number == i])
        for i, found in parts.items():
            found = np.concatenate(found)
            found = found[np.lexsort((found[:, 1], found[:, 0]))]  # draws follow from the positions, not from their files
            cost, centres = k_means(found[:, :2], found[:, 2], folds, seed + i)
            yield pa.RecordBatch.from_pydict({"cost": [cost], "centres": [centres.ravel()]})

    copies = spots.withColumn("restart", F.explode(F.sequence(F.lit(0), F.lit(restarts - 1))))
    # One row per restart.
    results = copies.repartitionById(restarts, "restart").mapInArrow(restart, "cost double, centres array<double>").collect()
    if not results:
        raise ValueError("there are no positions to divide into folds")
    best = min(results, key=lambda r: (r["cost"], r["centres"]))
    return [tuple(c) for c in np.reshape(best["centres"], (-1, 2)).tolist()]


def k_means(points: np.ndarray, weights: np.ndarray, k: int, seed: int) -> tuple[float, np.ndarray]:
    """Cost and centres of one run: first centres drawn by squared distance, then means until none moves."""
    if len(points) <= k:
        return 0.0, points
    rng = np.random.default_rng(seed)
    centres = np.empty((k, points.shape[1]))
    near = np.ones(len(points))
    for j in range(k):
        chances = (weights * near).cumsum()
        centres[j] = points[min(np.searchsorted(chances, rng.random() * chances[-1], side="right"), len(points) - 1)]
        d2 = ((points - centres[j]) ** 2).sum(axis=1)
        near = d2 if j == 0 else np.minimum(near, d2)

    def assigned():
        d2 = np.stack([((points - c) ** 2).sum(axis=1) for c in centres])
        return d2.argmin(axis=0), float((weights * d2.min(axis=0)).sum())

    for _ in range(ITERATIONS):
        mine, _ = assigned()
        total = np.bincount(mine, weights=weights, minlength=k)
        moved = np.stack([np.bincount(mine, weights=weights * column, minlength=k) for column in points.T], axis=1)
        moved = np.where(total[:, None] > 0, moved / np.where(total > 0, total, 1.0)[:, None], centres)
        step = ((moved - centres) ** 2).sum(axis=1).max()
        centres = moved
        if step <= TOLERANCE ** 2:
            break
    return assigned()[1], centres


def assign_folds(df: DataFrame, centres: list[tuple[float, float]]) -> DataFrame:
    """The nearest centre's number as `fold`; plain arithmetic on two columns."""
    d2 = [(F.col("easting") - e) ** 2 + (F.col("northing") - n) ** 2 for e, n in centres]
    nearest = F.least(*d2) if len(d2) > 1 else d2[0]
    number: Column = F.lit(None).cast("int")
    for i in reversed(range(len(centres))):
        number = F.when(d2[i] == nearest, F.lit(i)).otherwise(number)
    return df.withColumn("fold", number)


def spatial_folds(df: DataFrame, folds: int = FOLDS, seed: int = SEED, restarts: int = 10) -> DataFrame:
    return assign_folds(df, fold_centres(df.na.drop(subset=["easting", "northing"]), folds, seed, restarts))


# ---- models --------------------------------------------------------------------------------------
def label_indexer(df: DataFrame):
    """Alphabetical label encoder."""
    return StringIndexer(inputCol="wfd_status", outputCol="label", stringOrderType="alphabetAsc").fit(df)


def class_weights(train: DataFrame, kind: str) -> Column:
    """Balanced weights n / (k * n_c), or for boosted trees n_0 / max(n_1, 1) on class 1."""
    # One row per class.
    counts = {int(r["label"]): r["n"] for r in train.groupBy("label").agg(F.count("*").alias("n")).collect()}
    total, classes = sum(counts.values()), len(counts)
    if kind == "gbt":
        ratio = counts.get(0, 0) / max(counts.get(1, 0), 1)
        return F.when(F.col("label") == 1, F.lit(float(ratio) or 1.0)).otherwise(F.lit(1.0))
    weight: Column = F.lit(1.0)
    for label, n in counts.items():
        weight = F.when(F.col("label") == label, F.lit(total / (classes * n))).otherwise(weight)
    return weight


def classifier(kind: str, n_rows: int, **changes):
    """The three model types with the published settings; `changes` override single parameters."""
    if kind == "rf":
        settings = dict(numTrees=TREES, maxDepth=10, minInstancesPerNode=5, featureSubsetStrategy="sqrt",
                        maxMemoryInMB=512, seed=SEED)
        return RandomForestClassifier(weightCol="weight", **{**settings, **changes})
    if kind == "gbt":
        settings = dict(maxIter=TREES, maxDepth=6, stepSize=0.1, maxMemoryInMB=512, seed=SEED)
        return GBTClassifier(weightCol="weight", **{**settings, **changes})
    if kind == "logreg":
        settings = dict(maxIter=1000, regParam=1.0 / max(n_rows, 1), elasticNetParam=0.0, standardization=False)
        return LogisticRegression(weightCol="weight", **{**settings, **changes})
    raise ValueError(f"unknown model type {kind}")


def fit_model(train: DataFrame, features: list[str], kind: str, labels: list[str], n_rows: int,
              balance: bool = True, **changes) -> PipelineModel:
    """Fit one scoring model on rows with `features` filled and `label` indexed.

    The scaler of the logistic model is part of the saved model, so scoring sees the same scale. Boosted trees of more
    than two classes are those of `boosting`, forests those of `forest`.
    """
    if kind == "rf":
        return forest.fit(train, features, labels, classifier("rf", n_rows, **changes), balance, **changes)
    if kind == "gbt" and len(labels) > 2:
        return boosting.fit_folds(train, features, labels, balance=balance, **changes)[None]
    weight = class_weights(train, kind) if balance else F.lit(1.0)
    stages = [VectorAssembler(inputCols=features, outputCol="raw_features" if kind == "logreg" else "features")]
    if kind == "logreg":
        stages.append(StandardScaler(inputCol="raw_features", outputCol="features", withMean=True))
    stages.append(classifier(kind, n_rows, **changes))
    stages.append(IndexToString(inputCol="prediction", outputCol="predicted", labels=labels))
    return Pipeline(stages=stages).fit(train.withColumn("weight", weight))


def importances(model: PipelineModel, features: list[str]) -> list[tuple[str, float]]:
    """Tree importances, or absolute coefficients averaged over classes: one number per feature."""
    fitted = model.stages[-2]
    # Linear models have one row of coefficients, or one per class.
    linear = not hasattr(fitted, "featureImportances")
    values = abs(fitted.coefficientMatrix.toArray()).mean(axis=0) if linear else fitted.featureImportances
    return [(f, float(values[i])) for i, f in enumerate(features)]


def model_labels(model: PipelineModel) -> list[str]:
    return list(model.stages[-1].getLabels())


# ---- cross-validation ----------------------------------------------------------------------------
@dataclass
class CrossValidated:
    """Out-of-fold predictions (fww_id, fold, wfd_status, predicted) and what follows from them."""

    kind: str
    features: list[str]
    labels: list[str]
    out_of_fold: DataFrame
    importance_rows: list[tuple[int, str, float]] = field(default_factory=list)

    def fold_scores(self) -> DataFrame:
        """Training and test rows and weighted F1 per fold."""
        conf = confusion(self.out_of_fold, "wfd_status", "predicted", ["fold"])
        scores = weighted_f1(class_scores(conf, ["fold"]), ["fold"]).withColumnRenamed("n", "n_test")
        # One row per fold, so this window is a handful of rows.
        whole = F.sum("n_test").over(Window.partitionBy(F.lit(1)))
        return scores.select("fold", (whole - F.col("n_test")).alias("n_train"), "n_test", "weighted_f1")

    def pooled(self) -> DataFrame:
        """One row: weighted F1 over all out-of-fold rows with per-class scores."""
        conf = confusion(self.out_of_fold, "wfd_status", "predicted").withColumn("model", F.lit(self.kind))
        return report(conf, self.labels, ["model"])

    def summary(self) -> DataFrame:
        """Mean-of-folds and pooled F1 side by side."""
        mean = self.fold_scores().agg(F.avg("weighted_f1").alias("mean_f1"), F.count("*").alias("n_folds"))
        pooled = self.pooled().select("model", F.col("weighted_f1").alias("pooled_f1"))
        return pooled.join(mean.withColumn("model", F.lit(self.kind)), "model")

    def feature_importance(self) -> DataFrame:
        """Mean and population deviation of the importance over folds."""
        rows = self.out_of_fold.sparkSession.createDataFrame(
            self.importance_rows, "fold INT, feature STRING, importance DOUBLE")
        return rows.groupBy("feature").agg(
            F.avg("importance").alias("mean_importance"), F.stddev_pop("importance").alias("std_importance"))

    def metric_rows(self, feature_set: str) -> DataFrame:
        """Rows for the stored metrics: one per fold, with the pooled class scores repeated."""
        pooled = self.pooled()
        wanted = {"moderate": "mod", "poor": "poor"}
        classes = [F.col(f"{long}_{m}").alias(f"{short}_{m}") if f"{long}_{m}" in pooled.columns
                   else F.lit(None).cast("double").alias(f"{short}_{m}")
                   for long, short in wanted.items() for m in ("precision", "recall", "f1")]
        return self.fold_scores().withColumn("model", F.lit(self.kind)).join(
            pooled.select("model", *classes), "model").select(
            F.lit(KINDS[self.kind]).alias("model_type"), F.lit("AI / Machine Learning").alias("approach"),
            F.lit(feature_set).alias("feature_set"), F.col("fold").cast("long").alias("fold_id"),
            "n_train", "n_test", "weighted_f1", *[f"{s}_{m}" for s in wanted.values()
                                                  for m in ("precision", "recall", "f1")])


def prepared(df: DataFrame, features: list[str], labels_from: DataFrame | None = None) -> tuple[DataFrame, list[str]]:
    """Rows ready to fit: id, label text and index, fold if any, filled features; and the label list."""
    rows = filled_features(df.where(F.col("wfd_status").isNotNull()), features)
    indexer = label_indexer(labels_from if labels_from is not None else rows)
    keep = ["fww_id", "wfd_status", *(["fold"] if "fold" in df.columns else []), *features]
    return indexer.transform(rows.select(*keep)), list(indexer.labels)


def cross_validate(df: DataFrame, features: list[str] | None = None, kind: str = "rf", *, at_once: int = 3,
                   resample=None, **changes) -> CrossValidated:
    """Leave one spatial fold out in turn. `df` carries `fold`; folds are fitted a few at a time.

    `resample` may turn a training slice into another one (oversampling); test rows are never touched.
    """
    features = features or FEATURES
    shared_folder(df.sparkSession)  # boosted trees cut their lineage in the checkpoint folder
    # Rows without a position have no fold and can be neither trained on nor tested.
    rows, labels = prepared(df.where(F.col("fold").isNotNull()), features)
    rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
    # One row per fold.
    sizes = {r["fold"]: r["n"] for r in rows.groupBy("fold").agg(F.count("*").alias("n")).collect()}
    total = sum(sizes.values())

    def one(fold: int) -> tuple[int, PipelineModel]:
        train = rows.where(F.col("fold") != fold)
        if resample is not None:
            # Fitting reads its input many times, so new rows are made once and written.
            train = written(resample(train, features), "resampled")
        model = fit_model(train, features, kind, labels, total - sizes[fold], balance=resample is None, **changes)
        return fold, model

    try:
        return _fitted_folds(rows, features, kind, labels, sorted(sizes), one, at_once, resample is None, changes)
    finally:
        rows.unpersist()


def _fitted_folds(rows: DataFrame, features: list[str], kind: str, labels: list[str], folds: list[int], one, at_once: int,
                  whole: bool, changes: dict) -> CrossValidated:
    if kind == "rf" and whole:
        template = classifier("rf", 0, **changes)
        return CrossValidated(kind, features, labels, *forest.cross_validated(rows, features, labels, template, folds, **changes))
    if kind == "gbt" and len(labels) > 2 and whole:
        fitted = boosting.fit_folds(rows, features, labels, folds, **changes)
    else:
        with ThreadPoolExecutor(max_workers=at_once) as pool:
            fitted = dict(pool.map(one, folds))
    def tested(fold: int) -> DataFrame:
        # A fold at a time: the tasks of a union would each be sent all models.
        part = fitted[fold].transform(rows.where(F.col("fold") == fold))
        return written(part.select("fww_id", "fold", "wfd_status", "predicted", vector_to_array("probability").alias("probability")), "out-of-fold")

    with ThreadPoolExecutor(max_workers=at_once) as pool:
        kept = reduce(DataFrame.unionByName, pool.map(tested, fitted))
    ranked = [(int(fold), f, v) for fold, model in fitted.items() for f, v in importances(model, features)]
    return CrossValidated(kind, features, labels, kept, ranked)


# ---- scoring -------------------------------------------------------------------------------------
def train_final(df: DataFrame, features: list[str] | None = None, kind: str = "rf", **changes) -> PipelineModel:
    """Fit on all rows; the only place that yields a model to keep."""
    features = features or FEATURES
    shared_folder(df.sparkSession)
    rows, labels = prepared(df, features)
    rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return fit_model(rows, features, kind, labels, rows.count(), **changes)
    finally:
        rows.unpersist()


def score(model: PipelineModel, df: DataFrame, features: list[str] | None = None) -> DataFrame:
    """Predicted status and the two class probabilities, rounded to four places, beside the input rows."""
    features = features or FEATURES
    labels = model_labels(model)
    probability = vector_to_array("probability")

    def chance(label: str) -> Column:
        if label not in labels:  # a class the model never saw has no probability
            return F.lit(None).cast("double")
        return F.round(F.get(probability, F.lit(labels.index(label))), 4)

    scored = model.transform(filled_features(df, features))
    return scored.select(
        *df.columns, F.col("predicted").alias("predicted_status"),
        chance("Moderate").alias("prob_moderate"), chance("Poor").alias("prob_poor"))


def prediction_rows(scored: DataFrame, version: str, source: str, as_of: str) -> DataFrame:
    """Scored rows in the shape of the stored predictions."""
    return scored.select(
        "fww_id", "site_name", "easting", "northing", "wb_id", "predicted_status", "prob_moderate", "prob_poor",
        F.lit(version).alias("model_version"), F.lit(source).alias("data_source"),
        F.lit(as_of).cast("timestamp").alias("predicted_at"))
