"""Boosted trees of several classes: hand-made classes, agreement with two-class boosting, additive explanations, jobs."""

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from rivermeld.operators import boosting, learning, treeshap
from rivermeld.plans import training
from rivermeld.sources.models import ModelStore
from rivermeld.sources.store import Warehouse

AT = "2024-01-01 00:00:00"
SMALL = {"maxIter": 12, "maxDepth": 3}


@pytest.fixture(scope="module")
def rows(spark):
    """Three classes told by two numbers; a third number is noise; five folds."""
    rng = np.random.default_rng(5)
    a, b, noise = rng.uniform(0, 1, (3, 600))
    status = np.where(a < 0.4, "Good", np.where(b < 0.5, "Moderate", "Poor"))
    data = [(str(i), str(status[i]), float(a[i]), float(b[i]), float(noise[i]), i % 5) for i in range(600)]
    return spark.createDataFrame(data, "fww_id string, wfd_status string, a double, b double, noise double, fold int").repartition(3)


def test_three_classes_are_told_apart(rows):
    result = learning.cross_validate(rows, ["a", "b", "noise"], "gbt", **SMALL)
    assert result.labels == ["Good", "Moderate", "Poor"] and result.out_of_fold.count() == 600
    assert result.pooled().first().weighted_f1 > 0.95
    ranked = {r.feature: r.mean_importance for r in result.feature_importance().collect()}
    assert ranked["noise"] < 0.1 < min(ranked["a"], ranked["b"])
    chances = result.out_of_fold.select(F.aggregate("probability", F.lit(0.0), lambda s, p: s + p).alias("s")).collect()
    assert all(abs(r.s - 1) < 1e-9 for r in chances)


def test_folds_at_once_equal_single_fits(rows):
    ready, labels = learning.prepared(rows, ["a", "b", "noise"])
    together = boosting.fit_folds(ready, ["a", "b", "noise"], labels, [0, 1], **SMALL)
    for fold, model in together.items():
        one = boosting.fit_folds(ready, ["a", "b", "noise"], labels, [fold], **SMALL)[fold]
        assert model.stages[1].rounds() == one.stages[1].rounds()


def test_equals_two_class_boosting_when_a_class_is_absent(spark, rows):
    two, _ = learning.prepared(rows.where("wfd_status <> 'Good'"), ["a", "b", "noise"])
    shifted = two.withColumn("label", F.col("label") + 1)
    ours = boosting.fit_folds(shifted, ["a", "b", "noise"], ["Good", "Moderate", "Poor"], **SMALL)[None].transform(two)
    theirs = learning.fit_model(two, ["a", "b", "noise"], "gbt", ["Moderate", "Poor"], two.count(), **SMALL).transform(two)
    chance = [r[0] for r in ours.select(vector_to_array("probability")).collect()]
    assert max(c[0] for c in chance) < 1e-9
    both = ours.select("fww_id", F.col("predicted").alias("p")).join(theirs.select("fww_id", F.col("predicted").alias("q")), "fww_id")
    assert both.where("p = q").count() >= 0.97 * two.count()


def test_one_class_and_missing_folds(spark):
    one = spark.createDataFrame([(str(i), float(i), 2.0, 0) for i in range(20)], "fww_id string, a double, label double, fold int")
    model = boosting.fit_folds(one, ["a"], ["x", "y", "z"], **SMALL)[None]
    assert {r.predicted for r in model.transform(one).collect()} == {"z"}


@pytest.mark.parametrize("toward", ["Good", "Moderate", "Poor"])
def test_explanations_add_up_in_every_class(rows, toward):
    names = ["a", "b", "noise"]
    model = learning.train_final(rows, names, "gbt", **SMALL)
    shap, base = treeshap.shap_values(model, rows, names, toward)
    total = {r.fww_id: r.s + base for r in shap.groupBy("fww_id").agg(F.sum("shap").alias("s")).collect()}
    at = learning.model_labels(model).index(toward)
    fitted = model.stages[1]
    for r in model.transform(rows).select("fww_id", vector_to_array("features").alias("x")).limit(40).collect():
        margin = fitted.base_margin(at)
        for tree in fitted.rounds():
            nodes, place = {int(n[0]): n for n in tree[at]}, 0
            while nodes[place][1] >= 0:
                place = 2 * place + (1 if r.x[int(nodes[place][1])] <= nodes[place][2] else 2)
            margin += nodes[place][3]
        assert abs(total[r.fww_id] - margin) < 1e-6


def test_saved_model_scores_alike_and_retraining_works(spark, rows, tmp_path):
    models = ModelStore(spark, str(tmp_path / "models"))
    model = learning.train_final(rows, ["a", "b", "noise"], "gbt", **SMALL)
    models.save(model, "gbt", AT)
    again = learning.score(models.load("gbt"), rows, ["a", "b", "noise"])
    first = learning.score(model, rows, ["a", "b", "noise"])
    assert sorted(map(tuple, again.select("fww_id", "prob_poor").collect())) == sorted(map(tuple, first.select("fww_id", "prob_poor").collect()))
    store = Warehouse(spark, str(tmp_path / "warehouse"))
    matrix = rows.select("fww_id", "wfd_status", F.col("a").alias("nitrate_mid"), F.col("b").alias("phosphate_mid"),
                         (F.col("a") * 1000).alias("easting"), (F.col("b") * 1000).alias("northing"))
    store.replace("feat_matrix", matrix, AT)
    names = ["nitrate_mid", "phosphate_mid"]
    assert training.retrain(store, models, AT, "gbt", names, str(tmp_path / "documents"), **SMALL) is not None
    assert store.read("model_metrics").where("model_type = 'Gradient Boosted Trees'").count() == 5
    assert store.read("ingestion_log").first().status == "success"
    assert spark.read.json(str(tmp_path / "documents" / "shap" / "*")).count() >= 1
    assert training.score_history(store, models, AT, "gbt", names) == 600


def test_all_three_kinds_on_three_classes(rows):
    results = training.compare_models(rows, ["a", "b", "noise"], changes={"rf": {"numTrees": 5}, "gbt": SMALL, "logreg": {"maxIter": 50}})
    for kind, result in results.items():
        assert result.kind == kind and result.out_of_fold.count() == 600
        assert result.pooled().first().weighted_f1 > 0.5
