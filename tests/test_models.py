import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rivermeld.operators import explain, learning, oversample, treeshap
from rivermeld.plans import training
from rivermeld.session import written
from rivermeld.sources.models import ModelStore

NAMES = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 4)).round(2)
    y = np.where(x[:, 0] + 0.5 * x[:, 1] * x[:, 2] + 0.3 * rng.normal(size=400) > 0.6, "Poor", "Moderate")
    pdf = pd.DataFrame(x, columns=NAMES)
    pdf["fww_id"] = [f"s{i}" for i in range(400)]
    pdf["wfd_status"] = y
    pdf["easting"] = 400000.0 + 1000 * rng.integers(0, 5, size=400) * 20 + rng.integers(0, 900, size=400)
    pdf["northing"] = 200000.0 + rng.integers(0, 900, size=400)
    return written(spark.createDataFrame(pdf), "rows")


@pytest.fixture(scope="module")
def folded(rows):
    return written(learning.spatial_folds(rows, restarts=2), "folded")


def test_folds_are_regions_in_order(folded):
    edges = folded.groupBy("fold").agg(F.min("easting").alias("w"), F.max("easting").alias("e")).orderBy("fold").collect()
    assert [r["fold"] for r in edges] == [0, 1, 2, 3, 4]
    assert all(a["e"] < b["w"] for a, b in zip(edges, edges[1:]))


@pytest.mark.parametrize("kind,changes", [("rf", {"numTrees": 10, "maxDepth": 4}), ("logreg", {}), ("gbt", {"maxIter": 4, "maxDepth": 3})])
def test_every_row_is_scored_once_by_a_model_that_did_not_see_it(folded, kind, changes):
    result = learning.cross_validate(folded, NAMES, kind, **changes)
    assert result.out_of_fold.count() == result.out_of_fold.select("fww_id").distinct().count() == 400
    scores = result.fold_scores().collect()
    assert all(r["n_train"] + r["n_test"] == 400 for r in scores)
    assert result.summary().first()["pooled_f1"] > 0.6
    assert {r["feature"] for r in result.feature_importance().collect()} == set(NAMES)
    metrics = result.metric_rows("full_feature_set").collect()
    assert len(metrics) == 5 and len({r["poor_f1"] for r in metrics}) == 1


def test_saved_logistic_model_scales_and_versions_stay(rows, spark, tmp_path):
    store = ModelStore(spark, str(tmp_path / "models"))
    model = learning.train_final(rows, NAMES, "logreg")
    store.save(model, "logreg", "2024-01-01 00:00:00")
    store.save(model, "logreg", "2024-02-01 00:00:00")
    assert len(store.versions("logreg")) == 2
    scored = learning.score(store.load("logreg"), rows, NAMES)
    right = scored.agg(F.avg((F.col("predicted_status") == F.col("wfd_status")).cast("double"))).first()[0]
    assert right > 0.75
    total = scored.select((F.col("prob_moderate") + F.col("prob_poor")).alias("t")).agg(F.min("t"), F.max("t")).first()
    assert abs(total[0] - 1) < 2e-4 and abs(total[1] - 1) < 2e-4


def test_balanced_weights(rows):
    prepared, _ = learning.prepared(rows, NAMES)
    weighted = prepared.withColumn("w", learning.class_weights(prepared, "rf"))
    sums = [r["s"] for r in weighted.groupBy("label").agg(F.sum("w").alias("s")).collect()]
    assert all(abs(s - 200) < 1e-6 for s in sums)


def test_shap_equals_brute_force_shapley(rows):
    """Every coalition of four features, evaluated with cover-weighted descent, against the job."""
    model = learning.train_final(rows, NAMES, "rf", numTrees=3, maxDepth=4, minInstancesPerNode=5)
    few = rows.orderBy("fww_id").limit(5)
    shap, base = treeshap.shap_values(model, few, NAMES)
    got = {(r["fww_id"], r["feature"]): r["shap"] for r in shap.collect()}
    nodes = treeshap.tree_nodes(rows.sparkSession, model).toPandas()
    at = learning.model_labels(model).index("Poor")
    trees = {t: {int(r["id"]): r for r in part.to_dict("records")} for t, part in nodes.groupby("treeID")}

    def value(tree, i, x, known):
        node = tree[i]
        if node["leftChild"] < 0:
            s = np.asarray(node["impurityStats"], float)
            return s[at] / s.sum()
        left, right = int(node["leftChild"]), int(node["rightChild"])
        f, cut = int(node["split"]["featureIndex"]), node["split"]["leftCategoriesOrThreshold"][0]
        if f in known:
            return value(tree, left if x[f] <= cut else right, x, known)
        weights = [float(np.sum(tree[j]["impurityStats"])) for j in (left, right)]
        return sum(w * value(tree, j, x, known) for w, j in zip(weights, (left, right))) / sum(weights)

    def output(x, known):
        return sum(value(t, 0, x, known) for t in trees.values()) / len(trees)

    assert abs(base - output(None, ())) < 1e-9
    for row in few.collect():
        x = [row[n] for n in NAMES]
        for j, name in enumerate(NAMES):
            others = [k for k in range(4) if k != j]
            phi = 0.0
            for size in range(4):
                for s in itertools.combinations(others, size):
                    w = math.factorial(size) * math.factorial(3 - size) / math.factorial(4)
                    phi += w * (output(x, {*s, j}) - output(x, set(s)))
            assert abs(phi - got[(row["fww_id"], name)]) < 1e-9


@pytest.mark.parametrize("kind,changes", [("rf", {"numTrees": 10, "maxDepth": 6}), ("gbt", {"maxIter": 5, "maxDepth": 4})])
def test_shap_values_add_up(rows, kind, changes):
    model = learning.train_final(rows, NAMES, kind, **changes)
    shap, base = treeshap.shap_values(model, rows, NAMES)
    sums = shap.groupBy("fww_id").agg((F.sum("shap") + base).alias("total"))
    column = "probability" if kind == "rf" else "rawPrediction"
    out = model.transform(learning.filled_features(rows, NAMES)).select(
        "fww_id", learning.vector_to_array(column)[1].alias("out"))
    worst = sums.join(out, "fww_id").agg(F.max(F.abs(F.col("total") - F.col("out"))), F.count("*")).first()
    assert worst[0] < 1e-6 and worst[1] == 400
    top = explain.global_importance(shap).orderBy(F.desc("importance")).first()["feature"]
    assert top == "a"


def test_neighbours_are_exact_across_blocks_and_ties(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(120, 3)).round(1)
    x[:50, 0] = 0.0
    pdf = pd.DataFrame(x, columns=["a", "b", "c"])
    pdf["row_id"] = np.arange(120)
    near = oversample.nearest_rows(spark.createDataFrame(pdf), ["a", "b", "c"], 5, block_rows=16).toPandas()
    d2 = ((x[:, None] - x[None]) ** 2).sum(2)
    np.fill_diagonal(d2, np.inf)
    for i in range(120):
        mine = near[near["row_id"] == i].sort_values("near_no")["near_id"].to_numpy()
        assert len(set(mine)) == 5
        assert np.allclose(np.sort(d2[i, mine]), np.sort(d2[i])[:5])


def test_oversampling_balances_between_minority_rows(rows):
    prepared, _ = learning.prepared(rows, NAMES)
    grown = oversample.oversample(prepared, NAMES)
    sizes = {r["label"]: r["count"] for r in grown.groupBy("label").count().collect()}
    assert len(set(sizes.values())) == 1
    made = grown.where(F.contains("fww_id", F.lit("+"))).toPandas()
    real = prepared.where("label = 1").toPandas()
    assert set(made["label"]) == {1.0}
    for n in NAMES:
        assert made[n].min() >= real[n].min() and made[n].max() <= real[n].max()
    again = oversample.oversample(prepared, NAMES).toPandas()
    first = grown.toPandas()
    assert sorted(first["fww_id"]) == sorted(again["fww_id"])


def test_oversampled_training_leaves_test_rows_alone(folded):
    result = training.train_oversampled(folded, NAMES, numTrees=5, maxDepth=4)
    assert result.out_of_fold.where(F.contains("fww_id", F.lit("+"))).isEmpty()
    assert result.out_of_fold.count() == 400


def test_hypothetical_row_takes_medians(rows):
    row = training.hypothetical(rows, NAMES, {"b": 9.0}).first()
    medians = rows.toPandas()[NAMES].median()
    assert row["b"] == 9.0 and abs(row["a"] - medians["a"]) < 1e-12
