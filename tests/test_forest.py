"""Forests, boosted trees and folds of few rows: the same result either way, and jobs that do not grow with trees, levels or rounds."""

import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from rivermeld.operators import boosting, forest, learning
from rivermeld.settings import FOLDS

NAMES = ["a", "b", "noise"]


@pytest.fixture(scope="module")
def rows(spark):
    """Three classes told by two numbers; a third number has three values; five folds; one key twice and one null key."""
    rng = np.random.default_rng(5)
    a, b = rng.uniform(0, 1, (2, 600))
    status = np.where(a < 0.4, "Good", np.where(b < 0.5, "Moderate", "Poor"))
    data = [(None if i == 3 else str(max(i, 1)), str(status[i]), float(a[i]), None if i % 50 == 7 else float(b[i]), float(i % 3), i % FOLDS,
             float(100 * (i % FOLDS) + i // 100), float(i % 7)) for i in range(600)]
    kinds = "fww_id string, wfd_status string, a double, b double, noise double, fold int, easting double, northing double"
    return spark.createDataFrame(data, kinds).repartition(3).persist()


def jobs_of(spark, run) -> int:
    group = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, "")
    try:
        run()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_whole_trees_equal_trees_grown_level_by_level(spark, rows, monkeypatch):
    ready, labels = learning.prepared(rows, NAMES)
    template = learning.classifier("rf", 0, numTrees=5, maxDepth=6)
    settings = {"numTrees": 5, "maxDepth": 6}
    monkeypatch.setattr(boosting, "ROWS_PER_TASK", 100)  # several blocks
    monkeypatch.setattr(forest, "PART_BYTES", 600)  # in several parts
    ready = ready.withColumn("fold_", F.col("fold")).persist()
    found = []
    for held in (1 << 20, 0):
        monkeypatch.setattr(forest, "ROWS_HELD_BYTES", held)
        trees, job = forest._grown_trees(ready, NAMES, 3, template, [0, 3], True, settings)
        assert len(job.sizes) > 3
        found.append({(r.model, r.treeID): bytes(r.tree) for r in trees.collect()})
    assert len(found[0]) == 10 and found[0] == found[1]
    ready.unpersist()


def test_jobs_do_not_grow_with_trees_and_levels(spark, rows):
    few = jobs_of(spark, lambda: learning.cross_validate(rows, NAMES, "rf", numTrees=2, maxDepth=1))
    many = jobs_of(spark, lambda: learning.cross_validate(rows, NAMES, "rf", numTrees=40, maxDepth=8))
    assert many == few < 25


def test_jobs_do_not_grow_with_rounds(spark, rows):
    few = jobs_of(spark, lambda: learning.cross_validate(rows, NAMES, "gbt", maxIter=1, maxDepth=1))
    many = jobs_of(spark, lambda: learning.cross_validate(rows, NAMES, "gbt", maxIter=8, maxDepth=4))
    assert many <= few + 3


def test_restarts_of_k_means_are_tasks_of_one_job(spark, rows):
    one = jobs_of(spark, lambda: learning.fold_centres(rows, restarts=1))
    ten = jobs_of(spark, lambda: learning.fold_centres(rows, restarts=10))
    assert ten == one


def test_positions_in_one_task_find_the_regions(rows, monkeypatch):
    here = learning.fold_centres(rows)
    assert [round(e / 100) for e, _ in here] == [0, 1, 2, 3, 4]
    monkeypatch.setattr(learning, "SPOTS_HELD", 0)
    assert np.allclose(here, learning.fold_centres(rows), atol=1e-6)


def test_every_row_is_tested_by_spark_scores_of_its_fold(rows):
    """Votes from arrays equal Spark's own scoring of the same trees."""
    result = learning.cross_validate(rows, NAMES, "rf", numTrees=7, maxDepth=5)
    assert result.out_of_fold.count() == 600 and result.pooled().first().weighted_f1 > 0.9
    fold = 2
    ready, labels = learning.prepared(rows, NAMES)
    model = forest.fit(ready.where("fold <> 2"), NAMES, labels, learning.classifier("rf", 0, numTrees=7, maxDepth=5), numTrees=7, maxDepth=5)
    assert model.stages[1].getNumTrees == 7 and model.stages[1].numClasses == 3
    again, job = forest._grown_trees(ready.where("fold <> 2").withColumn("fold_", F.lit(0)), NAMES, 3, learning.classifier("rf", 0, numTrees=7, maxDepth=5), [-1], True,
                                     {"numTrees": 7, "maxDepth": 5})
    votes = forest.Votes([bytes(r.tree) for r in again.orderBy("treeID").collect()], job.weights[0], job.edges, 5)
    scored = model.transform(ready.where(F.col("fold") == fold)).select(*NAMES, learning.vector_to_array("probability").alias("p")).collect()
    x = np.array([[r[n] for n in NAMES] for r in scored])
    assert len(x) == 120 and np.allclose(votes.chances(x), [r.p for r in scored], atol=1e-9)
    assert np.allclose(votes.importances, model.stages[1].featureImportances.toArray(), atol=1e-9)


def test_bins_of_few_and_of_many_values(spark):
    rows = spark.range(5000).selectExpr("cast(id % 3 as double) as few", "cast(id as double) as many", "cast(null as double) as none").repartition(4)
    few, many, none = boosting.bin_edges(rows, ["few", "many", "none"], 32)
    assert list(few) == [0.0, 1.0, 2.0] and list(none) == [0.0]
    assert len(many) == 31 and np.abs(many - 5000 * np.arange(1, 32) / 32).max() < 15


def test_settings_a_forest_does_not_have_are_an_error(rows):
    with pytest.raises(ValueError, match="subsamplingRate"):
        learning.train_final(rows, NAMES, "rf", subsamplingRate=0.5)
