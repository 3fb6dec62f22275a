"""Jobs over the warehouse: nothing is lost, and the package reaches workers from any folder."""

import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from rivermeld.operators import learning
from rivermeld.plans import build, training
from rivermeld.session import new_folder
from rivermeld.sources.files import read_returns_year, read_sheets
from rivermeld.sources.models import ModelStore
from rivermeld.sources.store import Warehouse

AS_OF = "2024-01-31 00:00:00"


def matrix(spark, n=120):
    rows = spark.range(n).select(
        F.col("id").cast("string").alias("fww_id"), F.concat(F.lit("s"), "id").alias("site_name"),
        (F.col("id") * 1000.0).alias("easting"), (F.col("id") % 7 * 900.0).alias("northing"), F.lit("WB1").alias("wb_id"),
        (F.col("id") % 13 / 10.0).alias("nitrate_mid"), (F.col("id") % 5 / 10.0).alias("phosphate_mid"),
        F.when(F.col("id") % 5 > 2, "Poor").otherwise("Moderate").alias("wfd_status"))
    return rows


FEATURES = ["nitrate_mid", "phosphate_mid"]


def test_scores_of_two_models_at_one_time_both_stay(spark):
    store, models = Warehouse(spark, new_folder(spark, "warehouse")), ModelStore(spark, new_folder(spark, "models"))
    store.replace("feat_matrix", matrix(spark), AS_OF)
    rows = store.read("feat_matrix")
    for kind, changes in (("rf", {"numTrees": 3, "maxDepth": 2}), ("logreg", {"maxIter": 5})):
        models.save(learning.train_final(rows, FEATURES, kind, **changes), kind, AS_OF)
        training.score_history(store, models, AS_OF, kind, FEATURES)
    counts = {r["model_version"]: r["count"] for r in store.read("predictions").groupBy("model_version").count().collect()}
    assert counts == {"rf_model": 120, "logreg_model": 120}


def test_absent_label_has_no_probability(spark):
    rows = matrix(spark).withColumn("wfd_status", F.when(F.col("wfd_status") == "Moderate", "Good").otherwise("Poor"))
    model = learning.train_final(rows, FEATURES, "rf", numTrees=3, maxDepth=2)
    scored = learning.score(model, rows, FEATURES)
    assert scored.where(F.col("prob_moderate").isNotNull() | F.col("prob_poor").isNull()).count() == 0


def test_retraining_keeps_metrics_of_other_models_and_writes_documents(spark):
    store, models = Warehouse(spark, new_folder(spark, "warehouse")), ModelStore(spark, new_folder(spark, "models"))
    store.replace("feat_matrix", matrix(spark), AS_OF)
    documents = new_folder(spark, "documents")
    training.retrain(store, models, AS_OF, "logreg", FEATURES, maxIter=5)
    before = store.read("model_metrics").count()
    training.retrain(store, models, "2024-02-01 00:00:00", "rf", FEATURES, documents, numTrees=3, maxDepth=2)
    training.retrain(store, models, "2024-02-02 00:00:00", "rf", FEATURES, numTrees=3, maxDepth=2)
    kinds = {r["model_type"]: r["count"] for r in store.read("model_metrics").groupBy("model_type").count().collect()}
    assert len(kinds) == 2 and set(kinds.values()) == {before}
    assert spark.read.json(f"{documents}/shap/*").count() == 2 and spark.read.json(f"{documents}/training/*").count() == 1


def test_rows_without_position_are_in_no_fold(spark):
    rows = matrix(spark).withColumn("easting", F.when(F.col("fww_id") != "7", F.col("easting")))
    result = learning.cross_validate(learning.spatial_folds(rows, folds=3), FEATURES, "rf", numTrees=3, maxDepth=2)
    assert result.out_of_fold.count() == 119


def test_late_rows_are_added_once(spark):
    known = spark.createDataFrame([("a",)], "fww_id string")
    rows = spark.createDataFrame(
        [("a", "2024-01-29 00:00:00", 1.0, 1.0), ("b", "2024-01-29 00:00:00", 1.0, 1.0), ("c", "2024-01-02 00:00:00", 1.0, 1.0),
         ("d", "2024-02-01 00:00:00", 1.0, 1.0), ("e", "2024-01-30 00:00:00", None, 1.0)],
        "fww_id string, received_at string, nitrate_mid double, phosphate_mid double")
    assert [r["fww_id"] for r in build.late_readings(rows, known, AS_OF, 7).collect()] == ["b"]
    assert [r["fww_id"] for r in build.new_readings(rows, AS_OF).collect()] == ["d"]


def test_rows_of_any_lateness_are_added(spark, monkeypatch):
    store = Warehouse(spark, new_folder(spark, "warehouse"))
    kinds = "fww_id string, received_at timestamp, nitrate_mid double, phosphate_mid double"
    rows = spark.createDataFrame([("a", None, 1.0, 1.0), ("b", None, 1.0, 1.0), ("c", None, None, 1.0), ("d", None, 1.0, 1.0)], kinds)
    times = {"a": "2024-01-29", "b": "2001-01-02", "c": "2001-01-02"}
    for name, at in times.items():
        rows = rows.withColumn("received_at", F.when(F.col("fww_id") == name, F.lit(at).cast("timestamp")).otherwise(F.col("received_at")))
    store.append("staging_fww", rows)
    store.append("staging_wfd", rows)
    store.append("staging_edm_historical", rows)
    store.replace("feat_matrix", rows.where("fww_id = 'a'"), AS_OF)
    monkeypatch.setattr(build, "full_build", lambda fresh, *rest: fresh)
    assert build.append_new(store, AS_OF, since=AS_OF) == 2
    assert sorted(r["fww_id"] for r in store.read("feat_matrix").collect()) == ["a", "b", "d"]
    assert build.append_new(store, AS_OF, since=AS_OF) == 0


def test_added_parts_old_versions_and_old_days(spark, monkeypatch):
    store = Warehouse(spark, new_folder(spark, "warehouse"))
    monkeypatch.setattr("rivermeld.sources.store.COMPACT", 2)
    part = matrix(spark, 10)
    assert store.extend("feat_matrix", part, AS_OF) == 10
    store.replace("feat_matrix", part, AS_OF)
    for k in range(3):
        assert store.extend("feat_matrix", part, AS_OF) == 10
        assert store.read("feat_matrix").count() == 20 + 10 * k
    assert store.prune("feat_matrix", 1) > 0 and store.read("feat_matrix").count() == 40
    feed = spark.createDataFrame([("w", f"o{d}", f"2024-01-{d:02d} 10:00:00") for d in range(1, 31)], "wb_id string, outlet_ngr string, at string")
    store.append("staging_edm_live", feed.withColumn("received_at", F.to_timestamp("at")))
    assert store.drop_days("staging_edm_live", "2024-01-11") == 10
    assert store.read("staging_edm_live").count() == 20


def test_wide_sheets_and_loose_headers(spark, tmp_path):
    head = ["Summary", "x"]
    names = ["Water Company Name", "Unique  ID\n", *[f"extra {k}" for k in range(70)], "WFD Waterbody ID"]
    quoted = lambda cells: ",".join('"%s"' % c for c in cells)
    body = [["co", f"u{k}", *["-"] * 70, f"WB{k}"] for k in range(3)]
    (tmp_path / "sheet.csv").write_text("\n".join(map(quoted, [head, names, *body])) + "\n")
    rows = read_returns_year(spark, str(tmp_path / "sheet.csv"), 2024).collect()
    assert sorted(r["unique_id"] for r in rows) == ["u0", "u1", "u2"]
    with pytest.raises(Exception, match="more than 20 cells"):
        read_sheets(spark, str(tmp_path / "sheet.csv"), width=20).collect()


def test_workers_find_the_package_from_any_folder(tmp_path):
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = (f"import sys; sys.path.insert(0, {top!r})\n"
            "import __spark_entry__ as e\nfrom pyspark.sql import SparkSession\n"
            "s = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').config('spark.sql.shuffle.partitions', '2').getOrCreate()\n"
            "print('rows', e.queries()['m12_oversampled_rows'](s, '/root/testdata/sf0.001').count())\n")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=400)
    assert "rows 3" in done.stdout, done.stderr[-1500:]
