"""Model queries fit with the published settings, on all folds' restarts and on the features of the job."""

import pytest
from pyspark.sql import functions as F

from rivermeld.catalog import QUERIES, Inputs, scores, streams
from rivermeld.operators import learning
from rivermeld.plans import training
from rivermeld.settings import ABLATION, FEATURES

SF_DIR = "/root/testdata/sf0.001"
CUTS = {"numTrees", "maxDepth", "maxIter", "maxBins", "restarts"}
MATRIX = {"m4_boosted_cross_validation", "m7_fold_importance", "m13_p23_feature_test", "m15_x8_seed_stability", "m16_hypothetical_site",
          "x1_boosted_shap_values", "x4_shap_fold_stability", "m10_w6_model_comparison", "m11_w3_s20_ablation", "x3_x5_importance_and_sign_check", "t4_t7_batch_refresh_and_log",
          "t1_t3_t4_t7_stream_rescores_sites"}


class Seen(Exception):
    pass


@pytest.mark.parametrize("name", sorted(MATRIX) + [
    "m5_logistic_cross_validation", "m12_e10_oversampled_forest", "x1_x2_forest_shap_values", "x1_additivity_of_shap_values"])
def test_no_setting_is_cut(spark, monkeypatch, name):
    folds, fits = [], []

    def spatial_folds(df, *args, **changes):
        folds.append((args, changes))
        return df.withColumn("fold", F.lit(0))

    def fitted(df, features=None, kind="rf", **changes):
        fits.append((features, changes))
        raise Seen

    monkeypatch.setattr(learning, "spatial_folds", spatial_folds)
    for module in (learning, training):
        monkeypatch.setattr(module, "cross_validate", fitted)
        monkeypatch.setattr(module, "train_final", fitted)
    with pytest.raises(Seen):
        QUERIES[name](Inputs(spark, SF_DIR))
    assert all(not args and not changes for args, changes in folds)
    assert len(fits) == 1 and not CUTS & set(fits[0][1])
    if name in MATRIX:
        assert fits[0][0] == (next(iter(ABLATION.values())) if name.startswith("m11") else FEATURES)


def test_no_shrunken_settings_remain():
    assert not hasattr(scores, "FOREST") and not hasattr(scores, "SMALL") and not hasattr(streams, "small_model")
    assert len(scores.SEEDS) == 5
