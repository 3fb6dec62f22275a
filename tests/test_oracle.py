"""Registered queries equal their oracle SQL on the smallest tables.

The slow model and stream jobs have tests of their own; `python tests/oracle.py` runs everything.
"""

import os

import pytest

import __spark_entry__ as entry_point
from oracle import compare, connect

SF_DIR = os.environ.get("SF_DIR", "/root/testdata/sf0.001")
SQL = entry_point.oracle_sql()
SLOW = {"m14_retraining_job", "m8_m9_s21_saved_model_scores_every_row_once", "m12_oversampled_rows",
        "t4_t7_batch_refresh_and_log", "x1_additivity_of_shap_values", "m2_m3_m6_forest_cross_validation", "m4_boosted_cross_validation",
        "m5_logistic_cross_validation", "m7_fold_importance", "m10_w6_model_comparison", "m11_w3_s20_ablation", "m12_e10_oversampled_forest",
        "m13_p23_feature_test", "m15_x8_seed_stability", "m16_hypothetical_site", "x1_x2_forest_shap_values", "x1_boosted_shap_values",
        "x3_x5_importance_and_sign_check", "x4_shap_fold_stability"}


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(set(SQL) - SLOW))
def test_equals_oracle(spark, duck, name):
    ok, note = compare(spark, duck, name, entry_point.queries()[name], SQL[name], SF_DIR)
    assert ok, note


def test_entry_runs(spark):
    assert entry_point.entry(spark).count() >= 0


def test_all_oracles_belong_to_queries():
    assert set(SQL) <= set(entry_point.queries())
