from datetime import datetime, timedelta

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from rivermeld.operators import agreement, keyed, stats


def test_ties_kept_or_broken(spark):
    t0, t1 = datetime(2024, 1, 1), datetime(2024, 1, 2)
    df = spark.createDataFrame([("a", t0, "x"), ("a", t1, "y"), ("a", t1, "z"), ("b", t0, "x")], "k STRING, at TIMESTAMP, v STRING")
    assert keyed.latest_rows(df, "k", "at").count() == 3
    strict = {(r["k"], r["v"]) for r in keyed.latest_row(df, "k", "at").collect()}
    assert strict == {("a", "y"), ("b", "x")}


def test_live_wins_over_newer_historical(spark):
    t0, t1 = datetime(2024, 1, 1), datetime(2024, 1, 2)
    df = spark.createDataFrame([("a", t0, "live"), ("a", t1, "historical"), ("b", t0, "historical"), ("c", t1, "live"), ("c", t1, "historical")],
                               "k STRING, at TIMESTAMP, s STRING")
    got = sorted((r["k"], r["s"]) for r in keyed.latest_preferring(df, "k", "at", F.col("s") == "live").collect())
    assert got == [("a", "live"), ("b", "historical"), ("c", "historical"), ("c", "live")]


def test_previous_row_across_slices_of_a_hot_key(spark):
    rng = np.random.default_rng(1)
    rows = [("hot" if i % 3 else f"k{i % 11}", datetime(2020, 1, 1) + timedelta(days=int(rng.integers(0, 900))), f"{i:05d}",
             None if i % 7 == 0 else float(i)) for i in range(600)]
    df = spark.createDataFrame(rows, "k STRING, at TIMESTAMP, id STRING, v DOUBLE")
    got = keyed.with_previous(df, ["k"], ["at", "id"], ["v"], F.date_trunc("month", "at")).toPandas()
    want = pd.DataFrame(rows, columns=["k", "at", "id", "v"]).sort_values(["k", "at", "id"])
    want["prev_v"] = want.groupby("k")["v"].shift()
    want["visit_no"] = want.groupby("k").cumcount() + 1
    both = got.merge(want, on="id")
    assert len(both) == 600
    assert (both["visit_no_x"] == both["visit_no_y"]).all()
    assert ((both["prev_v_x"] == both["prev_v_y"]) | (both["prev_v_x"].isna() & both["prev_v_y"].isna())).all()


def test_global_numbers_are_complete(spark):
    df = spark.range(1000).select(F.col("id").cast("string").alias("id"))
    numbers = sorted(r["row_no"] for r in keyed.with_global_number(df, ["id"], slice_rows=140).collect())
    assert numbers == list(range(1000))


def test_exact_quantiles_with_heavy_ties(spark):
    rng = np.random.default_rng(2)
    values = np.concatenate([np.zeros(400), rng.normal(size=801), np.repeat(2.5, 150)])
    df = spark.createDataFrame([("a", float(v)) for v in values] + [("b", 4.0), ("b", 8.0), ("c", None)], "g STRING, value DOUBLE")
    probs = {"p10": 0.1, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p100": 1.0}
    got = {r["g"]: r for r in stats.exact_quantiles(df, probs, ["g"]).collect()}
    for name, p in probs.items():
        assert abs(got["a"][name] - np.quantile(values, p)) < 1e-12
    assert (got["b"]["p25"], got["b"]["p50"], "c" in got) == (5.0, 6.0, False)


def test_quantiles_of_many_distinct_values(spark):
    df = spark.range(20001).select(F.lit("g").alias("g"), F.col("id").cast("double").alias("value"))
    row = stats.exact_quantiles(df, {"p25": 0.25, "p75": 0.75}, ["g"]).first()
    assert (row["p25"], row["p75"]) == (5000.0, 15000.0)


def test_correlation_of_a_constant_is_null(spark):
    df = spark.createDataFrame([("a", 1.0, 1.0), ("a", 1.0, 2.0), ("b", 1.0, 1.0), ("b", 2.0, 3.0), ("b", None, 9.0)], "g STRING, x DOUBLE, y DOUBLE")
    got = {r["g"]: r["corr"] for r in stats.correlation(df, "x", "y", ["g"]).collect()}
    assert got["a"] is None and abs(got["b"] - 1) < 1e-12


def test_average_ranks_and_rank_correlation(spark):
    rows = [("1", "a", 3.0), ("1", "b", 3.0), ("1", "c", 1.0), ("2", "a", 1.0), ("2", "b", 2.0), ("2", "c", 3.0)]
    df = spark.createDataFrame(rows, "fold STRING, feature STRING, importance DOUBLE")
    ranks = {(r["fold"], r["feature"]): r["rank"] for r in stats.average_rank_desc(df, ["fold"], "importance").collect()}
    assert ranks[("1", "a")] == ranks[("1", "b")] == 1.5 and ranks[("2", "a")] == 3.0
    rho = stats.rank_correlations(df, "fold", "feature", "importance").first()["spearman"]
    assert abs(rho - np.corrcoef([1.5, 1.5, 3], [3, 2, 1])[0, 1]) < 1e-12


def test_scores_of_an_absent_class_are_zero(spark):
    df = spark.createDataFrame([("Moderate", "Moderate"), ("Poor", "Moderate")], "y STRING, p STRING")
    conf = agreement.confusion(df, "y", "p")
    scores = {r["label"]: r for r in agreement.class_scores(conf).collect()}
    assert (scores["Poor"]["precision"], scores["Poor"]["recall"], scores["Poor"]["f1"]) == (0.0, 0.0, 0.0)
    assert abs(agreement.weighted_f1(agreement.class_scores(conf)).first()["weighted_f1"] - 1 / 3) < 1e-12


def test_kappa_of_full_agreement(spark):
    df = spark.createDataFrame([("a", "a"), ("b", "b")], "y STRING, p STRING")
    assert agreement.cohen_kappa(agreement.confusion(df, "y", "p")).first()["kappa"] == 1.0
    same = spark.createDataFrame([("a", "a")], "y STRING, p STRING")
    assert agreement.cohen_kappa(agreement.confusion(same, "y", "p")).first()["kappa"] is None


def test_comparison_and_gains(spark):
    rows = [("r1", "Traditional", 0.5), ("r2", "Traditional", 0.6), ("rf", "AI / ML", 0.9)]
    got = agreement.comparison(spark.createDataFrame(rows, "method STRING, approach STRING, weighted_f1 DOUBLE")).first()
    assert (got["best_rule"], got["best_model"]) == ("r2", "rf") and abs(got["gain_pct"] - 50) < 1e-9
    stages = spark.createDataFrame([(1, 0.5), (2, 0.7)], "stage_no INT, f1 DOUBLE")
    gains = [r["gain"] for r in agreement.stage_gains(stages).orderBy("stage_no").collect()]
    assert gains[0] is None and abs(gains[1] - 0.2) < 1e-12


def test_spreads_keep_their_own_deviation(spark):
    df = spark.createDataFrame([("f", 1.0), ("f", 3.0)], "feature STRING, importance DOUBLE")
    assert agreement.run_spread(df, "importance").first()["std"] == 1.0
    assert abs(agreement.importance_spread(df).first()["std_importance"] - 2 ** 0.5) < 1e-12
