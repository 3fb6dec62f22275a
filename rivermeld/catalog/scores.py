"""Queries for evaluation, models and explanations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rivermeld.catalog.joins import full_matrix, matched_readings
from rivermeld.catalog.measures import VECTOR_LONG, vector_long
from rivermeld.catalog.registry import Inputs, query
from rivermeld.catalog.sqltext import AS_OF, MATCHED, RIVERS, ctes
from rivermeld.functions.rates import kappa_strength
from rivermeld.operators import agreement, explain, learning, matrix, stats, treeshap
from rivermeld.operators.oversample import oversample
from rivermeld.plans import training
from rivermeld.session import new_folder, written
from rivermeld.settings import ABLATION, CHEMISTRY, FEATURES, SEWAGE
from rivermeld.sources.models import ModelStore
from rivermeld.sources.store import Warehouse

RATINGS = """pairs AS (SELECT fww_id, fww_rating AS a, wfd_status AS b FROM matched
  WHERE fww_rating <> 'No water available' AND match_q <> 'poor')"""
RATED = ctes(["readings", "waterbodies"], RIVERS, MATCHED, RATINGS)
CLASSES = ["Good", "Moderate", "Poor"]


def rating_pairs(t: Inputs) -> DataFrame:
    near = matched_readings(t).where("match_q <> 'poor' AND fww_rating <> 'No water available'")
    return near.select("fww_id", F.col("fww_rating").alias("a"), F.col("wfd_status").alias("b"))


SCORES_SQL = """counts AS (SELECT label, SUM(support) AS support, SUM(claimed) AS claimed, SUM(hits) AS hits FROM (
    SELECT a AS label, 1 AS support, 0 AS claimed, CASE WHEN a = b THEN 1 ELSE 0 END AS hits FROM pairs
    UNION ALL SELECT b, 0, 1, 0 FROM pairs) GROUP BY label),
scores AS (SELECT label, CAST(support AS BIGINT) AS support, CAST(claimed AS BIGINT) AS claimed,
    CAST(hits AS BIGINT) AS hits, COALESCE(hits / CAST(NULLIF(claimed, 0) AS DOUBLE), 0) AS precision,
    COALESCE(hits / CAST(NULLIF(support, 0) AS DOUBLE), 0) AS recall,
    COALESCE(2 * hits / CAST(NULLIF(support + claimed, 0) AS DOUBLE), 0) AS f1 FROM counts)"""


@query("e2_class_scores", RATED + f",\n{SCORES_SQL}\nSELECT * FROM scores")
def class_scores(t: Inputs) -> DataFrame:
    return agreement.class_scores(agreement.confusion(rating_pairs(t), "a", "b"))


@query("e1_weighted_f1", RATED + f",\n{SCORES_SQL}\n" + """
SELECT CAST(SUM(support) AS BIGINT) AS n, ROUND(SUM(support * f1) / SUM(support), 9) AS weighted_f1 FROM scores""")
def weighted_f1(t: Inputs) -> DataFrame:
    scores = agreement.class_scores(agreement.confusion(rating_pairs(t), "a", "b"))
    return agreement.weighted_f1(scores).withColumn("weighted_f1", F.round("weighted_f1", 9))


@query("e3_confusion_matrix", RATED + """
SELECT a AS truth, COUNT(*) FILTER (b = 'Good') AS "pred_Good", COUNT(*) FILTER (b = 'Moderate') AS "pred_Moderate",
       COUNT(*) FILTER (b = 'Poor') AS "pred_Poor" FROM pairs GROUP BY a""")
def confusion_matrix(t: Inputs) -> DataFrame:
    return agreement.confusion_matrix(agreement.confusion(rating_pairs(t), "a", "b"), CLASSES)


RULES_SQL = ctes(["readings", "waterbodies"], RIVERS, MATCHED) + """,
base AS (SELECT CASE WHEN wfd_status = 'Poor' THEN 1 ELSE 0 END AS y, COALESCE(phosphate_mid > 0.1, FALSE) AS p,
                COALESCE(nitrate_mid > 2, FALSE) AS n FROM matched
         WHERE match_q <> 'poor' AND nitrate_mid IS NOT NULL AND phosphate_mid IS NOT NULL),
flat AS (SELECT 'Rule 1 - Phosphate only (PO4 > 0.1)' AS method, y, CAST(p AS INT) AS h FROM base
  UNION ALL SELECT 'Rule 2 - Nitrate only (NO3 > 2.0)', y, CAST(n AS INT) FROM base
  UNION ALL SELECT 'Rule 3 - OR rule (PO4 > 0.1 OR NO3 > 2.0)', y, CAST(p OR n AS INT) FROM base
  UNION ALL SELECT 'Rule 4 - AND rule (PO4 > 0.1 AND NO3 > 2.0)', y, CAST(p AND n AS INT) FROM base),
c AS (SELECT method, CAST(COUNT(*) FILTER (y = 1 AND h = 1) AS DOUBLE) AS tp, CAST(COUNT(*) FILTER (y = 0 AND h = 1) AS DOUBLE) AS fp,
             CAST(COUNT(*) FILTER (y = 1 AND h = 0) AS DOUBLE) AS fn, CAST(COUNT(*) FILTER (y = 0 AND h = 0) AS DOUBLE) AS tn
      FROM flat GROUP BY method),
s AS (SELECT *, COALESCE(tn / NULLIF(tn + fn, 0), 0) AS mp, COALESCE(tn / NULLIF(tn + fp, 0), 0) AS mr,
             COALESCE(2 * tn / NULLIF(2 * tn + fn + fp, 0), 0) AS mf, COALESCE(tp / NULLIF(tp + fp, 0), 0) AS pp,
             COALESCE(tp / NULLIF(tp + fn, 0), 0) AS pr, COALESCE(2 * tp / NULLIF(2 * tp + fn + fp, 0), 0) AS pf FROM c)
SELECT method, ROUND(((tn + fp) * mf + (tp + fn) * pf) / (tn + fp + tp + fn), 4) AS weighted_f1,
       ROUND(mp, 4) AS moderate_precision, ROUND(mr, 4) AS moderate_recall, ROUND(mf, 4) AS moderate_f1,
       ROUND(pp, 4) AS poor_precision, ROUND(pr, 4) AS poor_recall, ROUND(pf, 4) AS poor_f1 FROM s"""


@query("e4_rule_evaluation", RULES_SQL)
def rule_evaluation(t: Inputs) -> DataFrame:
    rows = matched_readings(t).where(
        "match_q <> 'poor' AND nitrate_mid IS NOT NULL AND phosphate_mid IS NOT NULL")
    return agreement.evaluate_rules(rows)


FOLD_PAIRS = "pairs AS (SELECT doc_id % 5 AS fold, CAST(quality AS STRING) AS a, CAST(toxic AS STRING) AS b FROM labels)"


@query("e5_mean_and_pooled_f1", f"WITH {FOLD_PAIRS}" + """,
flat AS (SELECT fold, a AS label, 1 AS support, 0 AS claimed, CASE WHEN a = b THEN 1 ELSE 0 END AS hits FROM pairs
         UNION ALL SELECT fold, b, 0, 1, 0 FROM pairs),
per AS (SELECT fold, label, SUM(support) AS s, 2 * SUM(hits) / CAST(SUM(support) + SUM(claimed) AS DOUBLE) AS f1
        FROM flat GROUP BY fold, label),
folds AS (SELECT fold, SUM(s * f1) / SUM(s) AS f FROM per GROUP BY fold),
pool AS (SELECT label, SUM(support) AS s, 2 * SUM(hits) / CAST(SUM(support) + SUM(claimed) AS DOUBLE) AS f1
         FROM flat GROUP BY label)
SELECT ROUND((SELECT AVG(f) FROM folds), 9) AS mean_f1, ROUND(SUM(s * f1) / SUM(s), 9) AS pooled_f1 FROM pool""")
def mean_and_pooled(t: Inputs) -> DataFrame:
    rows = t.table("labels").selectExpr("doc_id % 5 AS fold", "CAST(quality AS STRING) AS wfd_status",
                                        "CAST(toxic AS STRING) AS predicted")
    result = learning.CrossValidated("rf", [], ["0", "1"], rows)
    return result.summary().select(F.round("mean_f1", 9).alias("mean_f1"), F.round("pooled_f1", 9).alias("pooled_f1"))


@query("e6_exact_agreement", RATED + """
SELECT AVG(CASE WHEN a = b THEN CAST(100 AS DOUBLE) ELSE 0 END) AS agreement_pct, COUNT(*) AS n FROM pairs""")
def exact_agreement(t: Inputs) -> DataFrame:
    return agreement.exact_agreement(rating_pairs(t), "a", "b")


@query("e6_agreement_without_good", RATED + """
SELECT AVG(CASE WHEN a = b THEN CAST(100 AS DOUBLE) ELSE 0 END) AS agreement_pct, COUNT(*) AS n FROM pairs WHERE a <> 'Good'""")
def agreement_without_good(t: Inputs) -> DataFrame:
    return agreement.exact_agreement(rating_pairs(t).where("a <> 'Good'"), "a", "b")


@query("e7_f18_kappa", f"WITH {FOLD_PAIRS}" + """,
m AS (SELECT label, SUM(x) AS x, SUM(y) AS y FROM (SELECT a AS label, 1 AS x, 0 AS y FROM pairs
      UNION ALL SELECT b, 0, 1 FROM pairs) GROUP BY label),
k AS (SELECT (SELECT COUNT(*) FILTER (a = b) / CAST(COUNT(*) AS DOUBLE) FROM pairs) AS po,
             SUM(x * y) / POWER((SELECT COUNT(*) FROM pairs), 2) AS pe FROM m)
SELECT ROUND((po - pe) / (1 - pe), 9) AS kappa, CASE WHEN (po - pe) / (1 - pe) < 0.2 THEN 'slight'
  WHEN (po - pe) / (1 - pe) < 0.4 THEN 'fair' ELSE 'more' END AS strength FROM k""")
def kappa(t: Inputs) -> DataFrame:
    text = t.table("labels").selectExpr("CAST(quality AS STRING) AS a", "CAST(toxic AS STRING) AS b")
    k = agreement.cohen_kappa(agreement.confusion(text, "a", "b"))
    return k.select(F.round("kappa", 9).alias("kappa"), kappa_strength("kappa").alias("strength"))


@query("e8_correlation_by_feature", f"WITH {VECTOR_LONG}" + """
SELECT feature, ROUND(CORR(value, label), 6) AS corr FROM shap_long GROUP BY feature""")
def correlation_by_feature(t: Inputs) -> DataFrame:
    return stats.correlation(vector_long(t), "value", "label", ["feature"]).select("feature", F.round("corr", 6).alias("corr"))


FOLD_IMPORTANCE = f"""{VECTOR_LONG},
imp AS (SELECT label % 5 AS fold, feature, ROUND(AVG(ABS(shap)), 12) AS importance FROM shap_long GROUP BY 1, 2),
ranks AS (SELECT fold, feature, RANK() OVER (PARTITION BY fold ORDER BY importance DESC)
  + (COUNT(*) OVER (PARTITION BY fold, importance) - 1) / 2e0 AS rank FROM imp),
rho AS (SELECT a.fold AS fa, b.fold AS fb, CORR(a.rank, b.rank) AS spearman FROM ranks a
  JOIN ranks b ON a.feature = b.feature AND a.fold < b.fold GROUP BY 1, 2)"""


@query("e9_x4_w4_fold_rank_stability", f"WITH {FOLD_IMPORTANCE}" + """
SELECT ROUND(AVG(spearman), 9) AS mean_spearman, COUNT(*) AS n_pairs,
       CASE WHEN AVG(spearman) > 0.7 THEN 'high' ELSE 'moderate' END AS stability FROM rho""")
def fold_rank_stability(t: Inputs) -> DataFrame:
    importance = vector_long(t).groupBy((F.col("label") % 5).alias("fold"), "feature").agg(
        F.round(F.avg(F.abs("shap")), 12).alias("importance"))
    return explain.fold_stability(importance).withColumn("mean_spearman", F.round("mean_spearman", 9))


def vector_rows(t: Inputs, width: int = 64) -> DataFrame:
    """Vectors as labelled feature rows with positions, for the model queries."""
    return t.table("embeddings").select(
        F.col("vec_id").cast("string").alias("fww_id"),
        F.when(F.col("label") >= 7, "Poor").otherwise("Moderate").alias("wfd_status"),
        *[F.col("embedding")[i].cast("double").alias(f"f{i}") for i in range(width)],
        F.col("embedding")[0].cast("double").alias("easting"), F.col("embedding")[1].cast("double").alias("northing"))


NAMES = [f"f{i}" for i in range(64)]


@query("e11_direction_reliability", f"WITH {VECTOR_LONG}" + """,
c AS (SELECT feature, CORR(value, label) AS r FROM shap_long GROUP BY feature),
m AS (SELECT feature, AVG(shap) FILTER (label < 7) AS mm, AVG(shap) FILTER (label >= 7) AS pm FROM shap_long GROUP BY feature)
SELECT c.feature, ROUND(r, 6) AS shap_corr, (r > 0) = (pm > mm) AS directions_agree, ABS(r) >= 0.15 AS strong_enough,
       (r > 0) = (pm > mm) AND ABS(r) >= 0.15 AS reliable FROM c JOIN m ON c.feature = m.feature""")
def direction_reliability(t: Inputs) -> DataFrame:
    shap = vector_long(t).select("feature", "value", F.col("label").cast("double").alias("shap"))
    result = stats.direction_reliability(shap, vector_rows(t), NAMES, 0.15)
    return result.select("feature", F.round("shap_corr", 6).alias("shap_corr"), "directions_agree", "strong_enough", "reliable")


@query("e12_direction_by_median", f"WITH {VECTOR_LONG}" + """,
c AS (SELECT feature, CORR(value, label) AS r FROM shap_long WHERE feature IN ('f0', 'f1', 'f3') GROUP BY feature),
m AS (SELECT feature, MEDIAN(shap) FILTER (label < 7) AS mm, MEDIAN(shap) FILTER (label >= 7) AS pm FROM shap_long GROUP BY feature)
SELECT c.feature, ROUND(r, 6) AS shap_corr, mm AS moderate_median, pm AS poor_median, pm > mm AS poor_higher
FROM c JOIN m ON c.feature = m.feature""")
def direction_by_median(t: Inputs) -> DataFrame:
    names = ["f0", "f1", "f3"]
    shap = vector_long(t).where(F.col("feature").isin(names)).select(
        "feature", "value", F.col("label").cast("double").alias("shap"))
    result = stats.direction_by_median(shap, vector_rows(t), names)
    return result.withColumn("shap_corr", F.round("shap_corr", 6))


# ---- explanations on a keyed long table ----------------------------------------------------------
@query("x6_f21_local_explanation", f"WITH {VECTOR_LONG}" + """
SELECT feature, shap, CASE WHEN shap > 0 THEN 'Polluted' ELSE 'Healthy' END AS direction FROM shap_long WHERE fww_id = '17'""")
def local_explanation(t: Inputs) -> DataFrame:
    return explain.local_explanation(vector_long(t), "17").select("feature", "shap", "direction")


@query("x6_x7_f25_factor_counts", f"WITH {VECTOR_LONG}" + """
SELECT fww_id, COUNT(*) AS n_factors, COUNT(*) FILTER (shap > 0) AS n_toward_poor,
       COUNT(*) FILTER (shap < 0) AS n_toward_moderate, ROUND(SUM(shap) FILTER (shap > 0), 6) AS pull_poor,
       ROUND(SUM(shap) FILTER (shap < 0), 6) AS pull_healthy,
       ROUND(COUNT(*) FILTER (shap > 0) / CAST(COUNT(*) AS DOUBLE) * 100, 1) AS pct_toward_poor
FROM shap_long GROUP BY fww_id""")
def factor_counts(t: Inputs) -> DataFrame:
    counts = explain.factor_counts(vector_long(t))
    return counts.withColumns({"pull_poor": F.round("pull_poor", 6), "pull_healthy": F.round("pull_healthy", 6)})


COUNTS_SQL = f"""{VECTOR_LONG},
k AS (SELECT fww_id, COUNT(*) FILTER (shap > 0) AS n_toward_poor,
             ROUND(COUNT(*) FILTER (shap > 0) / CAST(COUNT(*) AS DOUBLE) * 100, 1) AS pct FROM shap_long GROUP BY fww_id),
p AS (SELECT CAST(event_id AS STRING) AS fww_id, CASE WHEN value > 60 THEN 'Poor' ELSE 'Moderate' END AS predicted_status,
             CAST(event_id % 1001 AS DOUBLE) / 1000 AS prob_poor FROM events)"""


def _event_predictions(t: Inputs) -> DataFrame:
    return t.table("events").selectExpr(
        "CAST(event_id AS STRING) AS fww_id", "CASE WHEN value > 60 THEN 'Poor' ELSE 'Moderate' END AS predicted_status",
        "CAST(event_id % 1001 AS DOUBLE) / 1000 AS prob_poor")


@query("a23_x7_counts_by_status", f"WITH {COUNTS_SQL}" + """
SELECT predicted_status, AVG(n_toward_poor) AS mean_toward_poor, ROUND(AVG(pct), 6) AS mean_pct_toward_poor,
       COUNT(*) AS n_sites, MEDIAN(n_toward_poor) AS median_toward_poor
FROM k JOIN p ON k.fww_id = p.fww_id GROUP BY predicted_status""")
def counts_by_status(t: Inputs) -> DataFrame:
    result = explain.counts_by_status(explain.factor_counts(vector_long(t)), _event_predictions(t))
    return result.withColumn("mean_pct_toward_poor", F.round("mean_pct_toward_poor", 6))


@query("j13_x7_count_against_probability", f"WITH {COUNTS_SQL}" + """
SELECT ROUND(CORR(n_toward_poor, prob_poor), 6) AS corr, CASE WHEN CORR(n_toward_poor, prob_poor) > 0.3 THEN 'strong'
  WHEN CORR(n_toward_poor, prob_poor) > 0.1 THEN 'weak' ELSE 'little or none' END AS strength FROM k JOIN p ON k.fww_id = p.fww_id""")
def count_against_probability(t: Inputs) -> DataFrame:
    result = explain.count_probability(explain.factor_counts(vector_long(t)), _event_predictions(t))
    return result.withColumn("corr", F.round("corr", 6))


@query("j14_keyed_shap_with_values", f"WITH {VECTOR_LONG}" + """
SELECT s.fww_id, s.feature, s.shap, p.predicted_status FROM shap_long s
JOIN (SELECT CAST(event_id AS STRING) AS fww_id, CASE WHEN value > 60 THEN 'Poor' ELSE 'Moderate' END AS predicted_status
      FROM events) p ON s.fww_id = p.fww_id""")
def keyed_shap(t: Inputs) -> DataFrame:
    labels = _event_predictions(t).select("fww_id", "predicted_status")
    return vector_long(t).join(labels, "fww_id").select("fww_id", "feature", "shap", "predicted_status")


# ---- models --------------------------------------------------------------------------------------
SEEDS = [42, 7, 123, 2024, 99]


MATRIX_ROWS = ctes(["readings", "waterbodies"], RIVERS, MATCHED, """rows_used AS (
  SELECT fww_id, wb_id FROM matched WHERE country = 'England' AND match_q <> 'poor' AND nitrate_mid IS NOT NULL
    AND phosphate_mid IS NOT NULL)""")


def cross_validated_facts(result: learning.CrossValidated) -> DataFrame:
    """What holds of any cross-validation: each row is tested once, in one of five folds, by a model of all other rows."""
    folds = result.fold_scores().agg(
        F.sum("n_test").alias("n_rows"), F.count("*").alias("n_folds"), F.min(F.col("n_train") + F.col("n_test")).alias("least_used"),
        F.max(F.col("n_train") + F.col("n_test")).alias("most_used"), F.bool_and(F.col("weighted_f1").between(0, 1)).alias("folds_in_range"))
    pooled = result.pooled()
    scores = F.array(*[c for c in pooled.columns if c != "model"])
    pooled = pooled.select("model", F.forall(scores, lambda v: v.between(0, 1)).alias("scores_in_range"),
                           F.lit(result.out_of_fold.select("fww_id").distinct().count()).alias("n_sites"))
    return pooled.join(folds.withColumn("model", F.lit(result.kind)), "model")


def facts_sql(model: str, rows: str) -> str:
    return f"""
SELECT '{model}' AS model, COUNT(*) AS n_rows, 5 AS n_folds, COUNT(*) AS least_used, COUNT(*) AS most_used, TRUE AS folds_in_range,
       TRUE AS scores_in_range, COUNT(DISTINCT fww_id) AS n_sites FROM {rows}"""


VECTOR_ROWS = "(SELECT CAST(vec_id AS STRING) AS fww_id FROM embeddings)"
FEATURE_SQL = "(SELECT UNNEST([" + ", ".join(f"'{f}'" for f in FEATURES) + "]) AS feature)"


def folded_vectors(t: Inputs) -> DataFrame:
    return written(learning.spatial_folds(vector_rows(t)), "folded")


def training_matrix(t: Inputs) -> DataFrame:
    """The feature matrix with all its labels, computed once."""
    return written(full_matrix(t), "matrix")


def folded_matrix(t: Inputs) -> DataFrame:
    return written(learning.spatial_folds(training_matrix(t)), "folded")


@query("m1_spatial_folds", ctes(["readings"]) + """
SELECT COUNT(*) AS n, 5 AS n_folds, MIN(easting) AS west, MAX(easting) AS east, TRUE AS none_empty FROM readings""")
def spatial_folds(t: Inputs) -> DataFrame:
    """Folds of all readings: how many there are, what they hold together and that none is empty."""
    folded = learning.spatial_folds(t.readings.select("fww_id", "easting", "northing"))
    folds = folded.groupBy("fold").agg(F.count("*").alias("n"), F.min("easting").alias("west"), F.max("easting").alias("east"))
    return folds.agg(F.sum("n").alias("n"), F.count("*").alias("n_folds"), F.min("west").alias("west"), F.max("east").alias("east"),
                     F.bool_and(F.col("n") > 0).alias("none_empty"))


@query("m1_every_reading_in_one_fold", ctes(["readings"]) + """
SELECT fww_id, COUNT(DISTINCT easting || ' ' || northing) AS n_places, 1 AS n_folds, TRUE AS in_range FROM readings GROUP BY fww_id""")
def readings_per_fold(t: Inputs) -> DataFrame:
    folded = learning.spatial_folds(t.readings.select("fww_id", "easting", "northing"))
    return folded.groupBy("fww_id").agg(
        F.count_distinct("easting", "northing").alias("n_places"), F.count_distinct("fold").cast("int").alias("n_folds"),
        F.bool_and(F.col("fold").between(0, learning.FOLDS - 1)).alias("in_range"))


@query("m2_m3_m6_forest_cross_validation", MATRIX_ROWS + facts_sql("rf", "rows_used"))
def forest_cv(t: Inputs) -> DataFrame:
    return cross_validated_facts(learning.cross_validate(folded_matrix(t), FEATURES, "rf"))


@query("m4_boosted_cross_validation", MATRIX_ROWS + facts_sql("gbt", "rows_used"))
def boosted_cv(t: Inputs) -> DataFrame:
    return cross_validated_facts(learning.cross_validate(folded_matrix(t), FEATURES, "gbt"))


@query("m5_logistic_cross_validation", facts_sql("logreg", VECTOR_ROWS))
def logistic_cv(t: Inputs) -> DataFrame:
    return cross_validated_facts(learning.cross_validate(folded_vectors(t), NAMES, "logreg"))


@query("m7_fold_importance", f"""
SELECT feature, TRUE AS in_range, TRUE AS add_up FROM {FEATURE_SQL}""")
def fold_importance(t: Inputs) -> DataFrame:
    """Importance of every feature over the folds: shares of one, with a deviation of at most a half."""
    found = learning.cross_validate(folded_matrix(t), FEATURES, "rf").feature_importance()
    fits = F.col("mean_importance").between(0, 1) & F.col("std_importance").between(0, 0.5)
    # One row per feature.
    whole = F.sum("mean_importance").over(Window.partitionBy(F.lit(1)))
    return found.select("feature", fits.alias("in_range"), (F.abs(whole - 1) < 1e-6).alias("add_up"))


@query("m8_m9_s21_saved_model_scores_every_row_once", MATRIX_ROWS + """
SELECT fww_id, wb_id, 'rf_model' AS model_version, 'historical' AS data_source, TRUE AS chances_add_up,
       TRUE AS larger_chance_wins FROM rows_used""")
def saved_model_scores(t: Inputs) -> DataFrame:
    rows = training_matrix(t)
    models = ModelStore(t.spark, new_folder(t.spark, "models"))
    models.save(learning.train_final(rows, FEATURES, "rf"), "rf", AS_OF)
    scored = learning.score(models.load("rf"), rows, FEATURES)
    rows = learning.prediction_rows(scored, "rf_model", "historical", AS_OF)
    poor, moderate = F.col("prob_poor"), F.col("prob_moderate")
    good = 1 - poor - moderate
    chance = F.when(F.col("predicted_status") == "Poor", poor).when(F.col("predicted_status") == "Moderate", moderate).otherwise(good)
    wins = chance >= F.greatest(poor, moderate, good) - 2e-4
    return rows.select("fww_id", "wb_id", "model_version", "data_source",
                       good.between(-2e-4, 1 + 2e-4).alias("chances_add_up"),
                       wins.alias("larger_chance_wins"))


@query("m10_w6_model_comparison", """
SELECT approach, n_methods, TRUE AS scores_in_range, 1 AS n_best, TRUE AS best_is_highest, TRUE AS gain_fits
FROM (VALUES ('Traditional', 4), ('AI / ML', 3)) v(approach, n_methods)""")
def model_comparison(t: Inputs) -> DataFrame:
    """Four rules and three models on the matrix: how many were compared, and that the best of each kind is not below another."""
    folded = folded_matrix(t)
    methods = written(training.comparison_table(folded, training.compare_models(folded, FEATURES)), "methods")
    best = agreement.comparison(methods)
    gain = F.abs(F.col("gain") - (F.col("model_f1") - F.col("rule_f1"))) < 1e-9
    chosen = best.select(F.lit("Traditional").alias("approach"), F.col("best_rule").alias("best"), F.col("rule_f1").alias("top"), gain.alias("fits"))
    chosen = chosen.unionByName(best.select(F.lit("AI / ML").alias("approach"), F.col("best_model").alias("best"), F.col("model_f1").alias("top"), gain.alias("fits")))
    return methods.join(chosen, "approach").groupBy("approach").agg(
        F.count("*").alias("n_methods"), F.bool_and(F.col("weighted_f1").between(0, 1)).alias("scores_in_range"),
        F.count_if(F.col("method") == F.col("best")).alias("n_best"),
        F.bool_and(F.col("weighted_f1") <= F.col("top")).alias("best_is_highest"), F.bool_and("fits").alias("gain_fits"))


@query("m11_w3_s20_ablation", """
SELECT * FROM (VALUES """ + ", ".join(
    f"({k}, '{name}', {len(features)}, TRUE, TRUE)" for k, (name, features) in enumerate(ABLATION.items(), 1)) + """)
  v(stage_no, feature_set, n_features, in_range, gain_fits)""")
def ablation(t: Inputs) -> DataFrame:
    """Scores of the nested feature sets, each with its gain over the set before."""
    stages = written(training.ablation(folded_matrix(t)), "stages")
    before = stages.select((F.col("stage_no") + 1).alias("stage_no"), F.col("f1").alias("f1_before"))
    fits = F.coalesce(F.abs(F.col("f1") - F.col("f1_before") - F.col("gain")) < 1e-9, F.col("gain").isNull() & (F.col("stage_no") == 1))
    return stages.join(before, "stage_no", "left").select(
        "stage_no", "feature_set", "n_features", (F.col("f1").between(0, 1) & F.col("pooled_f1").between(0, 1)).alias("in_range"), fits.alias("gain_fits"))


@query("m12_oversampled_rows", """
WITH c AS (SELECT COUNT(*) FILTER (label >= 7) AS poor, COUNT(*) FILTER (label < 7) AS moderate FROM embeddings)
SELECT 'Moderate' AS wfd_status, FALSE AS synthetic, moderate AS n, TRUE AS inside FROM c
UNION ALL SELECT 'Poor', FALSE, poor, TRUE FROM c UNION ALL SELECT 'Poor', TRUE, moderate - poor, TRUE FROM c""")
def oversampled_rows(t: Inputs) -> DataFrame:
    """Class sizes after oversampling, and whether all rows stay within the span of the real rows."""
    rows, _ = learning.prepared(vector_rows(t), NAMES)
    span = rows.groupBy("wfd_status").agg(F.min("f0").alias("low"), F.max("f0").alias("high"))
    grown = oversample(rows, NAMES).join(span, "wfd_status")
    return grown.groupBy("wfd_status", F.contains("fww_id", F.lit("+")).alias("synthetic")).agg(
        F.count("*").alias("n"), F.bool_and(F.col("f0").between(F.col("low"), F.col("high"))).alias("inside"))


@query("m12_e10_oversampled_forest", """
SELECT COUNT(*) AS n_tested, TRUE AS in_range, TRUE AS difference_fits FROM embeddings""")
def oversampled_forest(t: Inputs) -> DataFrame:
    """Forests on oversampled training slices: test rows are the real rows, and the verdict's difference is that of its scores."""
    folded = folded_vectors(t)
    result = training.train_oversampled(folded, NAMES)
    plain = learning.cross_validate(folded, NAMES, "rf").pooled()
    metrics = plain.select(F.col("moderate_f1").alias("mod_f1"), "poor_f1")
    verdict = training.oversampling_verdict(result, agreement.share_weighted_f1(metrics, folded))
    new, old = F.col("oversampled_f1"), F.col("baseline_f1")
    return verdict.select(
        F.lit(result.out_of_fold.select("fww_id").distinct().count()).alias("n_tested"), (new.between(0, 1) & old.between(0, 1)).alias("in_range"),
        ((F.abs(F.col("difference") - (new - old)) < 1e-9) & F.col("verdict").isNotNull()).alias("difference_fits"))


@query("m13_p23_feature_test", """
SELECT 'spills_per_pipe' AS feature, TRUE AS in_range, TRUE AS difference_fits""")
def feature_test(t: Inputs) -> DataFrame:
    """Forests with and without one feature of the matrix."""
    test = training.feature_test(folded_matrix(t), "spills_per_pipe", FEATURES, "rf")
    with_it, without = F.col("f1_with"), F.col("f1_without")
    return test.select("feature", (with_it.between(0, 1) & without.between(0, 1)).alias("in_range"),
                       ((F.abs(F.col("difference") - (without - with_it)) < 1e-9) & F.col("verdict").isNotNull()).alias("difference_fits"))


@query("p21_feature_groups", ctes(["readings"]) + """
SELECT 'chemistry' AS feature_group, 'nitrate_mid' AS feature, COUNT(nitrate_mid) AS n FROM readings
UNION ALL SELECT 'chemistry', 'phosphate_mid', COUNT(phosphate_mid) FROM readings
UNION ALL SELECT 'unassigned', 'easting', COUNT(easting) FROM readings UNION ALL SELECT 'unassigned', 'northing', COUNT(northing) FROM readings""")
def feature_groups(t: Inputs) -> DataFrame:
    """Numbers of the readings by feature group, with the readings that have them; those that no group takes are named."""
    numbers = [c for c, kind in t.readings.dtypes if kind == "double"]
    groups = matrix.feature_groups(numbers)
    counts = t.readings.agg(*[F.count(c).alias(c) for c in numbers])
    return counts.select(F.inline(F.array(*[
        F.struct(F.lit(g).alias("feature_group"), F.lit(f).alias("feature"), F.col(f).alias("n")) for g, fs in groups.items() for f in fs])))


@query("m15_x8_seed_stability", MATRIX_ROWS + """
SELECT COUNT(DISTINCT fww_id) AS n, TRUE AS spread_in_order, TRUE AS share_fits FROM rows_used""")
def seed_stability(t: Inputs) -> DataFrame:
    """Five seeds: the spread of their scores, and on how many sites all agree."""
    checks = training.seed_stability(folded_matrix(t), FEATURES, SEEDS)
    both = checks["spread"].withColumn("row", F.lit(1)).join(checks["agreement"].withColumn("row", F.lit(1)), "row")
    return both.select("n", (F.col("mean").between(F.col("least"), F.col("most")) & (F.col("std") >= 0)).alias("spread_in_order"),
                       ((F.col("n_agreed") <= F.col("n")) & (F.abs(F.col("pct_agreed") - 100 * F.col("n_agreed") / F.col("n")) < 1e-9)).alias("share_fits"))


@query("m16_hypothetical_site", MATRIX_ROWS + """
SELECT 'hypothetical' AS fww_id, CAST(0.3 AS DOUBLE) AS nitrate_mid, MEDIAN(phosphate_mid) AS phosphate_mid, TRUE AS chances_fit
FROM readings WHERE fww_id IN (SELECT fww_id FROM rows_used)""")
def hypothetical_site(t: Inputs) -> DataFrame:
    """A made-up site on the matrix: the given value, medians for the rest, and its chances."""
    rows = training_matrix(t)
    model = learning.train_final(rows, FEATURES, "rf")
    scored = learning.score(model, training.hypothetical(rows, FEATURES, {"nitrate_mid": 0.3}), FEATURES)
    poor, moderate = F.col("prob_poor"), F.col("prob_moderate")
    fits = poor.between(0, 1) & moderate.between(0, 1) & (poor + moderate <= 1.0002) & F.col("predicted_status").isin(*CLASSES)
    return scored.select("fww_id", "nitrate_mid", "phosphate_mid", fits.alias("chances_fit"))


@query("x1_x2_forest_shap_values", """
SELECT CAST(vec_id AS STRING) AS fww_id, 'f' || CAST(pos AS STRING) AS feature, CAST(embedding[pos + 1] AS DOUBLE) AS value, TRUE AS in_range
FROM embeddings, (SELECT UNNEST(range(64)) AS pos)""")
def forest_shap(t: Inputs) -> DataFrame:
    """One value per site and feature; no feature moves a probability by more than one."""
    rows = vector_rows(t)
    shap, _ = treeshap.shap_values(learning.train_final(rows, NAMES, "rf"), rows, NAMES)
    return shap.select("fww_id", "feature", "value", F.col("shap").between(-1, 1).alias("in_range"))


@query("x1_boosted_shap_values", MATRIX_ROWS + """
SELECT COUNT(*) AS n, COUNT(*) AS n_exact, 3 AS n_classes FROM rows_used""")
def boosted_shap(t: Inputs) -> DataFrame:
    """Boosted trees on the matrix: the explanations of the three classes add up to the margins that give the chance of Poor."""
    rows = training_matrix(t)
    model = learning.train_final(rows, FEATURES, "gbt")
    labels = learning.model_labels(model)
    sums = None
    for label in labels:
        shap, base = treeshap.shap_values(model, rows, FEATURES, label)
        part = shap.groupBy("fww_id").agg((F.sum("shap") + base).alias(f"m_{label}"))
        sums = part if sums is None else sums.join(part, "fww_id")
    margins = [F.col(f"m_{label}") for label in labels]
    chance = F.exp(F.col("m_Poor") - F.greatest(*margins)) / sum((F.exp(m - F.greatest(*margins)) for m in margins), F.lit(0.0))
    scored = learning.score(model, rows, FEATURES).select("fww_id", "prob_poor")
    return sums.join(scored, "fww_id").agg(
        F.count("*").alias("n"), F.count_if(F.abs(chance - F.col("prob_poor")) <= 0.0000501).alias("n_exact"),
        F.lit(len(labels)).alias("n_classes"))


@query("x1_additivity_of_shap_values", """
SELECT COUNT(*) AS n, COUNT(*) AS n_exact FROM embeddings""")
def shap_additivity(t: Inputs) -> DataFrame:
    rows = vector_rows(t)
    model = learning.train_final(rows, NAMES, "rf")
    shap, base = treeshap.shap_values(model, rows, NAMES)
    sums = shap.groupBy("fww_id").agg((F.sum("shap") + base).alias("total"))
    chance = learning.score(model, rows, NAMES).select("fww_id", "prob_poor")
    exact = F.abs(F.col("total") - F.col("prob_poor")) <= 0.0000501
    return sums.join(chance, "fww_id").agg(F.count("*").alias("n"), F.count_if(exact).alias("n_exact"))


@query("x3_x5_importance_and_sign_check", f"""
SELECT feature, TRUE AS in_range, TRUE AS sign_fits FROM {FEATURE_SQL}""")
def importance_and_sign(t: Inputs) -> DataFrame:
    rows = training_matrix(t)
    model = learning.train_final(rows, FEATURES, "rf")
    shap, _ = treeshap.shap_values(model, rows, FEATURES)
    shap = written(shap, "shap")
    importance = explain.global_importance(shap)
    corr = stats.correlation(shap, "value", "shap", ["feature"])
    checked = importance.join(corr, "feature").withColumn("as_expected", F.coalesce(F.col("corr") > 0, F.lit(False)))
    in_range = F.col("importance").between(0, 1) & F.coalesce(F.col("corr").between(-1.000001, 1.000001), F.lit(True))
    one = explain.sign_check(shap).select(F.lit("spills_per_pipe").alias("feature"), F.col("as_expected").alias("alone"))
    fits = F.coalesce(F.col("alone") == F.col("as_expected"), F.lit(True))
    return checked.join(one, "feature", "left").select("feature", in_range.alias("in_range"), fits.alias("sign_fits"))


@query("x4_shap_fold_stability", """
SELECT 10 AS n_pairs, TRUE AS in_range, TRUE AS band_fits""")
def shap_fold_stability(t: Inputs) -> DataFrame:
    """Five importance rankings, ten pairs of them and their mean rank correlation."""
    found = training.shap_fold_stability(folded_matrix(t), FEATURES)[1]
    return found.select("n_pairs", F.col("mean_spearman").between(-1, 1).alias("in_range"), F.col("stability").isNotNull().alias("band_fits"))
