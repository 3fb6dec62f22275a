"""Result documents: evaluation JSON to metric rows, and small results back to JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rivermeld.functions.rates import lookup

# fixed values: model keys of the result documents
MODEL_NAMES = {"logreg": "Logistic Regression", "rf": "Random Forest", "xgb": "XGBoost"}

_SCORES = "STRUCT<precision: DOUBLE, recall: DOUBLE, `f1-score`: DOUBLE, support: DOUBLE>"
RESULT_SCHEMA = f"""
    traditional ARRAY<STRUCT<method: STRING, weighted_f1: DOUBLE,
        moderate_precision: DOUBLE, moderate_recall: DOUBLE, moderate_f1: DOUBLE,
        poor_precision: DOUBLE, poor_recall: DOUBLE, poor_f1: DOUBLE>>,
    ml_comparison MAP<STRING, STRUCT<
        fold_results: ARRAY<STRUCT<fold: BIGINT, n_train: BIGINT, n_test: BIGINT, weighted_f1: DOUBLE>>,
        classification_report: STRUCT<Moderate: {_SCORES}, Poor: {_SCORES}>>>
"""


def metric_rows(results: DataFrame) -> DataFrame:
    """Metric rows of result documents: one per rule, one per model and fold.

    The per-class scores of a model are pooled over its folds and repeated on each fold row.
    """
    none = F.lit(None).cast("long")
    rules = results.select(F.inline("traditional")).select(
        F.col("method").alias("model_type"), F.lit("Traditional Rule-Based").alias("approach"),
        F.lit("phosphate + nitrate thresholds").alias("feature_set"),
        none.alias("fold_id"), none.alias("n_train"), none.alias("n_test"), "weighted_f1",
        F.col("moderate_precision").alias("mod_precision"), F.col("moderate_recall").alias("mod_recall"),
        F.col("moderate_f1").alias("mod_f1"), "poor_precision", "poor_recall", "poor_f1")
    models = results.select(F.explode("ml_comparison").alias("model_key", "body"))
    named = models.withColumn("model_type", lookup("model_key", MODEL_NAMES)).where(F.col("model_type").isNotNull())
    folds = named.select("model_type", F.col("body.classification_report").alias("scores"),
                         F.inline("body.fold_results"))

    def score(label: str, measure: str) -> Column:
        return F.col("scores")[label][measure]

    learned = folds.select(
        "model_type", F.lit("AI / Machine Learning").alias("approach"),
        F.lit("full_feature_set").alias("feature_set"),
        F.col("fold").alias("fold_id"), "n_train", "n_test", "weighted_f1",
        score("Moderate", "precision").alias("mod_precision"), score("Moderate", "recall").alias("mod_recall"),
        score("Moderate", "f1-score").alias("mod_f1"), score("Poor", "precision").alias("poor_precision"),
        score("Poor", "recall").alias("poor_recall"), score("Poor", "f1-score").alias("poor_f1"))
    return rules.unionByName(learned)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RESULT_SCHEMA).option("multiLine", True).json(path)


def write_document(df: DataFrame, path: str) -> None:
    """A small result as JSON lines in one file."""
    df.coalesce(1).write.mode("overwrite").json(path)
