"""Confusion tables and the scores that follow from them.

Everything starts from one count per (group, truth, prediction); the rest works on those few rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rivermeld.functions.rates import threshold_rules


def confusion(df: DataFrame, truth: str, predicted: str, by: list[str] | None = None) -> DataFrame:
    return (
        df.where(F.col(truth).isNotNull() & F.col(predicted).isNotNull())
        .groupBy(*(by or []), F.col(truth).alias("truth"), F.col(predicted).alias("predicted"))
        .agg(F.count("*").alias("n"))
    )


def confusion_matrix(conf: DataFrame, classes: list[str], by: list[str] | None = None) -> DataFrame:
    """One row per true class, one column pred_<class> each, zeros filled."""
    wide = conf.groupBy(*(by or []), "truth").pivot("predicted", classes).agg(F.sum("n")).na.fill(0)
    return wide.withColumnsRenamed({c: f"pred_{c}" for c in classes})


def class_scores(conf: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Support, precision, recall and F1 per class; divisions by zero give zero."""
    by = by or []
    hit = F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(F.lit(0))
    sides = F.array(
        F.struct(F.col("truth").alias("label"), F.col("n").alias("support"),
                 F.lit(0).cast("long").alias("claimed"), hit.cast("long").alias("hits")),
        F.struct(F.col("predicted").alias("label"), F.lit(0).cast("long").alias("support"),
                 F.col("n").alias("claimed"), F.lit(0).cast("long").alias("hits")),
    )
    counts = conf.select(*by, F.inline(sides)).groupBy(*by, "label").agg(
        *[F.sum(c).alias(c) for c in ("support", "claimed", "hits")])

    def ratio(a: Column, b: Column) -> Column:
        return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))

    hits, support, claimed = F.col("hits"), F.col("support"), F.col("claimed")
    return counts.select(
        *by, "label", "support", "claimed", "hits",
        ratio(hits, claimed).alias("precision"),
        ratio(hits, support).alias("recall"),
        ratio(2 * hits, support + claimed).alias("f1"),
    )


def weighted_f1(scores: DataFrame, by: list[str] | None = None) -> DataFrame:
    """F1 weighted by class support."""
    by = by or []
    value = F.try_divide(F.sum(F.col("support") * F.col("f1")), F.sum("support").cast("double"))
    return scores.groupBy(*by).agg(F.sum("support").alias("n"), value.alias("weighted_f1"))


def report(conf: DataFrame, classes: list[str], by: list[str]) -> DataFrame:
    """One row per group: weighted F1 and per-class precision, recall and F1 in columns."""
    scores = class_scores(conf, by)
    per_class = [
        F.coalesce(F.max(F.when(F.col("label") == c, F.col(m))), F.lit(0.0)).alias(f"{c.lower()}_{m}")
        for c in classes for m in ("precision", "recall", "f1")
    ]
    total = F.try_divide(F.sum(F.col("support") * F.col("f1")), F.sum("support").cast("double"))
    return scores.groupBy(*by).agg(total.alias("weighted_f1"), *per_class)


def apply_rules(df: DataFrame, rules: dict[str, Column], keep: list[str]) -> DataFrame:
    """All rules in one pass: a row per (input row, rule) with the rule's label."""
    cells = F.array(*[F.struct(F.lit(name).alias("method"), label.alias("predicted"))
                      for name, label in rules.items()])
    return df.select(*keep, F.inline(cells))


def evaluate_rules(matrix: DataFrame, rules: dict[str, Column] | None = None) -> DataFrame:
    """Any label rules scored as Poor against the rest, one row per rule, rounded to four places."""
    rules = rules or threshold_rules()
    truth = F.when(F.col("wfd_status") == "Poor", "Poor").otherwise("Moderate")
    flat = apply_rules(matrix.withColumn("truth_label", truth), rules, ["truth_label"])
    scored = report(confusion(flat, "truth_label", "predicted", ["method"]), ["Moderate", "Poor"], ["method"])
    return scored.select("method", *[F.round(c, 4).alias(c) for c in scored.columns if c != "method"])


def exact_agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.agg(F.avg(F.when(F.col(a) == F.col(b), 100.0).otherwise(0.0)).alias("agreement_pct"),
                  F.count("*").alias("n"))


def cohen_kappa(conf: DataFrame) -> DataFrame:
    """Agreement beyond chance; null when chance agreement is already complete."""
    totals = class_scores(conf).agg(
        F.sum("hits").alias("hits"), F.sum("support").alias("n"),
        F.sum(F.col("support") * F.col("claimed")).alias("chance"))
    n = F.col("n").cast("double")
    po, pe = F.col("hits") / n, F.col("chance") / (n * n)
    return totals.select(F.try_divide(po - pe, 1 - pe).alias("kappa"), F.col("n"))


def cross_tab(df: DataFrame, rows: str, columns: str, values: list[str]) -> DataFrame:
    """Counts with a Total row and a Total column."""
    cubed = (
        df.where(F.col(rows).isNotNull() & F.col(columns).isNotNull())
        .cube(rows, columns).agg(F.count("*").alias("n"), F.grouping(rows).alias("gr"),
                                 F.grouping(columns).alias("gc"))
        .select(F.when(F.col("gr") == 1, "Total").otherwise(F.col(rows)).alias(rows),
                F.when(F.col("gc") == 1, "Total").otherwise(F.col(columns)).alias("across"), "n")
    )
    return cubed.groupBy(rows).pivot("across", [*values, "Total"]).agg(F.sum("n")).na.fill(0)


def row_shares(df: DataFrame, rows: str, columns: str) -> DataFrame:
    """Percentage of each column value within its row value."""
    counts = df.groupBy(rows, columns).agg(F.count("*").alias("n"))
    whole = F.sum("n").over(Window.partitionBy(rows))
    return counts.select(rows, columns, (F.col("n") * 100.0 / whole).alias("pct"))


def share_weighted_f1(metrics: DataFrame, matrix: DataFrame) -> DataFrame:
    """Per-class F1 of one metrics row weighted by the class shares of the matrix."""
    shares = matrix.agg(*[
        (F.count_if(F.col("wfd_status") == c) / F.count("wfd_status")).alias(f"share_{c.lower()}")
        for c in ("Moderate", "Poor")])
    one = metrics.select(F.lit(1).alias("row"), "mod_f1", "poor_f1").limit(1)
    return one.join(shares.withColumn("row", F.lit(1)), "row").select(
        (F.col("mod_f1") * F.col("share_moderate") + F.col("poor_f1") * F.col("share_poor")).alias("baseline_f1"))


def run_agreement(labels: DataFrame, key: str, label: str) -> DataFrame:
    """Share of keys whose label is the same in every run."""
    per_key = labels.groupBy(key).agg((F.min(label) == F.max(label)).alias("same"))
    return per_key.agg(F.count_if("same").alias("n_agreed"), F.count("*").alias("n"),
                       (F.count_if("same") * 100.0 / F.count("*")).alias("pct_agreed"))


def run_spread(scores: DataFrame, value: str) -> DataFrame:
    """Mean, population deviation, minimum and maximum over runs."""
    return scores.agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"),
                      F.min(value).alias("least"), F.max(value).alias("most"))


def importance_spread(importance: DataFrame) -> DataFrame:
    """Mean and sample deviation per feature over runs."""
    return importance.groupBy("feature").agg(
        F.avg("importance").alias("mean_importance"), F.stddev_samp("importance").alias("std_importance"))


def stage_gains(stages: DataFrame) -> DataFrame:
    """Gain over the stage before; one row per stage, so the window is a handful of rows."""
    ordered = Window.orderBy("stage_no")
    return stages.withColumn("gain", F.col("f1") - F.lag("f1").over(ordered))


def comparison(methods: DataFrame) -> DataFrame:
    """Best traditional and best learned method, and the gain of one over the other."""
    learned = F.col("approach") == "AI / ML"
    score = F.struct("weighted_f1", "method")
    best = methods.agg(F.max(F.when(~learned, score)).alias("rule"), F.max(F.when(learned, score)).alias("model"))
    gain = F.col("model.weighted_f1") - F.col("rule.weighted_f1")
    return best.select(
        F.col("rule.method").alias("best_rule"), F.col("rule.weighted_f1").alias("rule_f1"),
        F.col("model.method").alias("best_model"), F.col("model.weighted_f1").alias("model_f1"),
        gain.alias("gain"), (gain / F.col("rule.weighted_f1") * 100).alias("gain_pct"))
