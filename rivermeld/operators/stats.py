"""Exact quantiles, summaries and correlations that stay distributed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rivermeld.functions.parsing import column
from rivermeld.functions.rates import level_band

SPLITS = 256


def long_form(df: DataFrame, features: list[str], keep: list[str] | None = None,
              name: str = "feature", value: str = "value") -> DataFrame:
    """One row per feature; a narrow projection, no shuffle."""
    cells = F.array(*[F.struct(F.lit(f).alias(name), F.col(f).cast("double").alias(value)) for f in features])
    return df.select(*(keep or []), F.inline(cells))


def exact_quantiles(values: DataFrame, probs: dict[str, float], by: list[str]) -> DataFrame:
    """Linear-interpolated quantiles of column `value` per group, exactly, one column per entry of `probs`.

    Equal values are counted before the shuffle, so a value shared by a third of all rows is one row. The
    distinct values are cut into slices by an approximate sketch; slice totals tell which slices hold the
    wanted ranks, and only those are ordered.
    """
    counted = (
        values.where(F.col("value").isNotNull() & ~F.isnan("value"))
        .groupBy(*by, "value").agg(F.count("*").alias("k"))
    )
    marks = [i / SPLITS for i in range(1, SPLITS)]
    splits = counted.groupBy(*by).agg(F.percentile_approx("value", marks, 10000).alias("_marks"))
    sliced = counted.join(splits, by).select(
        *by, "value", "k", F.size(F.filter("_marks", lambda m: m < F.col("value"))).alias("slice"))
    totals = sliced.groupBy(*by, "slice").agg(F.sum("k").alias("rows"))
    # At most SPLITS rows per group from here on.
    ordered = Window.partitionBy(*by).orderBy("slice")
    group = Window.partitionBy(*by)
    placed = totals.select(
        *by, "slice",
        F.coalesce(F.sum("rows").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
        F.sum("rows").over(ordered).alias("upto"),
        F.sum("rows").over(group).alias("n"),
    )

    def position(p: float) -> Column:
        return (F.col("n") - 1) * F.lit(float(p))

    wanted = []
    for p in probs.values():
        for rank in (F.floor(position(p)), F.ceil(position(p))):
            wanted.append((F.col("before") <= rank) & (rank < F.col("upto")))
    hit = wanted[0]
    for w in wanted[1:]:
        hit = hit | w
    chosen = sliced.join(placed.where(hit), [*by, "slice"])
    inside = Window.partitionBy(*by, "slice").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    ranked = chosen.withColumn("last", F.col("before") + F.sum("k").over(inside))
    ranked = ranked.withColumn("first", F.col("last") - F.col("k"))
    picks = []
    for name, p in probs.items():
        for side, rank in (("lo", F.floor(position(p))), ("hi", F.ceil(position(p)))):
            on = (F.col("first") <= rank) & (rank < F.col("last"))
            picks.append(F.max(F.when(on, F.col("value"))).alias(f"_{name}_{side}"))
    picked = ranked.groupBy(*by).agg(F.max("n").alias("n"), *picks)
    results = []
    for name, p in probs.items():
        lo, hi = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        share = position(p) - F.floor(position(p))
        results.append((lo + (hi - lo) * share).alias(name))
    return picked.select(*by, *results)


def feature_quartiles(df: DataFrame, features: list[str]) -> DataFrame:
    """p25 and p75 per feature."""
    return exact_quantiles(long_form(df, features), {"p25": 0.25, "p75": 0.75}, ["feature"])


def feature_medians(df: DataFrame, features: list[str], by: list[str] | None = None) -> DataFrame:
    by = by or []
    return exact_quantiles(long_form(df, features, by), {"median": 0.5}, [*by, "feature"])


def feature_means(df: DataFrame, features: list[str], by: list[str] | None = None) -> DataFrame:
    """Means per group and feature; aggregated wide, then turned long."""
    by = by or []
    wide = df.groupBy(*by).agg(*[F.avg(F.col(f).cast("double")).alias(f) for f in features])
    return long_form(wide, features, by, value="mean")


def describe(df: DataFrame, feature: str) -> DataFrame:
    """count, mean, sample deviation, min, quartiles and max of one column."""
    values = df.select(F.lit(feature).alias("feature"), F.col(feature).cast("double").alias("value"))
    plain = values.groupBy("feature").agg(
        F.count("value").alias("count"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"))
    quartiles = exact_quantiles(values, {"p25": 0.25, "p50": 0.5, "p75": 0.75}, ["feature"])
    return plain.join(quartiles, "feature", "left")


def share_at_most(df: DataFrame, feature: str, value: float) -> DataFrame:
    """Percentage of rows at or below a value, rows at or above it, and all rows."""
    c = F.col(feature)
    return df.agg(
        F.avg(F.when(c <= value, 100.0).otherwise(0.0)).alias("pct_at_most"),
        F.count_if(c >= value).alias("n_at_least"),
        F.count("*").alias("n"),
    )


def pearson(x: Column | str, y: Column | str) -> Column:
    """Pearson correlation as an aggregate; null, not an error, when a side never varies."""
    both = column(x).isNotNull() & column(y).isNotNull()
    a = F.when(both, column(x).cast("double"))
    b = F.when(both, column(y).cast("double"))
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def correlation(df: DataFrame, x: str, y: str, by: list[str] | None = None, name: str = "corr") -> DataFrame:
    """Pearson correlation, per group if asked; mergeable moments only."""
    return df.groupBy(*(by or [])).agg(pearson(x, y).alias(name))


def average_rank_desc(df: DataFrame, by: list[str], value: str, name: str = "rank") -> DataFrame:
    """Descending rank with ties averaged; the groups are feature lists, so they are short."""
    rank = F.rank().over(Window.partitionBy(*by).orderBy(F.desc(value)))
    ties = F.count("*").over(Window.partitionBy(*by, value))
    return df.withColumn(name, rank + (ties - 1) / F.lit(2.0))


def rank_correlations(importance: DataFrame, group: str, item: str, value: str) -> DataFrame:
    """Spearman correlation of every pair of groups over shared items."""
    ranked = average_rank_desc(importance, [group], value).select(group, item, "rank")
    left = ranked.select(F.col(group).alias("group_a"), item, F.col("rank").alias("rank_a"))
    right = ranked.select(F.col(group).alias("group_b"), item, F.col("rank").alias("rank_b"))
    pairs = left.join(right, item).where(F.col("group_a") < F.col("group_b"))
    return pairs.groupBy("group_a", "group_b").agg(pearson("rank_a", "rank_b").alias("spearman"))


def direction_reliability(shap: DataFrame, matrix: DataFrame, features: list[str],
                          least: float = 0.15) -> DataFrame:
    """Whether each feature's SHAP direction agrees with the class means, and strongly enough."""
    corr = correlation(shap, "value", "shap", ["feature"], "shap_corr")
    means = matrix.where(F.col("wfd_status").isin("Moderate", "Poor"))
    wide = means.agg(*[
        F.avg(F.when(F.col("wfd_status") == status, F.col(f).cast("double"))).alias(f"{status}|{f}")
        for f in features for status in ("Moderate", "Poor")])
    rows = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"Moderate|{f}").alias("moderate_mean"),
                              F.col(f"Poor|{f}").alias("poor_mean")) for f in features])
    joined = corr.join(wide.select(F.inline(rows)), "feature")
    rises = F.coalesce(F.col("shap_corr") > 0, F.lit(False))
    higher = F.coalesce(F.col("poor_mean") > F.col("moderate_mean"), F.lit(False))
    return joined.withColumns({
        "directions_agree": rises == higher,
        "strong_enough": F.coalesce(F.abs("shap_corr") >= least, F.lit(False)),
    }).withColumn("reliable", F.col("directions_agree") & F.col("strong_enough"))


def direction_by_median(shap: DataFrame, matrix: DataFrame, features: list[str]) -> DataFrame:
    """SHAP correlation beside the class medians of chosen features."""
    corr = correlation(shap.where(F.col("feature").isin(features)), "value", "shap", ["feature"], "shap_corr")
    medians = (
        feature_medians(matrix, features, ["wfd_status"]).groupBy("feature")
        .agg(F.max(F.when(F.col("wfd_status") == "Moderate", F.col("median"))).alias("moderate_median"),
             F.max(F.when(F.col("wfd_status") == "Poor", F.col("median"))).alias("poor_median"))
    )
    return corr.join(medians, "feature").withColumn(
        "poor_higher", F.col("poor_median") > F.col("moderate_median"))


def level_of(values: DataFrame, quartiles: DataFrame) -> DataFrame:
    """Low / typical / high per long-form value; quartiles has one row per feature."""
    joined = values.join(F.broadcast(quartiles), "feature", "left")
    return joined.withColumn("level", level_band(column("value"), "p25", "p75")).drop("p25", "p75")
