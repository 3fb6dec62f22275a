"""Summary queries over predictions, the feature matrix, metrics, the audit log and the live feed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivermeld.functions.grid import with_lon_lat
from rivermeld.functions.rates import confidence_band
from rivermeld.functions.wording import display_name, run_mark, status_meaning
from rivermeld.operators.keyed import first_per_key, latest_preferring, latest_rows, with_previous, with_uses


def latest_predictions(predictions: DataFrame) -> DataFrame:
    return latest_rows(predictions, "fww_id", "predicted_at")


def current_predictions(predictions: DataFrame) -> DataFrame:
    """Latest live prediction per site, or its latest one when it never had a live one."""
    return latest_preferring(predictions, "fww_id", "predicted_at", F.col("data_source") == "live")


def retained_predictions(predictions: DataFrame) -> DataFrame:
    """What a retention run keeps: one current row per site."""
    current = current_predictions(predictions)
    return first_per_key(current, ["fww_id"], ["data_source"])


def predictions_by_source(predictions: DataFrame, source: str | None = None) -> DataFrame:
    return predictions if source is None else predictions.where(F.col("data_source") == source)


def poor_share() -> Column:
    return F.avg(F.when(F.col("predicted_status") == "Poor", 100.0).otherwise(0.0))


def _with_matrix(predictions: DataFrame, matrix: DataFrame, columns: list[str], how: str = "inner") -> DataFrame:
    return latest_predictions(predictions).join(matrix.select("fww_id", *columns), "fww_id", how)


def county_summary(predictions: DataFrame, matrix: DataFrame, least: int = 30) -> DataFrame:
    """Percentage of Poor and rows per known county with enough rows."""
    known = F.col("county").isNotNull() & ~F.col("county").isin("Unknown", "")
    joined = _with_matrix(predictions, matrix.where(known), ["county"])
    summary = joined.groupBy("county").agg(poor_share().alias("pct_poor"), F.count("*").alias("n"))
    return summary.where(F.col("n") >= least)


def yearly_trend(predictions: DataFrame, matrix: DataFrame) -> DataFrame:
    """Percentage of Poor and rows per sample year."""
    joined = _with_matrix(predictions, matrix.where(F.col("sample_date").isNotNull()), ["sample_date"])
    return joined.groupBy(F.year("sample_date").alias("year")).agg(
        poor_share().alias("pct_poor"), F.count("*").alias("n_samples"))


def regional_comparison(predictions: DataFrame, matrix: DataFrame, county: str, more_than: int = 5) -> DataFrame:
    """Share of Poor in one county; no row unless it has more than a few predictions."""
    joined = _with_matrix(predictions, matrix.where(F.col("county") == county), ["county"])
    summary = joined.groupBy("county").agg(poor_share().alias("pct_poor"), F.count("*").alias("n"))
    return summary.where(F.col("n") > more_than)


def top_and_bottom(summary: DataFrame, by: str, k: int = 10) -> DataFrame:
    """The k highest and k lowest rows, each row once."""
    tie = [c for c in summary.columns if c != by]
    high = summary.orderBy(F.desc(by), *tie).limit(k)
    low = summary.orderBy(F.asc(by), *[F.desc(c) for c in tie]).limit(k)
    return high.unionByName(low).distinct()


def dashboard_sites(predictions: DataFrame, matrix: DataFrame) -> DataFrame:
    """Current predictions with county, position in degrees, display name, meaning and confidence."""
    current = current_predictions(predictions)
    columns = ["site_name", "easting", "northing", "county"]
    joined = current.drop(*columns).join(matrix.select("fww_id", *columns), "fww_id", "left")
    named = with_uses(with_lon_lat(joined), "site_name")
    return named.withColumns({
        "display_name": display_name("site_name", "county", "uses"),
        "meaning": status_meaning("predicted_status"),
        "confidence": confidence_band("prob_poor", "prob_moderate"),
    }).drop("uses")


def site_lookup(sites: DataFrame) -> DataFrame:
    """One display name per site id."""
    return first_per_key(sites.select("fww_id", "display_name"), ["fww_id"], ["display_name"])


def location_history(matrix: DataFrame) -> DataFrame:
    """Visits per place in date order with the change since the visit before; repeat places only."""
    visits = matrix.where(F.col("site_name").isNotNull() & F.col("county").isNotNull()).select(
        "site_name", "county", "fww_id", "sample_date", "nitrate_mid", "phosphate_mid")
    place = ["site_name", "county"]
    numbered = with_previous(visits, place, ["sample_date", "fww_id"], ["nitrate_mid", "phosphate_mid"],
                             F.date_trunc("month", "sample_date"))
    totals = visits.groupBy(*place).agg(F.count("*").alias("n_visits")).where(F.col("n_visits") > 1)
    return numbered.join(totals, place)


def location_change(matrix: DataFrame) -> DataFrame:
    """Visits, first and last nitrate and phosphate per place visited more than once."""
    order = F.struct("sample_date", "fww_id", "nitrate_mid", "phosphate_mid")
    known = matrix.where(F.col("site_name").isNotNull() & F.col("county").isNotNull())
    ends = known.groupBy("site_name", "county").agg(
        F.count("*").alias("n_visits"), F.min(order).alias("a"), F.max(order).alias("z"))
    return ends.where(F.col("n_visits") > 1).select(
        "site_name", "county", "n_visits",
        F.col("a.nitrate_mid").alias("first_nitrate"), F.col("z.nitrate_mid").alias("last_nitrate"),
        F.col("a.phosphate_mid").alias("first_phosphate"), F.col("z.phosphate_mid").alias("last_phosphate"))


def metrics_summary(metrics: DataFrame) -> DataFrame:
    """Folds and mean, least and most F1 per approach, model and feature set.

    The mean is taken over decimals, so its last place does not depend on the order of partial sums.
    """
    exact = F.col("weighted_f1").cast("decimal(18,12)")
    return metrics.groupBy("approach", "model_type", "feature_set").agg(
        F.count("*").alias("n_folds"),
        F.round(F.avg(exact), 4).cast("double").alias("mean_f1"),
        F.round(F.min("weighted_f1"), 4).alias("min_f1"),
        F.round(F.max("weighted_f1"), 4).alias("max_f1"),
    ).orderBy(F.desc("mean_f1"))


def recent_runs(log: DataFrame, k: int = 50) -> DataFrame:
    """Newest audit rows with a mark per status; a bounded top-k."""
    newest = log.orderBy(F.desc("run_at"), *[F.asc(c) for c in sorted(log.columns) if c != "run_at"]).limit(k)
    return newest.withColumn("mark", run_mark("status"))


def since(df: DataFrame, at: str, as_of: str, days: int) -> DataFrame:
    """Rows of the last `days` days before `as_of`, inclusive; the filter reaches the scan."""
    kind = df.schema[at].dataType.simpleString()
    floor = F.lit(as_of).cast(kind) - F.expr(f"INTERVAL {int(days)} DAYS")
    return df.where(F.col(at) >= floor)


def live_by_company(feed: DataFrame, as_of: str, days: int = 1) -> DataFrame:
    recent = since(feed, "received_at", as_of, days)
    return recent.groupBy("company", "status").agg(F.count("*").alias("n")).orderBy("company")


def live_matched(feed: DataFrame, as_of: str, days: int = 1) -> DataFrame:
    """Matched and all feed rows, and the matched percentage."""
    recent = since(feed, "received_at", as_of, days)
    counts = recent.agg(F.count("wb_id").alias("matched"), F.count("*").alias("total"))
    return counts.withColumn("pct", F.try_divide(F.col("matched") * 100.0, F.col("total").cast("double")))


def last_success(log: DataFrame, source: str, moved_rows: bool = False) -> DataFrame:
    """High-water mark of a job: its latest successful run, if asked only runs that moved rows."""
    good = log.where((F.col("source") == source) & (F.col("status") == "success"))
    if moved_rows:
        good = good.where(F.col("records_new") > 0)
    return good.agg(F.max("run_at").alias("last_run"))


def counts_by(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n"))


def date_range(df: DataFrame, at: str) -> DataFrame:
    return df.agg(F.min(at).alias("first_date"), F.max(at).alias("last_date"))
