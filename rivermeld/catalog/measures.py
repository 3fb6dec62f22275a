"""Queries for aggregates, windows, sorts and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivermeld.catalog.joins import cleaned_returns, edm_table, live_table
from rivermeld.catalog.registry import Inputs, query
from rivermeld.catalog.sqltext import AS_OF, AS_OF_SQL, RETURNS, ctes
from rivermeld.functions.rates import is_discharging, per_pipe_live
from rivermeld.operators import agreement, sewage, stats
from rivermeld.operators.keyed import (
    best_of, distinct_tuples, first_per_key, top_per_group, with_global_number, with_uses,
)
from rivermeld.plans import reports

DIMENSIONS = 64


def vector_long(t: Inputs) -> DataFrame:
    """Vector components as long rows: the shape of the keyed SHAP table (id, feature, value, shap)."""
    return t.table("embeddings").select(
        F.col("vec_id").cast("string").alias("fww_id"), "label", F.posexplode("embedding").alias("pos", "component"),
    ).select("fww_id", "label", F.concat(F.lit("f"), F.col("pos").cast("string")).alias("feature"),
             F.col("component").cast("double").alias("shap"),
             (F.col("component").cast("double") * F.col("component").cast("double")
              * (F.col("pos") % 3 - F.lit(1.5))).alias("value"))


VECTOR_LONG = """vectors AS (
  SELECT CAST(vec_id AS STRING) AS fww_id, label, pos, CAST(embedding[pos + 1] AS DOUBLE) AS shap
  FROM embeddings, (SELECT UNNEST(range(64)) AS pos)),
shap_long AS (SELECT fww_id, label, 'f' || CAST(pos AS STRING) AS feature, shap,
                     shap * shap * (pos % 3 - CAST(1.5 AS DOUBLE)) AS value FROM vectors)"""


@query("a1_u2_returns_per_waterbody", ctes(["edm_returns"], RETURNS) + """
SELECT wb_id, spill_count, ROUND(spill_hrs, 6) AS spill_hrs, avg_spills, n_overflows, edm_pct, n_outlets, years
FROM edm""")
def returns_per_waterbody(t: Inputs) -> DataFrame:
    return edm_table(t).withColumn("spill_hrs", F.round("spill_hrs", 6))


@query("a18_one_row_per_monitor", ctes(["edm_returns"], RETURNS) + """
SELECT unique_id, wb_id, outlet_ngr, spill_count, edm_pct FROM returns_kept WHERE data_year = 2025""")
def one_row_per_monitor(t: Inputs) -> DataFrame:
    return cleaned_returns(t).where("data_year = 2025").select(
        "unique_id", "wb_id", "outlet_ngr", "spill_count", "edm_pct")


LIVE_YEAR = f"""live AS (
  SELECT wb_id, COUNT(*) FILTER (LOWER(status) = 'discharging') AS spill_count,
         COUNT(DISTINCT outlet_ngr) AS n_overflows
  FROM edm_live WHERE wb_id IS NOT NULL AND received_at >= {AS_OF_SQL} - INTERVAL 365 DAY GROUP BY wb_id)"""


@query("a2_f8_f9_live_per_waterbody", ctes(["edm_live"], LIVE_YEAR) + """
SELECT wb_id, spill_count, n_overflows, CAST(spill_count AS DOUBLE) / GREATEST(n_overflows, 1) AS spills_per_pipe
FROM live""")
def live_per_waterbody(t: Inputs) -> DataFrame:
    return live_table(t)


@query("f9_substring_status_compat", ctes(["edm_live"]) + """
SELECT wb_id, COUNT(*) FILTER (status ILIKE '%discharge%') AS spill_count FROM edm_live
WHERE wb_id IS NOT NULL GROUP BY wb_id""")
def compat_status(t: Inputs) -> DataFrame:
    hits = F.count_if(is_discharging("status", compat=True)).alias("spill_count")
    return t.edm_live.where("wb_id IS NOT NULL").groupBy("wb_id").agg(hits)


@query("a3_p13_live_last_day", ctes(["edm_live"]) + f"""
SELECT wb_id, SUM(duration_hrs) AS spill_hrs, COUNT(*) AS n_overflows FROM edm_live
WHERE received_at >= {AS_OF_SQL} - INTERVAL 2 DAY GROUP BY wb_id""")
def live_last_day(t: Inputs) -> DataFrame:
    return sewage.live_totals(reports.since(t.edm_live, "received_at", AS_OF, 2))


@query("a4_t5_live_by_company", ctes(["edm_live"]) + f"""
SELECT company, status, COUNT(*) AS n FROM edm_live
WHERE received_at >= {AS_OF_SQL} - INTERVAL 1 DAY GROUP BY company, status ORDER BY company""")
def live_by_company(t: Inputs) -> DataFrame:
    return reports.live_by_company(t.edm_live, AS_OF)


@query("a5_live_matched_share", ctes(["edm_live"]) + f"""
SELECT COUNT(wb_id) AS matched, COUNT(*) AS total, COUNT(wb_id) * CAST(100 AS DOUBLE) / COUNT(*) AS pct
FROM edm_live WHERE received_at >= {AS_OF_SQL} - INTERVAL 7 DAY""")
def live_matched(t: Inputs) -> DataFrame:
    return reports.live_matched(t.edm_live, AS_OF, 7)


@query("a6_f19_metrics_summary", ctes(["model_metrics"]) + """
SELECT approach, model_type, feature_set, COUNT(*) AS n_folds,
       ROUND(AVG(CAST(weighted_f1 AS DECIMAL(18, 12))), 4) AS mean_f1,
       ROUND(MIN(weighted_f1), 4) AS min_f1, ROUND(MAX(weighted_f1), 4) AS max_f1
FROM model_metrics GROUP BY approach, model_type, feature_set ORDER BY mean_f1 DESC""")
def metrics_summary(t: Inputs) -> DataFrame:
    return reports.metrics_summary(t.model_metrics)


LATEST = """latest AS (SELECT fww_id, MAX(predicted_at) AS latest FROM predictions GROUP BY fww_id),
now AS (SELECT p.* FROM predictions p JOIN latest l ON p.fww_id = l.fww_id AND p.predicted_at = l.latest)"""


@query("a7_p17_county_summary", ctes(["predictions", "readings"], LATEST) + """
SELECT r.county, AVG(CASE WHEN n.predicted_status = 'Poor' THEN CAST(100 AS DOUBLE) ELSE 0 END) AS pct_poor,
       COUNT(*) AS n
FROM now n JOIN readings r ON n.fww_id = r.fww_id
WHERE r.county IS NOT NULL AND r.county <> 'Unknown' AND r.county <> '' GROUP BY r.county HAVING COUNT(*) >= 18""")
def county_summary(t: Inputs) -> DataFrame:
    return reports.county_summary(t.predictions, t.readings, least=18)


@query("a8_f20_yearly_trend", ctes(["predictions", "readings"], LATEST) + """
SELECT CAST(YEAR(r.sample_date) AS INT) AS year,
       AVG(CASE WHEN n.predicted_status = 'Poor' THEN CAST(100 AS DOUBLE) ELSE 0 END) AS pct_poor,
       COUNT(*) AS n_samples
FROM now n JOIN readings r ON n.fww_id = r.fww_id WHERE r.sample_date IS NOT NULL GROUP BY 1""")
def yearly_trend(t: Inputs) -> DataFrame:
    return reports.yearly_trend(t.predictions, t.readings)


@query("a9_regional_comparison", ctes(["predictions", "readings"], LATEST) + """
SELECT r.county, AVG(CASE WHEN n.predicted_status = 'Poor' THEN CAST(100 AS DOUBLE) ELSE 0 END) AS pct_poor,
       COUNT(*) AS n
FROM now n JOIN readings r ON n.fww_id = r.fww_id WHERE r.county = 'county-3' GROUP BY r.county
HAVING COUNT(*) > 5""")
def regional_comparison(t: Inputs) -> DataFrame:
    return reports.regional_comparison(t.predictions, t.readings, "county-3")


@query("a10_counts_by_status", ctes(["edm_live"]) + "SELECT status, COUNT(*) AS n FROM edm_live GROUP BY status")
def counts_by_status(t: Inputs) -> DataFrame:
    return reports.counts_by(t.edm_live, "status")


@query("a12_feature_quartiles", ctes(["readings"]) + """
SELECT 'nitrate_mid' AS feature, QUANTILE_CONT(nitrate_mid, 0.25) AS p25, QUANTILE_CONT(nitrate_mid, 0.75) AS p75
FROM readings
UNION ALL SELECT 'phosphate_mid', QUANTILE_CONT(phosphate_mid, 0.25), QUANTILE_CONT(phosphate_mid, 0.75) FROM readings
UNION ALL SELECT 'easting', QUANTILE_CONT(easting, 0.25), QUANTILE_CONT(easting, 0.75) FROM readings""")
def feature_quartiles(t: Inputs) -> DataFrame:
    return stats.feature_quartiles(t.readings, ["nitrate_mid", "phosphate_mid", "easting"])


@query("a13_medians_by_class", """
SELECT l_returnflag, 'l_extendedprice' AS feature, MEDIAN(l_extendedprice) AS median FROM lineitem GROUP BY 1
UNION ALL SELECT l_returnflag, 'l_quantity', MEDIAN(l_quantity) FROM lineitem GROUP BY 1""")
def medians_by_class(t: Inputs) -> DataFrame:
    return stats.feature_medians(t.table("lineitem"), ["l_extendedprice", "l_quantity"], ["l_returnflag"])


@query("a13_means_by_class", ctes(["readings"]) + """
SELECT fww_rating, 'easting' AS feature, AVG(easting) AS mean FROM readings GROUP BY 1
UNION ALL SELECT fww_rating, 'northing', AVG(northing) FROM readings GROUP BY 1""")
def means_by_class(t: Inputs) -> DataFrame:
    return stats.feature_means(t.readings, ["easting", "northing"], ["fww_rating"])


@query("a14_describe", """
SELECT 'l_quantity' AS feature, COUNT(l_quantity) AS count, AVG(l_quantity) AS mean,
       ROUND(STDDEV_SAMP(l_quantity), 9) AS std, MIN(l_quantity) AS min, MAX(l_quantity) AS max,
       QUANTILE_CONT(l_quantity, 0.25) AS p25, QUANTILE_CONT(l_quantity, 0.5) AS p50,
       QUANTILE_CONT(l_quantity, 0.75) AS p75 FROM lineitem""")
def describe(t: Inputs) -> DataFrame:
    return stats.describe(t.table("lineitem"), "l_quantity").withColumn("std", F.round("std", 9))


@query("a15_share_at_most", ctes(["edm_returns"], RETURNS) + """
SELECT AVG(CASE WHEN n_overflows <= 600 THEN CAST(100 AS DOUBLE) ELSE 0 END) AS pct_at_most,
       COUNT(*) FILTER (n_overflows >= 600) AS n_at_least, COUNT(*) AS n FROM edm""")
def share_at_most(t: Inputs) -> DataFrame:
    return stats.share_at_most(edm_table(t), "n_overflows", 600)


RATED = "rated AS (SELECT doc_id, quality, toxic FROM labels)"


@query("a16_cross_tab_with_totals", """
SELECT COALESCE(CAST(quality AS STRING), 'Total') AS quality, COUNT(*) FILTER (toxic = 0) AS "0",
       COUNT(*) FILTER (toxic = 1) AS "1", COUNT(*) AS "Total"
FROM labels GROUP BY ROLLUP (quality)""")
def cross_tab(t: Inputs) -> DataFrame:
    text = t.table("labels").selectExpr("CAST(quality AS STRING) AS quality", "CAST(toxic AS STRING) AS toxic")
    return agreement.cross_tab(text, "quality", "toxic", ["0", "1"])


@query("a16_cross_tab_row_shares", """
SELECT quality, toxic, COUNT(*) * CAST(100 AS DOUBLE) / SUM(COUNT(*)) OVER (PARTITION BY quality) AS pct
FROM labels GROUP BY quality, toxic""")
def cross_tab_shares(t: Inputs) -> DataFrame:
    return agreement.row_shares(t.table("labels"), "quality", "toxic")


@query("a17_distinct_positions", ctes(["readings"]) + "SELECT DISTINCT site_name, easting, northing FROM readings")
def distinct_positions(t: Inputs) -> DataFrame:
    return distinct_tuples(t.readings, ["site_name", "easting", "northing"])


@query("a19_t2_last_run_with_rows", ctes(["ingestion_log"]) + """
SELECT MAX(run_at) AS last_run FROM ingestion_log
WHERE source = 'live_inference' AND status = 'success' AND records_new > 0""")
def last_run(t: Inputs) -> DataFrame:
    return reports.last_success(t.ingestion_log, "live_inference", moved_rows=True)


@query("a20_date_range", ctes(["readings"]) + """
SELECT MIN(sample_date) AS first_date, MAX(sample_date) AS last_date FROM readings""")
def date_range(t: Inputs) -> DataFrame:
    return reports.date_range(t.readings, "sample_date")


@query("a21_share_weighted_f1", ctes(["readings"]) + """,
shares AS (SELECT COUNT(*) FILTER (fww_rating = 'Moderate') / CAST(COUNT(fww_rating) AS DOUBLE) AS m,
                  COUNT(*) FILTER (fww_rating = 'Poor') / CAST(COUNT(fww_rating) AS DOUBLE) AS p FROM readings),
one AS (SELECT CAST(MAX(p_size) AS DOUBLE) / 100 AS mod_f1, CAST(MIN(p_size) AS DOUBLE) / 100 AS poor_f1 FROM part)
SELECT mod_f1 * m + poor_f1 * p AS baseline_f1 FROM one, shares""")
def share_weighted_f1(t: Inputs) -> DataFrame:
    metrics = t.table("part").agg((F.max("p_size").cast("double") / 100).alias("mod_f1"),
                                  (F.min("p_size").cast("double") / 100).alias("poor_f1"))
    return agreement.share_weighted_f1(metrics, t.readings.withColumnRenamed("fww_rating", "wfd_status"))


@query("a22_full_agreement_across_runs", """
SELECT COUNT(*) FILTER (same) AS n_agreed, COUNT(*) AS n,
       COUNT(*) FILTER (same) * CAST(100 AS DOUBLE) / COUNT(*) AS pct_agreed
FROM (SELECT l_orderkey, MIN(l_returnflag) = MAX(l_returnflag) AS same FROM lineitem GROUP BY l_orderkey)""")
def full_agreement(t: Inputs) -> DataFrame:
    return agreement.run_agreement(t.table("lineitem"), "l_orderkey", "l_returnflag")


@query("a24_spread_over_runs", ctes(["model_metrics"]) + """
SELECT ROUND(AVG(weighted_f1), 9) AS mean, ROUND(STDDEV_POP(weighted_f1), 9) AS std,
       MIN(weighted_f1) AS least, MAX(weighted_f1) AS most FROM model_metrics""")
def spread_over_runs(t: Inputs) -> DataFrame:
    spread = agreement.run_spread(t.model_metrics, "weighted_f1")
    return spread.withColumns({"mean": F.round("mean", 9), "std": F.round("std", 9)})


@query("x8_a24_importance_spread", f"WITH {VECTOR_LONG}" + """,
runs AS (SELECT feature, label, AVG(ABS(shap)) AS importance FROM shap_long GROUP BY feature, label)
SELECT feature, ROUND(AVG(importance), 9) AS mean_importance, ROUND(STDDEV_SAMP(importance), 9) AS std_importance
FROM runs GROUP BY feature""")
def importance_spread(t: Inputs) -> DataFrame:
    runs = vector_long(t).groupBy("feature", "label").agg(F.avg(F.abs("shap")).alias("importance"))
    spread = agreement.importance_spread(runs)
    return spread.select("feature", *[F.round(c, 9).alias(c) for c in ("mean_importance", "std_importance")])


# ---- windows -------------------------------------------------------------------------------------
@query("w3_stage_gain", ctes(["model_metrics"]) + """,
stages AS (SELECT fold_id AS stage_no, MAX(weighted_f1) AS top, COUNT(*) AS n,
                  SUM(CAST(ROUND(weighted_f1 * 50) AS BIGINT)) / CAST(50 AS DOUBLE) / COUNT(*) AS f1
           FROM model_metrics GROUP BY fold_id)
SELECT stage_no, f1, f1 - LAG(f1) OVER (ORDER BY stage_no) AS gain FROM stages""")
def stage_gain(t: Inputs) -> DataFrame:
    units = F.sum(F.round(F.col("weighted_f1") * 50).cast("long"))
    stages = t.model_metrics.groupBy(F.col("fold_id").alias("stage_no")).agg(
        (units / F.lit(50.0) / F.count("*")).alias("f1"))
    return agreement.stage_gains(stages)


@query("w4_average_rank_descending", ctes(["model_metrics"]) + """,
best AS (SELECT fold_id, model_type, MAX(weighted_f1) AS top FROM model_metrics GROUP BY 1, 2)
SELECT fold_id, model_type, top, RANK() OVER (PARTITION BY fold_id ORDER BY top DESC)
       + (COUNT(*) OVER (PARTITION BY fold_id, top) - 1) / CAST(2 AS DOUBLE) AS rank FROM best""")
def average_rank(t: Inputs) -> DataFrame:
    best = t.model_metrics.groupBy("fold_id", "model_type").agg(F.max("weighted_f1").alias("top"))
    return stats.average_rank_desc(best, ["fold_id"], "top")


HISTORY = """visits AS (SELECT site_name, county, fww_id, sample_date, nitrate_mid, phosphate_mid FROM readings
  WHERE county IS NOT NULL AND site_name IS NOT NULL)"""


@query("w5_location_history", ctes(["readings"], HISTORY) + """
SELECT * FROM (
  SELECT *, ROW_NUMBER() OVER w AS visit_no, LAG(nitrate_mid) OVER w AS prev_nitrate_mid,
         LAG(phosphate_mid) OVER w AS prev_phosphate_mid, COUNT(*) OVER (PARTITION BY site_name, county) AS n_visits
  FROM visits WINDOW w AS (PARTITION BY site_name, county ORDER BY sample_date, fww_id)) WHERE n_visits > 1""")
def location_history(t: Inputs) -> DataFrame:
    return reports.location_history(t.readings)


@query("w5_location_change", ctes(["readings"], HISTORY) + """,
ranked AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY site_name, county ORDER BY sample_date, fww_id) AS a,
                  ROW_NUMBER() OVER (PARTITION BY site_name, county ORDER BY sample_date DESC, fww_id DESC) AS z
           FROM visits)
SELECT site_name, county, COUNT(*) AS n_visits, MAX(nitrate_mid) FILTER (a = 1) AS first_nitrate,
       MAX(nitrate_mid) FILTER (z = 1) AS last_nitrate, MAX(phosphate_mid) FILTER (a = 1) AS first_phosphate,
       MAX(phosphate_mid) FILTER (z = 1) AS last_phosphate
FROM ranked GROUP BY site_name, county HAVING COUNT(*) > 1""")
def location_change(t: Inputs) -> DataFrame:
    return reports.location_change(t.readings)


@query("w6_best_of_group", ctes(["model_metrics"]) + """
SELECT approach, MAX(model_type) FILTER (weighted_f1 = top) AS model_type, MAX(top) AS best_score
FROM (SELECT *, MAX(weighted_f1) OVER (PARTITION BY approach) AS top FROM model_metrics) GROUP BY approach""")
def best_of_group(t: Inputs) -> DataFrame:
    return best_of(t.model_metrics, ["approach"], "model_type", "weighted_f1")


@query("w7_name_uses", ctes(["readings"]) + """
SELECT fww_id, site_name, COUNT(*) OVER (PARTITION BY site_name) AS uses FROM readings""")
def name_uses(t: Inputs) -> DataFrame:
    return with_uses(t.readings.select("fww_id", "site_name"), "site_name")


# ---- sorts and limits ----------------------------------------------------------------------------
@query("o1_f17_recent_runs", ctes(["ingestion_log"]) + """
SELECT *, CASE status WHEN 'success' THEN '✅' WHEN 'no_new_data' THEN '⏸️' WHEN 'failed' THEN '❌'
               WHEN 'skipped' THEN '⏭️' ELSE '⚠️' END AS mark
FROM ingestion_log ORDER BY run_at DESC LIMIT 50""")
def recent_runs(t: Inputs) -> DataFrame:
    return reports.recent_runs(t.ingestion_log)


@query("o2_top_overflow_waterbodies", ctes(["edm_returns"], RETURNS) + """
SELECT wb_id, n_overflows, spill_count FROM edm ORDER BY n_overflows DESC, wb_id LIMIT 10""")
def top_overflow(t: Inputs) -> DataFrame:
    return edm_table(t).select("wb_id", "n_overflows", "spill_count").orderBy(F.desc("n_overflows"), "wb_id").limit(10)


@query("o3_u4_highest_and_lowest_counties", ctes(["readings"]) + """,
summary AS (SELECT county, AVG(CASE WHEN fww_rating = 'Poor' THEN CAST(100 AS DOUBLE) ELSE 0 END) AS pct_poor,
                   COUNT(*) AS n FROM readings WHERE county IS NOT NULL GROUP BY county)
SELECT * FROM (SELECT * FROM summary ORDER BY pct_poor DESC, county, n LIMIT 4)
UNION SELECT * FROM (SELECT * FROM summary ORDER BY pct_poor, county DESC, n DESC LIMIT 4)""")
def highest_and_lowest(t: Inputs) -> DataFrame:
    summary = t.readings.where("county IS NOT NULL").groupBy("county").agg(
        F.avg(F.when(F.col("fww_rating") == "Poor", 100.0).otherwise(0.0)).alias("pct_poor"),
        F.count("*").alias("n"))
    return reports.top_and_bottom(summary, "pct_poor", 4)


@query("o4_o8_x3_top_features_by_importance", f"WITH {VECTOR_LONG}" + """
SELECT feature, ROUND(AVG(ABS(shap)), 9) AS importance FROM shap_long GROUP BY feature
ORDER BY importance DESC, feature LIMIT 8""")
def top_features(t: Inputs) -> DataFrame:
    from rivermeld.operators.explain import global_importance

    rounded = global_importance(vector_long(t)).withColumn("importance", F.round("importance", 9))
    return rounded.orderBy(F.desc("importance"), "feature").limit(8)


@query("o5_top_factors_per_sign_and_site", f"WITH {VECTOR_LONG}" + """
SELECT fww_id, feature, shap, sign FROM (
  SELECT *, SIGN(shap) AS sg, CASE WHEN shap > 0 THEN 'Polluted' ELSE 'Healthy' END AS sign,
         ROW_NUMBER() OVER (PARTITION BY fww_id, shap > 0 ORDER BY ABS(shap) DESC, feature) AS r
  FROM shap_long WHERE shap <> 0) WHERE r <= 3""")
def top_factors(t: Inputs) -> DataFrame:
    from rivermeld.operators.explain import top_factors_per_sign

    return top_factors_per_sign(vector_long(t).select("fww_id", "feature", "shap"), 3)


@query("o6_e8_by_absolute_correlation", f"WITH {VECTOR_LONG}" + """,
c AS (SELECT feature, CORR(value, shap) AS corr FROM shap_long GROUP BY feature)
SELECT feature, ROUND(corr, 6) AS corr FROM c ORDER BY ABS(corr) DESC""")
def by_absolute_correlation(t: Inputs) -> DataFrame:
    corr = stats.correlation(vector_long(t), "value", "shap", ["feature"])
    return corr.select("feature", F.round("corr", 6).alias("corr")).orderBy(F.abs("corr").desc())


@query("o7_first_matches_by_date", ctes(["readings"]) + """
SELECT fww_id, site_name, sample_date FROM readings WHERE site_name = 'Other'
ORDER BY sample_date, fww_id LIMIT 10""")
def first_matches(t: Inputs) -> DataFrame:
    found = t.readings.where("site_name = 'Other'").select("fww_id", "site_name", "sample_date")
    return found.orderBy("sample_date", "fww_id").limit(10)


@query("p20_seeded_sample", ctes(["readings"]) + """
SELECT fww_id, site_name FROM readings ORDER BY md5('42:' || fww_id), fww_id LIMIT 25""")
def seeded_sample(t: Inputs) -> DataFrame:
    from rivermeld.operators.sampling import seeded_sample as draw

    return draw(t.readings.select("fww_id", "site_name"), "fww_id", 25, 42)


@query("row_numbers_without_global_sort", ctes(["readings"]) + """
SELECT COUNT(*) AS n, COUNT(DISTINCT row_no) AS n_distinct, MIN(row_no) AS first_no, MAX(row_no) AS last_no
FROM (SELECT ROW_NUMBER() OVER (ORDER BY fww_id) - 1 AS row_no FROM readings)""")
def global_numbers(t: Inputs) -> DataFrame:
    numbered = with_global_number(t.readings.select("fww_id"), ["fww_id"])
    return numbered.agg(F.count("*").alias("n"), F.countDistinct("row_no").alias("n_distinct"),
                        F.min("row_no").alias("first_no"), F.max("row_no").alias("last_no"))


# ---- set operations ------------------------------------------------------------------------------
@query("u1_union_of_differing_sheets", ctes(["edm_returns"]) + """
SELECT unique_id, wb_id, edm_pct, CAST(NULL AS STRING) AS duration_text FROM edm_returns WHERE data_year = 2024
UNION ALL SELECT unique_id, wb_id, NULL, duration_text FROM edm_returns WHERE data_year = 2025""")
def union_of_sheets(t: Inputs) -> DataFrame:
    from rivermeld.sources.files import union_sheets

    first = t.edm_returns.where("data_year = 2024").select("unique_id", "wb_id", "edm_pct")
    second = t.edm_returns.where("data_year = 2025").select("duration_text", "unique_id", "wb_id")
    return union_sheets([first, second])


@query("u5_rows_of_all_companies", ctes(["edm_live"]) + """
SELECT company, COUNT(*) AS n, COUNT(wb_id) AS matched FROM edm_live GROUP BY company""")
def all_companies(t: Inputs) -> DataFrame:
    from rivermeld.sources.files import union_sheets

    parts = [t.edm_live.where(F.col("company") == f"company-{i}") for i in range(3)]
    return union_sheets(parts).groupBy("company").agg(F.count("*").alias("n"), F.count("wb_id").alias("matched"))


@query("u6_ids_not_yet_stored", ctes(["readings", "predictions"]) + """
SELECT fww_id FROM readings EXCEPT SELECT fww_id FROM predictions""")
def ids_not_stored(t: Inputs) -> DataFrame:
    return t.readings.select("fww_id").join(t.predictions.select("fww_id"), "fww_id", "left_anti").distinct()


@query("a2_per_outlet_rate", ctes(["edm_live"]) + """
SELECT company, COUNT(DISTINCT outlet_ngr) AS pipes,
       CAST(COUNT(*) AS DOUBLE) / GREATEST(COUNT(DISTINCT outlet_ngr), 1) AS rate FROM edm_live GROUP BY company""")
def per_outlet_rate(t: Inputs) -> DataFrame:
    per_outlet = t.edm_live.groupBy("company", "outlet_ngr").agg(F.count("*").alias("k"))
    totals = per_outlet.groupBy("company").agg(F.sum("k").alias("k"), F.count("outlet_ngr").alias("pipes"))
    return totals.select("company", "pipes", per_pipe_live("k", "pipes").alias("rate"))


@query("o5_best_reading_per_county", ctes(["readings"]) + """
SELECT county, fww_id, nitrate_mid FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY county ORDER BY nitrate_mid DESC NULLS LAST, fww_id) AS r
  FROM readings WHERE county IS NOT NULL) WHERE r <= 5""")
def best_reading(t: Inputs) -> DataFrame:
    known = t.readings.where("county IS NOT NULL").select("county", "fww_id", "nitrate_mid")
    return top_per_group(known, ["county"], [F.desc("nitrate_mid"), F.col("fww_id")], 5)


@query("a18_first_reading_per_site", ctes(["readings"]) + """
SELECT site_name, fww_id, sample_date FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY site_name ORDER BY sample_date, fww_id) AS r FROM readings) WHERE r = 1""")
def first_reading(t: Inputs) -> DataFrame:
    return first_per_key(t.readings.select("site_name", "fww_id", "sample_date"), ["site_name"], ["sample_date", "fww_id"])
