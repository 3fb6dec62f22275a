"""Queries for the joins and the feature matrix."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivermeld.catalog.registry import Inputs, query
from rivermeld.catalog.sqltext import AS_OF, AS_OF_SQL, MATCHED, RETURNS, RIVERS, ctes, land_sql
from rivermeld.functions.parsing import duration_hours
from rivermeld.functions.rates import usable_position
from rivermeld.operators import landcover, matrix, nearest, sewage
from rivermeld.operators.keyed import distinct_tuples, latest_row
from rivermeld.plans import build, reports
from rivermeld.settings import LAND


def cleaned_returns(t: Inputs) -> DataFrame:
    """Both years' returns, cleaned; the newer year reduced to one row per monitor."""
    clean = sewage.clean_returns(t.edm_returns, duration_hours("duration_text"))
    older, newer = clean.where("data_year = 2024"), clean.where("data_year = 2025")
    return sewage.combine_years(older, newer, ["wb_id", "outlet_ngr", "spill_count", "spill_hrs"])


def edm_table(t: Inputs) -> DataFrame:
    return sewage.returns_per_waterbody(cleaned_returns(t))


def matched_readings(t: Inputs, max_dist: float | None = 5000.0) -> DataFrame:
    return matrix.match_waterbodies(t.readings, matrix.classified_rivers(t.waterbodies), max_dist)


def full_matrix(t: Inputs) -> DataFrame:
    """Readings to feature matrix: match, sewage, land cover, checks."""
    usable = matrix.usable_readings(t.readings)
    return build.full_build(usable, matrix.classified_rivers(t.waterbodies), edm_table(t), t.lc_cells)


@query("j1_nearest_waterbody", ctes(["readings", "waterbodies"], RIVERS, MATCHED) + """
SELECT fww_id, wb_id, wb_name, wfd_status, wfd_dist_m, match_q FROM matched""")
def nearest_waterbody(t: Inputs) -> DataFrame:
    return matched_readings(t, None).select("fww_id", "wb_id", "wb_name", "wfd_status", "wfd_dist_m", "match_q")


@query("j2_monitor_waterbody_within_5km", ctes(["monitors", "waterbodies"]) + """,
pairs AS (
  SELECT m.monitor_key, w.wb_id,
         (w.easting - m.x) * (w.easting - m.x) + (w.northing - m.y) * (w.northing - m.y) AS d2
  FROM monitors m CROSS JOIN waterbodies w WHERE m.x <> 0 AND m.y <> 0),
best AS (
  SELECT monitor_key, wb_id, d2, ROW_NUMBER() OVER (PARTITION BY monitor_key ORDER BY d2, wb_id) AS rn
  FROM pairs WHERE d2 <= 25000000)
SELECT m.monitor_key, m.company, b.wb_id, SQRT(b.d2) AS dist_m
FROM monitors m LEFT JOIN best b ON m.monitor_key = b.monitor_key AND b.rn = 1""")
def monitor_waterbody(t: Inputs) -> DataFrame:
    ok = usable_position("x", "y")
    feed = t.monitors.withColumns({"x": F.when(ok, F.col("x")), "y": F.when(ok, F.col("y"))})
    hit = nearest.nearest_join(feed, t.waterbodies, place_id="wb_id", max_dist=5000.0, xy=("x", "y"))
    return hit.select("monitor_key", "company", "wb_id", "dist_m")


@query("j3_sewage_by_waterbody", ctes(["readings", "waterbodies", "edm_returns"], RIVERS, MATCHED, RETURNS) + """
SELECT m.fww_id, m.wb_id, COALESCE(e.spill_count, 0) AS spill_count,
       ROUND(COALESCE(e.spill_hrs, 0), 6) AS spill_hrs, COALESCE(e.avg_spills, 0) AS avg_spills,
       COALESCE(e.n_overflows, 0) AS n_overflows, COALESCE(e.edm_pct, 0) AS edm_pct,
       COALESCE(e.spill_count / NULLIF(e.n_overflows, 0), 0) AS spills_per_pipe,
       ROUND(COALESCE(e.spill_hrs / NULLIF(e.n_overflows, 0), 0), 6) AS hrs_per_pipe
FROM matched m LEFT JOIN edm e ON m.wb_id = e.wb_id
WHERE m.match_q <> 'poor'""")
def sewage_by_waterbody(t: Inputs) -> DataFrame:
    near = matched_readings(t).where("match_q <> 'poor'")
    joined = sewage.attach_returns(near, edm_table(t))
    return joined.select(
        "fww_id", "wb_id", "spill_count", F.round("spill_hrs", 6).alias("spill_hrs"), "avg_spills",
        "n_overflows", "edm_pct", "spills_per_pipe", F.round("hrs_per_pipe", 6).alias("hrs_per_pipe"))


LAND_LIST = ", ".join(f"l.{c}" for c in LAND)


@query("j5_a11_land_cover_shares", ctes(["readings", "lc_cells"],
       "spots AS (SELECT DISTINCT easting, northing FROM readings)", land_sql()) + f"""
SELECT r.fww_id, {LAND_LIST} FROM readings r
LEFT JOIN land l ON r.easting = l.easting AND r.northing = l.northing""")
def land_cover_shares(t: Inputs) -> DataFrame:
    return landcover.land_shares(t.readings.select("fww_id", "easting", "northing"), t.lc_cells)


@query("j4_p8_p9_p10_feature_matrix", ctes(
    ["readings", "waterbodies", "edm_returns", "lc_cells"], RIVERS, MATCHED, RETURNS, land_sql()) + f"""
SELECT m.fww_id, m.site_name, m.sample_date, m.easting, m.northing, m.wb_id, m.nitrate_mid, m.phosphate_mid,
       COALESCE(e.spill_count, 0) AS spill_count, ROUND(COALESCE(e.spill_hrs, 0), 6) AS spill_hrs,
       COALESCE(e.avg_spills, 0) AS avg_spills, COALESCE(e.n_overflows, 0) AS n_overflows,
       COALESCE(e.spill_count / NULLIF(e.n_overflows, 0), 0) AS spills_per_pipe,
       ROUND(COALESCE(e.spill_hrs / NULLIF(e.n_overflows, 0), 0), 6) AS hrs_per_pipe,
       {LAND_LIST}, COALESCE(m.county, 'Unknown') AS county, COALESCE(m.rbd, 'Unknown') AS rbd,
       m.wfd_dist_m, m.match_q, m.wfd_status
FROM matched m LEFT JOIN edm e ON m.wb_id = e.wb_id
LEFT JOIN land l ON m.easting = l.easting AND m.northing = l.northing
WHERE m.country = 'England' AND m.nitrate_mid IS NOT NULL AND m.phosphate_mid IS NOT NULL
  AND m.match_q <> 'poor'""")
def feature_matrix(t: Inputs) -> DataFrame:
    return full_matrix(t).withColumns({
        "spill_hrs": F.round("spill_hrs", 6), "hrs_per_pipe": F.round("hrs_per_pipe", 6)})


@query("j6_u3_u6_stored_or_missing_land_cover", ctes(["readings"]) + """
SELECT fww_id, CASE WHEN fww_rating IN ('Good', 'Poor') THEN 'stored' ELSE 'missing' END AS land_cover
FROM readings""")
def land_cover_split(t: Inputs) -> DataFrame:
    stored = t.readings.where("fww_rating IN ('Good', 'Poor')").select("fww_id")
    has, lacks = matrix.split_land_cover(t.readings.select("fww_id"), stored)
    return has.withColumn("land_cover", F.lit("stored")).unionByName(
        lacks.withColumn("land_cover", F.lit("missing")))


@query("j7_p15_rating_against_status", ctes(["readings", "waterbodies"], RIVERS, MATCHED) + """
SELECT fww_id, fww_rating, wfd_status FROM matched
WHERE fww_rating <> 'No water available' AND match_q <> 'poor'""")
def rating_against_status(t: Inputs) -> DataFrame:
    ratings = t.readings.where("fww_rating <> 'No water available'").select("fww_id", "fww_rating")
    official = matched_readings(t).where("match_q <> 'poor'").select("fww_id", "wfd_status")
    return ratings.join(official, "fww_id")


POINTS = """points AS (
  SELECT fww_id, CONCAT('WB', CAST(CAST(fww_id AS BIGINT) % 15 AS STRING)) AS wb_id,
         CAST(CAST(fww_id AS BIGINT) % 9 AS BIGINT) AS n_overflows,
         CAST(CAST(fww_id AS BIGINT) % 13 AS DOUBLE) AS spills_per_pipe FROM readings)"""
LIVE_AGG = f"""live AS (
  SELECT wb_id, COUNT(*) FILTER (LOWER(status) = 'discharging') AS spill_count,
         COUNT(DISTINCT outlet_ngr) AS n_overflows
  FROM edm_live WHERE wb_id IS NOT NULL AND received_at >= {AS_OF_SQL} - INTERVAL 365 DAY GROUP BY wb_id)"""


def _points(t: Inputs) -> DataFrame:
    return t.readings.selectExpr(
        "fww_id", "CONCAT('WB', CAST(CAST(fww_id AS BIGINT) % 15 AS STRING)) AS wb_id",
        "CAST(fww_id AS BIGINT) % 9 AS n_overflows", "CAST(CAST(fww_id AS BIGINT) % 13 AS DOUBLE) AS spills_per_pipe")


def live_table(t: Inputs) -> DataFrame:
    return sewage.live_per_waterbody(reports.since(t.edm_live, "received_at", AS_OF, 365))


@query("j8_live_over_historical", ctes(["readings", "edm_live"], POINTS, LIVE_AGG) + """
SELECT p.fww_id, p.wb_id, COALESCE(l.n_overflows, p.n_overflows) AS n_overflows,
       COALESCE(CAST(l.spill_count AS DOUBLE) / GREATEST(l.n_overflows, 1), 0) AS spills_per_pipe
FROM points p LEFT JOIN live l ON p.wb_id = l.wb_id""")
def live_over_historical(t: Inputs) -> DataFrame:
    return sewage.overwrite_with_live(_points(t), live_table(t))


@query("j9_p14_rows_of_affected_waterbodies", ctes(["readings", "edm_live"], POINTS) + f"""
SELECT fww_id, wb_id FROM points WHERE wb_id IN (
  SELECT wb_id FROM edm_live WHERE wb_id IS NOT NULL AND received_at >= {AS_OF_SQL} - INTERVAL 2 DAY)""")
def affected_rows(t: Inputs) -> DataFrame:
    affected = distinct_tuples(reports.since(t.edm_live, "received_at", AS_OF, 2).where("wb_id IS NOT NULL"), ["wb_id"])
    return _points(t).join(affected, "wb_id", "left_semi").select("fww_id", "wb_id")


@query("j10_w1_latest_prediction_per_site", ctes(["predictions"]) + """
SELECT * EXCLUDE (r) FROM (
  SELECT *, RANK() OVER (PARTITION BY fww_id ORDER BY predicted_at DESC) AS r FROM predictions) WHERE r = 1""")
def latest_prediction(t: Inputs) -> DataFrame:
    return reports.latest_predictions(t.predictions)


@query("w1_strict_latest_prediction_per_site", ctes(["predictions"]) + """
SELECT * EXCLUDE (r) FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY fww_id ORDER BY predicted_at DESC, predicted_status, prob_poor,
    prob_moderate, data_source) AS r FROM predictions) WHERE r = 1""")
def strict_latest_prediction(t: Inputs) -> DataFrame:
    return latest_row(t.predictions, "fww_id", "predicted_at")


@query("j11_w2_latest_prediction_preferring_live", ctes(["predictions"]) + """,
l AS (SELECT fww_id, MAX(CASE WHEN data_source = 'live' THEN predicted_at END) AS live_time,
             MAX(predicted_at) AS any_time FROM predictions GROUP BY fww_id)
SELECT p.* FROM predictions p JOIN l ON p.fww_id = l.fww_id
  AND p.predicted_at = COALESCE(l.live_time, l.any_time)""")
def current_prediction(t: Inputs) -> DataFrame:
    return reports.current_predictions(t.predictions)


@query("j12_predictions_with_county", ctes(["predictions", "readings"]) + """
SELECT p.fww_id, p.predicted_status, p.data_source, r.county, r.sample_date
FROM predictions p LEFT JOIN readings r ON p.fww_id = r.fww_id""")
def predictions_with_county(t: Inputs) -> DataFrame:
    facts = t.readings.select("fww_id", "county", "sample_date")
    return t.predictions.join(facts, "fww_id", "left").select(
        "fww_id", "predicted_status", "data_source", "county", "sample_date")


@query("j15_nearest_site_to_a_click", ctes(["readings"]) + """
SELECT fww_id, easting, northing FROM (
  SELECT *, POWER((northing / 100000 - 2.345), 2) + POWER((easting / 100000 - 4.321), 2) AS deg2 FROM readings)
ORDER BY deg2, fww_id LIMIT 1""")
def nearest_to_click(t: Inputs) -> DataFrame:
    degrees = t.readings.withColumns({"lat": F.col("northing") / 100000, "lon": F.col("easting") / 100000})
    return nearest.nearest_by_degrees(degrees, 2.345, 4.321, "fww_id").select("fww_id", "easting", "northing")


@query("j16_a18_w7_f13_display_name_lookup", ctes(["readings"]) + """,
uses AS (SELECT site_name, COUNT(*) AS uses FROM readings GROUP BY site_name),
named AS (
  SELECT r.fww_id, CASE WHEN LOWER(TRIM(r.site_name)) IN ('other', 'n/a', 'unknown', 'unnamed', '')
           THEN CASE WHEN r.county IS NULL OR r.county = '' THEN 'Unnamed site'
                     ELSE 'Unnamed site, ' || r.county END
         WHEN u.uses <= 1 THEN r.site_name
         WHEN r.county IS NULL OR r.county = '' THEN r.site_name
         ELSE r.site_name || ', ' || r.county END AS display_name
  FROM readings r JOIN uses u ON r.site_name = u.site_name)
SELECT fww_id, MIN(display_name) AS display_name FROM named GROUP BY fww_id""")
def display_name_lookup(t: Inputs) -> DataFrame:
    from rivermeld.functions.wording import display_name
    from rivermeld.operators.keyed import with_uses

    named = with_uses(t.readings.select("fww_id", "site_name", "county"), "site_name")
    return reports.site_lookup(named.withColumn("display_name", display_name("site_name", "county", "uses")))


@query("j16_name_to_site", ctes(["readings"]) + """
SELECT site_name, MIN(fww_id) AS fww_id, COUNT(*) AS n FROM readings WHERE LOWER(site_name) LIKE '%site-1%'
GROUP BY site_name""")
def name_to_site(t: Inputs) -> DataFrame:
    found = t.readings.where(F.lower("site_name").contains("site-1"))
    return found.groupBy("site_name").agg(F.min("fww_id").alias("fww_id"), F.count("*").alias("n"))


@query("flagship_county_share_of_poor", ctes(["readings", "waterbodies"], RIVERS, MATCHED) + """
SELECT COALESCE(county, 'Unknown') AS county,
       AVG(CASE WHEN wfd_status = 'Poor' THEN CAST(100 AS DOUBLE) ELSE 0 END) AS pct_poor, COUNT(*) AS n
FROM matched WHERE country = 'England' AND nitrate_mid IS NOT NULL AND phosphate_mid IS NOT NULL
  AND match_q <> 'poor' GROUP BY 1 HAVING COUNT(*) >= 30""")
def county_share_of_poor(t: Inputs) -> DataFrame:
    usable = matrix.usable_readings(t.readings)
    matched = matrix.match_waterbodies(usable, matrix.classified_rivers(t.waterbodies))
    valid = matrix.build_matrix(matched)
    shares = valid.groupBy("county").agg(
        F.avg(F.when(F.col("wfd_status") == "Poor", 100.0).otherwise(0.0)).alias("pct_poor"),
        F.count("*").alias("n"))
    return shares.where("n >= 30").orderBy(F.desc("pct_poor"))
