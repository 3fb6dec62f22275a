"""Queries for projections, filters, scalar functions, readers and stores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivermeld.catalog.joins import cleaned_returns, edm_table
from rivermeld.catalog.registry import Inputs, query
from rivermeld.catalog.sqltext import AS_OF, HOURS, MATCHED, RETURNS, RIVERS, ctes
from rivermeld.functions import grid, parsing, rates, wording
from rivermeld.operators import landcover, matrix, sewage, stats
from rivermeld.operators.learning import label_indexer
from rivermeld.plans import build, reports, training
from rivermeld.session import new_folder
from rivermeld.settings import FEATURE_LABELS, LAND_GROUPS, LAND_WORDS, STATUS_MEANING
from rivermeld.sources import documents, files
from rivermeld.sources.schemas import TABLES
from rivermeld.sources.store import Warehouse


# ---- projections and filters ---------------------------------------------------------------------
@query("p1_p2_p3_usable_readings", ctes(["readings"]) + """
SELECT fww_id, site_name, nitrate_mid, phosphate_mid FROM readings
WHERE country = 'England' AND easting IS NOT NULL AND northing IS NOT NULL
  AND nitrate_mid IS NOT NULL AND phosphate_mid IS NOT NULL""")
def usable_readings(t: Inputs) -> DataFrame:
    return matrix.usable_readings(t.readings).select("fww_id", "site_name", "nitrate_mid", "phosphate_mid")


@query("p4_p5_p6_classified_rivers", ctes(["waterbodies"], RIVERS) + "SELECT wb_id, wb_name, wfd_status FROM rivers")
def classified_rivers(t: Inputs) -> DataFrame:
    return matrix.classified_rivers(t.waterbodies).select("wb_id", "wb_name", "wfd_status")


@query("p7_legacy_names", ctes(["edm_returns"], RETURNS) + """
SELECT wb_id, spill_count, avg_spills, n_overflows, edm_pct FROM edm""")
def legacy_names(t: Inputs) -> DataFrame:
    old = edm_table(t).select(
        F.col("wb_id").alias("waterbody_id"), F.col("spill_count").alias("edm_total_spill_count"),
        F.col("avg_spills").alias("edm_avg_long_term_spills"), F.col("n_overflows").alias("edm_n_overflows"), "edm_pct")
    return matrix.rename_legacy(old)


@query("p11_zero_filled_features", ctes(["readings"]) + """
SELECT fww_id, COALESCE(nitrate_mid, 0) AS nitrate_mid, COALESCE(phosphate_mid, 0) AS phosphate_mid FROM readings""")
def zero_filled(t: Inputs) -> DataFrame:
    return matrix.filled_features(t.readings, ["nitrate_mid", "phosphate_mid"]).select(
        "fww_id", "nitrate_mid", "phosphate_mid")


@query("p12_s8_readings_since_cutoff", ctes(["readings"]) + """
SELECT fww_id, received_at FROM readings WHERE received_at > TIMESTAMP '1999-06-01 00:00:00'
  AND nitrate_mid IS NOT NULL AND phosphate_mid IS NOT NULL""")
def readings_since(t: Inputs) -> DataFrame:
    return build.new_readings(t.readings, "1999-06-01 00:00:00").select("fww_id", "received_at")


@query("p13_last_seven_days", ctes(["edm_live"]) + f"""
SELECT wb_id, outlet_ngr, received_at FROM edm_live WHERE received_at >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY""")
def last_seven_days(t: Inputs) -> DataFrame:
    return reports.since(t.edm_live, "received_at", AS_OF, 7).select("wb_id", "outlet_ngr", "received_at")


@query("p16_status_selection", ctes(["predictions"]) + """
SELECT predicted_status, COUNT(*) AS n FROM predictions WHERE predicted_status IN ('Good', 'Poor') GROUP BY 1""")
def status_selection(t: Inputs) -> DataFrame:
    return reports.counts_by(t.predictions.where(F.col("predicted_status").isin("Good", "Poor")), "predicted_status")


@query("p18_m16_name_search", ctes(["readings"]) + """
SELECT fww_id, site_name, county FROM readings WHERE site_name ILIKE '%SITE-77%'
ORDER BY site_name, fww_id LIMIT 10""")
def name_search(t: Inputs) -> DataFrame:
    return training.search_sites(t.readings, "SITE-77").select("fww_id", "site_name", "county")


@query("p19_predictions_by_source", ctes(["predictions"]) + """
SELECT fww_id, predicted_at, prob_poor FROM predictions WHERE data_source = 'live'""")
def by_source(t: Inputs) -> DataFrame:
    return reports.predictions_by_source(t.predictions, "live").select("fww_id", "predicted_at", "prob_poor")


# ---- scalar functions ----------------------------------------------------------------------------
DEGREES = """degrees AS (
  SELECT fww_id, -2 + (easting - 400000) / 70000 AS lon, 51.7 + (northing - 200000) / 111000 AS lat FROM readings)"""

GRID_SQL = f"""{DEGREES},
a AS (SELECT fww_id, RADIANS(lat) AS lat, RADIANS(lon) AS lon FROM degrees),
b AS (SELECT *, 6378137.0::DOUBLE / SQRT(1 - (1 - POWER(6356752.314245::DOUBLE / 6378137.0::DOUBLE, 2)) * POWER(SIN(lat), 2)) AS nu FROM a),
c AS (SELECT fww_id, nu * COS(lat) * COS(lon) AS x, nu * COS(lat) * SIN(lon) AS y,
             (1 - (1 - POWER(6356752.314245::DOUBLE / 6378137.0::DOUBLE, 2))) * nu * SIN(lat) AS z FROM b),
k AS (SELECT 1 + 20.4894e-6 AS s, RADIANS(-0.1502::DOUBLE / 3600) AS rx, RADIANS(-0.2470::DOUBLE / 3600) AS ry,
             RADIANS(-0.8421::DOUBLE / 3600) AS rz, (1 - POWER(6356256.909::DOUBLE / 6377563.396::DOUBLE, 2)) AS e2, 6377563.396::DOUBLE AS a),
d AS (SELECT fww_id, -446.448::DOUBLE + x * s - y * rz + z * ry AS x, 125.157::DOUBLE + x * rz + y * s - z * rx AS y,
             -542.060::DOUBLE - x * ry + y * rx + z * s AS z, e2, a FROM c, k),
l0 AS (SELECT *, SQRT(x * x + y * y) AS p, ATAN2(y, x) AS lon FROM d),
l1 AS (SELECT *, ATAN2(z, p * (1 - e2)) AS lat FROM l0),
l2 AS (SELECT * REPLACE (ATAN2(z + e2 * a / SQRT(1 - e2 * POWER(SIN(lat), 2)) * SIN(lat), p) AS lat) FROM l1),
l3 AS (SELECT * REPLACE (ATAN2(z + e2 * a / SQRT(1 - e2 * POWER(SIN(lat), 2)) * SIN(lat), p) AS lat) FROM l2),
l4 AS (SELECT * REPLACE (ATAN2(z + e2 * a / SQRT(1 - e2 * POWER(SIN(lat), 2)) * SIN(lat), p) AS lat) FROM l3),
l5 AS (SELECT * REPLACE (ATAN2(z + e2 * a / SQRT(1 - e2 * POWER(SIN(lat), 2)) * SIN(lat), p) AS lat) FROM l4),
m AS (SELECT fww_id, lat, lon - RADIANS(-2) AS d, TAN(lat) * TAN(lat) AS t2, lat - RADIANS(49) AS u,
             lat + RADIANS(49) AS v, (6377563.396::DOUBLE - 6356256.909::DOUBLE) / (6377563.396::DOUBLE + 6356256.909::DOUBLE) AS q,
             a * 0.9996012717::DOUBLE / SQRT(1 - e2 * POWER(SIN(lat), 2)) AS nu,
             a * 0.9996012717::DOUBLE * (1 - e2) / POWER(1 - e2 * POWER(SIN(lat), 2), 1.5) AS rho FROM l5),
g AS (SELECT *, nu / rho - 1 AS eta2, 6356256.909::DOUBLE * 0.9996012717::DOUBLE * (
               (1 + q + 1.25 * q * q + 1.25 * q * q * q) * u
               - (3 * q + 3 * q * q + 2.625 * q * q * q) * SIN(u) * COS(v)
               + (1.875 * q * q + 1.875 * q * q * q) * SIN(2 * u) * COS(2 * v)
               - 35 / 24::DOUBLE * q * q * q * SIN(3 * u) * COS(3 * v)) AS arc FROM m)
SELECT fww_id,
  ROUND(400000 + nu * COS(lat) * d + nu / 6 * POWER(COS(lat), 3) * (nu / rho - t2) * POWER(d, 3)
    + nu / 120 * POWER(COS(lat), 5) * (5 - 18 * t2 + t2 * t2 + 14 * eta2 - 58 * t2 * eta2) * POWER(d, 5), 1) AS easting,
  ROUND(arc - 100000 + nu / 2 * SIN(lat) * COS(lat) * POWER(d, 2)
    + nu / 24 * SIN(lat) * POWER(COS(lat), 3) * (5 - t2 + 9 * eta2) * POWER(d, 4)
    + nu / 720 * SIN(lat) * POWER(COS(lat), 5) * (61 - 58 * t2 + t2 * t2) * POWER(d, 6), 1) AS northing
FROM g"""


@query("f1_degrees_to_national_grid", ctes(["readings"], GRID_SQL))
def to_grid(t: Inputs) -> DataFrame:
    degrees = t.readings.select(
        "fww_id", (F.lit(-2) + (F.col("easting") - 400000) / 70000).alias("lon"),
        (F.lit(51.7) + (F.col("northing") - 200000) / 111000).alias("lat"))
    placed = grid.with_national_grid(degrees)
    return placed.select("fww_id", F.round("easting", 1).alias("easting"), F.round("northing", 1).alias("northing"))


@query("f2_f1_grid_round_trip", ctes(["readings"]) + "SELECT fww_id, easting, northing FROM readings")
def grid_round_trip(t: Inputs) -> DataFrame:
    degrees = grid.with_lon_lat(t.readings.select("fww_id", "easting", "northing")).drop("easting", "northing")
    back = grid.with_national_grid(degrees)
    return back.select("fww_id", F.round("easting", 0).alias("easting"), F.round("northing", 0).alias("northing"))


@query("f3_dates_from_text", """
SELECT o_orderkey, CASE o_orderkey % 5 WHEN 3 THEN NULL WHEN 4 THEN NULL ELSE o_orderdate END AS sample_date
FROM orders""")
def dates(t: Inputs) -> DataFrame:
    text = t.table("orders").select("o_orderkey", F.expr("""
        CASE o_orderkey % 5 WHEN 0 THEN date_format(o_orderdate, 'yyyy-MM-dd HH:mm:ss')
             WHEN 1 THEN date_format(o_orderdate, 'dd/MM/yyyy') WHEN 2 THEN date_format(o_orderdate, 'yyyy-MM-dd')
             WHEN 3 THEN 'not a date' END""").alias("text"))
    return text.select("o_orderkey", parsing.parse_date("text").cast("timestamp_ntz").alias("sample_date"))


@query("f4_f5_durations_and_numbers", ctes(["edm_returns"]) + f"""
SELECT unique_id, wb_id, {HOURS} AS spill_hrs, COALESCE(TRY_CAST(spill_count AS DOUBLE), 0) AS spill_count
FROM edm_returns""")
def durations(t: Inputs) -> DataFrame:
    clean = sewage.clean_returns(t.edm_returns, parsing.duration_hours("duration_text"))
    return clean.select("unique_id", "wb_id", "spill_hrs", "spill_count")


@query("f7_match_quality_counts", ctes(["readings", "waterbodies"], RIVERS, MATCHED) + """
SELECT match_q, COUNT(*) AS n FROM matched GROUP BY match_q""")
def match_quality_counts(t: Inputs) -> DataFrame:
    from rivermeld.catalog.joins import matched_readings

    return reports.counts_by(matched_readings(t), "match_q")


@query("f8_rate_per_pipe", ctes(["edm_returns"], RETURNS) + """
SELECT wb_id, COALESCE(spill_count / NULLIF(n_overflows % 7, 0), 0) AS rate FROM edm""")
def rate_per_pipe(t: Inputs) -> DataFrame:
    return edm_table(t).select("wb_id", rates.per_pipe("spill_count", F.col("n_overflows") % 7).alias("rate"))


RULE_SQL = """CASE WHEN COALESCE(phosphate_mid > 0.1, FALSE) THEN 'Poor' ELSE 'Moderate' END AS rule_1,
  CASE WHEN COALESCE(nitrate_mid > 2, FALSE) THEN 'Poor' ELSE 'Moderate' END AS rule_2,
  CASE WHEN COALESCE(phosphate_mid > 0.1, FALSE) OR COALESCE(nitrate_mid > 2, FALSE) THEN 'Poor' ELSE 'Moderate' END AS rule_3,
  CASE WHEN COALESCE(phosphate_mid > 0.1, FALSE) AND COALESCE(nitrate_mid > 2, FALSE) THEN 'Poor' ELSE 'Moderate' END AS rule_4"""


@query("f11_threshold_rules", ctes(["readings"]) + f"SELECT fww_id, {RULE_SQL} FROM readings")
def threshold_rules(t: Inputs) -> DataFrame:
    rules = rates.threshold_rules().values()
    return t.readings.select("fww_id", *[r.alias(f"rule_{i}") for i, r in enumerate(rules, start=1)])


@query("f12_site_titles", ctes(["readings"]) + """
SELECT fww_id, CASE WHEN LOWER(TRIM(site_name)) IN ('other', 'n/a', 'unknown', 'unnamed', '')
  THEN CASE WHEN county IS NULL OR county = '' THEN 'Unnamed site' ELSE 'Unnamed site, ' || county END
  ELSE site_name END AS title FROM readings""")
def site_titles(t: Inputs) -> DataFrame:
    return t.readings.select("fww_id", wording.site_title("site_name", "county").alias("title"))


KINDS = "(VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in LAND_WORDS.items()) + ") AS k(kind, word)"


@query("f14_land_cover_words", f"""
SELECT p.p_partkey, k.kind, r.radius,
  CASE WHEN p.p_size / 60e0 < 0.5 THEN 'No ' || k.word || ' within ' || r.radius
       ELSE printf('%.1f', p.p_size / 60e0 / 100 * (3.14159 * r.km * r.km)) || ' km² of ' || k.word || ' within ' || r.radius
  END AS text
FROM part p, {KINDS}, (VALUES ('1km', 1e0), ('5km', 5e0)) AS r(radius, km)""")
def land_cover_words(t: Inputs) -> DataFrame:
    names = F.array(*[F.struct(F.lit(kind).alias("kind"), F.lit(radius).alias("radius"))
                      for kind in LAND_WORDS for radius in ("1km", "5km")])
    shares = t.table("part").select("p_partkey", (F.col("p_size") / 60.0).alias("pct"), F.inline(names))
    feature = F.concat_ws("_", F.lit("lc"), "kind", "radius")
    return shares.select("p_partkey", "kind", "radius", wording.factor_text(feature, "pct").alias("text"))


@query("f15_level_words", ctes(["readings"]) + """,
q AS (SELECT QUANTILE_CONT(nitrate_mid, 0.25) AS p25, QUANTILE_CONT(nitrate_mid, 0.75) AS p75 FROM readings)
SELECT fww_id, CASE WHEN nitrate_mid <= p25 THEN 'low compared to other places'
  WHEN nitrate_mid >= p75 THEN 'high compared to other places' ELSE 'a typical level' END AS level
FROM readings, q WHERE nitrate_mid IS NOT NULL""")
def level_words(t: Inputs) -> DataFrame:
    values = stats.long_form(t.readings.where("nitrate_mid IS NOT NULL"), ["nitrate_mid"], ["fww_id"])
    return stats.level_of(values, stats.feature_quartiles(t.readings, ["nitrate_mid"])).select("fww_id", "level")


@query("f16_confidence_words", ctes(["predictions"]) + """
SELECT CASE WHEN GREATEST(prob_poor, prob_moderate) > 0.75 THEN 'fairly confident'
            WHEN GREATEST(prob_poor, prob_moderate) > 0.6 THEN 'reasonably confident' ELSE 'borderline' END AS confidence,
       COUNT(*) AS n FROM predictions GROUP BY 1""")
def confidence_words(t: Inputs) -> DataFrame:
    words = t.predictions.select(rates.confidence_band("prob_poor", "prob_moderate").alias("confidence"))
    return reports.counts_by(words, "confidence")


MEANING_SQL = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in STATUS_MEANING.items())


@query("f17_status_meaning", ctes(["readings"]) + f"""
SELECT fww_id, CASE fww_rating {MEANING_SQL} ELSE '' END AS meaning FROM readings""")
def status_meaning(t: Inputs) -> DataFrame:
    return t.readings.select("fww_id", wording.status_meaning("fww_rating").alias("meaning"))


@query("f18_strength_bands", """
SELECT p_partkey, CASE WHEN k < 0.2 THEN 'slight' WHEN k < 0.4 THEN 'fair' WHEN k < 0.6 THEN 'moderate'
    WHEN k < 0.8 THEN 'substantial' ELSE 'almost perfect' END AS kappa_band,
  CASE WHEN k > 0.3 THEN 'strong' WHEN k > 0.1 THEN 'weak' ELSE 'little or none' END AS corr_band,
  CASE WHEN k > 0.7 THEN 'high' ELSE 'moderate' END AS rank_band,
  CASE WHEN k - 0.5 > 0.01 THEN 'better' WHEN k - 0.5 < -0.01 THEN 'worse' ELSE 'no meaningful difference' END AS f1_band
FROM (SELECT p_partkey, p_size / 50e0 AS k FROM part)""")
def strength_bands(t: Inputs) -> DataFrame:
    k = t.table("part").select("p_partkey", (F.col("p_size") / 50.0).alias("k"))
    return k.select("p_partkey", rates.kappa_strength("k").alias("kappa_band"),
                    rates.correlation_strength("k").alias("corr_band"), rates.rank_stability("k").alias("rank_band"),
                    rates.f1_verdict(F.col("k") - 0.5).alias("f1_band"))


@query("f22_land_code_groups", ctes(["lc_cells"]) + "SELECT land_group, COUNT(*) AS n FROM (SELECT CASE " + " ".join(
    f"WHEN code IN ({', '.join(map(str, codes))}) THEN '{group}'" for group, codes in LAND_GROUPS.items())
    + " ELSE 'none' END AS land_group FROM lc_cells) GROUP BY land_group")
def land_code_groups(t: Inputs) -> DataFrame:
    name = F.lit("none")
    for group, hit in landcover.land_code_groups(t.lc_cells).items():
        name = F.when(hit, group).otherwise(name)
    return reports.counts_by(t.lc_cells.select(name.alias("land_group")), "land_group")


@query("f24_alphabetical_label_codes", ctes(["readings"]) + """
SELECT fww_id, CAST(DENSE_RANK() OVER (ORDER BY fww_rating) - 1 AS DOUBLE) AS label FROM readings""")
def label_codes(t: Inputs) -> DataFrame:
    rows = t.readings.select("fww_id", F.col("fww_rating").alias("wfd_status"))
    return label_indexer(rows).transform(rows).select("fww_id", "label")


@query("f26_long_chemistry", ctes(["readings"]) + """
SELECT fww_id, 'nitrate_mid' AS chemical, nitrate_mid AS level FROM readings
UNION ALL SELECT fww_id, 'phosphate_mid', phosphate_mid FROM readings""")
def long_chemistry(t: Inputs) -> DataFrame:
    return t.readings.unpivot(["fww_id"], ["nitrate_mid", "phosphate_mid"], "chemical", "level")


@query("f17_feature_labels", """
SELECT p_partkey, CASE p_size % 6 """ + " ".join(
    f"WHEN {i} THEN '{v}'" for i, v in enumerate(FEATURE_LABELS.values())) + " ELSE 'Farmland (5km)' END AS title FROM part")
def feature_titles(t: Inputs) -> DataFrame:
    names = [*FEATURE_LABELS, "lc_arable_5km"]
    feature = F.element_at(F.lit(names), (F.col("p_size") % 6 + 1).cast("int"))
    return t.table("part").select("p_partkey", wording.factor_title(feature).alias("title"))


# ---- readers and stores --------------------------------------------------------------------------
def _landed_csv(df: DataFrame, purpose: str) -> str:
    path = new_folder(df.sparkSession, purpose)
    df.write.option("header", True).csv(path)
    return path


def _store(t: Inputs) -> Warehouse:
    store = Warehouse(t.spark, new_folder(t.spark, "warehouse"))
    store.create_tables()
    return store


def _readings_export(t: Inputs) -> str:
    """The whole readings view written as the wide published CSV."""
    old = {new: name for name, new in files.READING_COLUMNS.items()}
    values = {
        "fww_id": F.col("fww_id"), "site_name": F.col("site_name"),
        "sample_date": F.date_format("sample_date", "yyyy-MM-dd HH:mm:ss"),
        "lon": -2 + (F.col("easting") - 400000) / 70000, "lat": 51.7 + (F.col("northing") - 200000) / 111000,
        "nitrate_mid": F.col("nitrate_mid"), "phosphate_mid": F.col("phosphate_mid"),
        "fww_rating": F.col("fww_rating"), "county": F.col("county"), "rbd": F.col("rbd"),
    }
    columns = [values.get(new, F.lit("-")).alias(name) for new, name in old.items()]
    return _landed_csv(t.readings.select(F.col("country").alias("Country"), *columns), "readings")


@query("s1_readings_csv", ctes(["readings"], DEGREES) + """
SELECT r.fww_id, r.site_name, r.sample_date, r.nitrate_mid, r.phosphate_mid, r.county,
       ROUND(d.lon, 9) AS lon, ROUND(d.lat, 9) AS lat, FALSE AS has_turbidity
FROM readings r JOIN degrees d ON r.fww_id = d.fww_id
WHERE r.country = 'England' AND r.nitrate_mid IS NOT NULL AND r.phosphate_mid IS NOT NULL""")
def readings_csv(t: Inputs) -> DataFrame:
    read = files.read_readings(t.spark, _readings_export(t))
    return read.select(
        "fww_id", "site_name", F.col("sample_date").cast("timestamp_ntz").alias("sample_date"), "nitrate_mid",
        "phosphate_mid", "county", F.round("lon", 9).alias("lon"), F.round("lat", 9).alias("lat"),
        F.col("turbidity").isNotNull().alias("has_turbidity"))


@query("s7_two_columns_of_a_wide_csv", ctes(["readings"]) + "SELECT fww_id, fww_rating FROM readings")
def two_columns(t: Inputs) -> DataFrame:
    return files.read_rating_columns(t.spark, _readings_export(t))


@query("s2_classes_csv", ctes(["waterbodies"], RIVERS) + "SELECT wb_id, wb_name, easting, northing, wfd_status FROM rivers")
def classes_csv(t: Inputs) -> DataFrame:
    raw = t.waterbodies.select(
        F.col("cycle").alias("Cycle"), F.lit("Overall Waterbody").alias("Classification Level"),
        F.col("water_body_type").alias("Water Body Type"), F.col("status").alias("Status"),
        F.col("wb_id").alias("Water Body ID"), F.col("wb_name").alias("Water Body"),
        F.col("easting").alias("Easting"), F.col("northing").alias("Northing"),
        F.lit("basin").alias("River Basin District"), F.lit("a").alias("Management Catchment"),
        F.lit("b").alias("Operational Catchment"))
    return files.read_classes(t.spark, _landed_csv(raw, "classes")).select(
        "wb_id", "wb_name", "easting", "northing", "wfd_status")


@query("s3_s4_returns_sheets", ctes(["edm_returns"], RETURNS) + """
SELECT data_year, COUNT(*) AS n, SUM(spill_count) AS spill_count, ROUND(SUM(spill_hrs), 6) AS spill_hrs,
       SUM(edm_pct) AS edm_pct FROM returns_kept GROUP BY data_year""")
def returns_sheets(t: Inputs) -> DataFrame:
    old = {new: name for name, new in files.RETURN_COLUMNS.items()}
    named = t.edm_returns.withColumn("company", F.lit("company")).select(
        "data_year", *[F.col(new).alias(old[new]) for new in old])
    paths = [_landed_csv(named.where(f"data_year = {y}").drop("data_year"), f"returns-{y}") for y in (2024, 2025)]
    read = files.read_returns(t.spark, *paths)
    return read.groupBy("data_year").agg(
        F.count("*").alias("n"), F.sum("spill_count").alias("spill_count"),
        F.round(F.sum("spill_hrs"), 6).alias("spill_hrs"), F.sum("edm_pct").alias("edm_pct"))


@query("s5_land_cells_parquet", ctes(["lc_cells"]) + "SELECT code, COUNT(*) AS n FROM lc_cells WHERE code = 20 OR code < 3 GROUP BY code")
def land_cells(t: Inputs) -> DataFrame:
    path = new_folder(t.spark, "cells")
    t.lc_cells.write.parquet(path)
    return reports.counts_by(files.read_land_cells(t.spark, path).where("code = 20 OR code < 3"), "code")


@query("s10_live_rows_by_watercourse", ctes(["monitors"]) + """
SELECT COALESCE(NULLIF(receiving_watercourse, ''), monitor_key) AS wb_id, monitor_key AS outlet_ngr, company,
       COALESCE(current_status, 'Unknown') AS status FROM monitors""")
def live_rows(t: Inputs) -> DataFrame:
    return files.live_rows(t.monitors).select("wb_id", "outlet_ngr", "company", "status")


@query("s9_landed_live_json", ctes(["monitors"]) + """
SELECT company, COUNT(*) AS n, COUNT(x) AS n_x, COUNT(current_status) AS n_status FROM monitors GROUP BY company""")
def landed_live(t: Inputs) -> DataFrame:
    path = new_folder(t.spark, "landing")
    t.monitors.withColumn("received_at", F.col("received_at").cast("timestamp")).withColumn(
        "folder", F.col("company")).write.partitionBy("folder").json(path)
    return files.read_live(t.spark, path).groupBy("company").agg(
        F.count("*").alias("n"), F.count("x").alias("n_x"), F.count("current_status").alias("n_status"))


@query("s11_s12_s17_s18_s23_stored_row_counts", ctes(["readings", "edm_live", "predictions"]) + """
SELECT table_name, CAST(n AS BIGINT) AS n FROM (
  SELECT 'staging_fww' AS table_name, (SELECT COUNT(*) FROM readings) AS n
  UNION ALL SELECT 'staging_edm_live', 2 * (SELECT COUNT(*) FROM edm_live)
  UNION ALL SELECT 'predictions', (SELECT COUNT(*) FROM predictions)
  UNION ALL SELECT 'ingestion_log', 1
  UNION ALL SELECT UNNEST(['staging_wfd', 'staging_wfd_snapshot', 'staging_edm_historical',
    'staging_edm_historical_snapshot', 'staging_lc', 'staging_lc_snapshot', 'feat_matrix', 'model_metrics']), 0)""")
def stored_counts(t: Inputs) -> DataFrame:
    store = _store(t)
    store.append("staging_fww", t.readings, as_of=AS_OF)
    store.append("staging_edm_live", t.edm_live)
    store.append("staging_edm_live", t.edm_live)
    # A batch that runs twice replaces itself.
    store.append("predictions", t.predictions, batch="first")
    store.append("predictions", t.predictions, batch="first")
    store.log_run("edm_live", 2, 1, "success", AS_OF)
    return store.row_counts()


@query("s13_s14_replace_with_snapshot", ctes(["waterbodies"], RIVERS) + """
SELECT 'now' AS part, wfd_status, COUNT(*) AS n FROM rivers WHERE wfd_status <> 'Good' GROUP BY wfd_status
UNION ALL SELECT 'before', wfd_status, COUNT(*) FROM rivers GROUP BY wfd_status""")
def replace_with_snapshot(t: Inputs) -> DataFrame:
    store = _store(t)
    store.replace("staging_wfd", matrix.classified_rivers(t.waterbodies), "2024-01-01 00:00:00")
    store.replace("staging_wfd", store.read("staging_wfd").where("wfd_status <> 'Good'"), AS_OF)
    now = reports.counts_by(store.read("staging_wfd"), "wfd_status").withColumn("part", F.lit("now"))
    before = reports.counts_by(store.read("staging_wfd_snapshot"), "wfd_status").withColumn("part", F.lit("before"))
    return now.unionByName(before)


@query("s6_s15_stored_matrix_from_legacy_names", ctes(["readings"]) + """
SELECT fww_id, CONCAT('WB', CAST(CAST(fww_id AS BIGINT) % 15 AS STRING)) AS wb_id, nitrate_mid AS avg_spills,
       phosphate_mid AS lc_arable_1km FROM readings""")
def stored_matrix(t: Inputs) -> DataFrame:
    store = _store(t)
    legacy = t.readings.selectExpr(
        "fww_id", "CONCAT('WB', CAST(CAST(fww_id AS BIGINT) % 15 AS STRING)) AS waterbody_id",
        "nitrate_mid AS edm_avg_long_term_spills", "phosphate_mid AS lc_pct_arable_1km")
    store.replace("feat_matrix", matrix.rename_legacy(legacy), AS_OF)
    return store.read("feat_matrix").select("fww_id", "wb_id", "avg_spills", "lc_arable_1km")


@query("s16_metric_rows_from_documents", """
WITH rules AS (SELECT 'Rule ' || p_brand AS model_type, CAST(NULL AS BIGINT) AS fold_id, COUNT(*) / 1000e0 AS weighted_f1,
                      MAX(p_size) / 50e0 AS poor_f1 FROM part GROUP BY p_brand),
folds AS (SELECT 'Random Forest' AS model_type, p_size AS fold_id, COUNT(*) / 1000e0 AS weighted_f1, 0.25e0 AS poor_f1
          FROM part GROUP BY p_size)
SELECT * FROM rules UNION ALL SELECT * FROM folds""")
def metric_rows(t: Inputs) -> DataFrame:
    part = t.table("part")
    rules = part.groupBy("p_brand").agg(F.count("*").alias("n"), F.max("p_size").alias("m")).agg(
        F.collect_list(F.struct(
            F.concat(F.lit("Rule "), "p_brand").alias("method"), (F.col("n") / 1000.0).alias("weighted_f1"),
            (F.col("m") / 50.0).alias("poor_f1"))).alias("traditional"))
    folds = part.groupBy("p_size").agg(F.count("*").alias("n")).agg(
        F.collect_list(F.struct(F.col("p_size").alias("fold"), (F.col("n") / 1000.0).alias("weighted_f1"))).alias("fold_results"))
    scores = F.struct(F.struct(F.lit(0.25).alias("f1-score")).alias("Poor"))
    body = F.struct("fold_results", scores.alias("classification_report"))
    result = rules.withColumn("row", F.lit(1)).join(folds.withColumn("row", F.lit(1)), "row").select(
        "traditional", F.create_map(F.lit("rf"), body, F.lit("other"), body).alias("ml_comparison"))
    path = new_folder(t.spark, "results")
    documents.write_document(result, path)
    return documents.metric_rows(documents.read_results(t.spark, path)).select(
        "model_type", "fold_id", "weighted_f1", "poor_f1")


@query("s19_csv_sink_overwrite_and_append", ctes(["readings"]) + """
SELECT fww_id, nitrate_mid, COUNT(*) AS n FROM (
  SELECT fww_id, nitrate_mid FROM readings
  UNION ALL SELECT fww_id, nitrate_mid FROM readings WHERE fww_rating = 'Poor') GROUP BY fww_id, nitrate_mid""")
def csv_sink(t: Inputs) -> DataFrame:
    path = new_folder(t.spark, "matrix-csv")
    rows = t.readings.select("fww_id", "nitrate_mid", "fww_rating")
    files.write_csv(rows, path)
    files.write_csv(rows.where("fww_rating = 'Poor'"), path, append=True)
    back = t.spark.read.schema("fww_id STRING, nitrate_mid DOUBLE, fww_rating STRING").option("header", True).csv(path)
    return back.groupBy("fww_id", "nitrate_mid").agg(F.count("*").alias("n"))


@query("s22_backup_of_all_tables", ctes(["edm_live"]) + """
SELECT 'staging_edm_live' AS table_name, COUNT(*) AS n FROM edm_live
UNION ALL SELECT 'predictions', 0""")
def backup(t: Inputs) -> DataFrame:
    store = _store(t)
    store.append("staging_edm_live", t.edm_live)
    target = store.backup("first")
    parts = [t.spark.read.schema(TABLES[name].schema).parquet(f"{target}/{name}").agg(F.count("*").alias("n")).select(
        F.lit(name).alias("table_name"), "n") for name in ("staging_edm_live", "predictions")]
    return parts[0].unionByName(parts[1])


@query("t8_retention_of_live_rows", ctes(["edm_live"]) + f"""
SELECT wb_id, COUNT(*) AS n FROM edm_live WHERE received_at >= TIMESTAMP '{AS_OF}' - INTERVAL 10 DAY GROUP BY wb_id""")
def retention(t: Inputs) -> DataFrame:
    store = _store(t)
    store.append("staging_edm_live", t.edm_live)
    return reports.counts_by(store.retain_days("staging_edm_live", AS_OF, 10), "wb_id")


@query("t8_retained_predictions", ctes(["predictions"]) + """,
l AS (SELECT fww_id, COALESCE(MAX(CASE WHEN data_source = 'live' THEN predicted_at END), MAX(predicted_at)) AS at
      FROM predictions GROUP BY fww_id)
SELECT p.fww_id, p.predicted_at, p.prob_poor FROM predictions p JOIN l ON p.fww_id = l.fww_id AND p.predicted_at = l.at""")
def retained(t: Inputs) -> DataFrame:
    return reports.retained_predictions(t.predictions).select("fww_id", "predicted_at", "prob_poor")


@query("u2_union_of_years", ctes(["edm_returns"], RETURNS) + """
SELECT data_year, COUNT(*) AS n, COUNT(DISTINCT unique_id) AS n_ids FROM returns_kept GROUP BY data_year""")
def union_of_years(t: Inputs) -> DataFrame:
    per_id = cleaned_returns(t).groupBy("data_year", "unique_id").agg(F.count("*").alias("k"))
    return per_id.groupBy("data_year").agg(F.sum("k").alias("n"), F.count("*").alias("n_ids"))
