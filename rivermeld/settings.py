"""Domain constants: feature groups, thresholds, class codes and wordings."""

from __future__ import annotations

# ---- fixed values: must equal the published method for results to agree -------------------------
CHEMISTRY = ["nitrate_mid", "phosphate_mid"]
SEWAGE = ["avg_spills", "n_overflows", "spills_per_pipe"]
LAND_GROUPS = {
    "woodland": [1, 2],
    "arable": [3],
    "grass": [4, 5, 6, 7],
    "wetland": [8, 11, 19],
    "urban": [20, 21],
    "water": [14],
}
RADII = {"1km": 1000, "5km": 5000}
STATUS_TO_LABEL = {
    "High": "Good",
    "Good": "Good",
    "Moderate": "Moderate",
    "Poor": "Poor",
    "Bad": "Poor",
}
PHOSPHATE_LIMIT = 0.1
NITRATE_LIMIT = 2.0
GOOD_MATCH_M = 1000
ACCEPTABLE_MATCH_M = 5000
FOLDS = 5
SEED = 42
TREES = 200
LEGACY_NAMES = {
    "edm_total_spill_count": "spill_count",
    "edm_total_duration_hours": "spill_hrs",
    "edm_avg_long_term_spills": "avg_spills",
    "edm_n_overflows": "n_overflows",
    "lc_pct_woodland_1km": "lc_woodland_1km",
    "lc_pct_arable_1km": "lc_arable_1km",
    "lc_pct_grassland_1km": "lc_grass_1km",
    "lc_pct_wetland_1km": "lc_wetland_1km",
    "lc_pct_urban_1km": "lc_urban_1km",
    "lc_pct_freshwater_1km": "lc_water_1km",
    "lc_pct_woodland_5km": "lc_woodland_5km",
    "lc_pct_arable_5km": "lc_arable_5km",
    "lc_pct_grassland_5km": "lc_grass_5km",
    "lc_pct_wetland_5km": "lc_wetland_5km",
    "lc_pct_urban_5km": "lc_urban_5km",
    "lc_pct_freshwater_5km": "lc_water_5km",
    "waterbody_id": "wb_id",
    "nearest_wfd_dist_m": "wfd_dist_m",
    "wfd_match_quality": "match_q",
    "river_basin_district": "rbd",
}
PLACEHOLDER_NAMES = ["other", "n/a", "unknown", "unnamed", ""]
FEATURE_LABELS = {
    "nitrate_mid": "Nitrate level",
    "phosphate_mid": "Phosphate level",
    "spills_per_pipe": "Spills per outlet",
    "avg_spills": "Mean spills a year",
    "n_overflows": "Overflows on this water",
}
STATUS_MEANING = {
    "Good": "Plants and animals do well in this water.",
    "Moderate": "Some pollution shows, and some species are fewer than they would be.",
    "Poor": "Pollution is heavy, and few plants and animals cope with it.",
}
LAND_WORDS = {
    "woodland": "woodland",
    "arable": "farmland",
    "grass": "grassland",
    "wetland": "wetland",
    "urban": "built-up area",
    "water": "open water",
}
RUN_MARKS = {"success": "✅", "no_new_data": "⏸️", "failed": "❌", "skipped": "⏭️"}
OTHER_RUN_MARK = "⚠️"
CIRCLE_CONSTANT = 3.14159
# ---- end of fixed values -------------------------------------------------------------------------

LAND = [f"lc_{group}_{radius}" for radius in RADII for group in LAND_GROUPS]
FEATURES = CHEMISTRY + SEWAGE + LAND
ABLATION = {
    "ablation_chemistry": CHEMISTRY,
    "ablation_chem_sewage": CHEMISTRY + SEWAGE,
    "ablation_full": FEATURES,
}
LABELS = ["Good", "Moderate", "Poor"]
MATRIX_COLUMNS = (
    ["fww_id", "site_name", "sample_date", "easting", "northing", "wb_id"]
    + CHEMISTRY
    + ["spill_count", "spill_hrs", "avg_spills", "n_overflows", "spills_per_pipe", "hrs_per_pipe"]
    + LAND
    + ["county", "rbd", "wfd_dist_m", "match_q", "wfd_status"]
)
