"""Feature-matrix building: matching, joining, selecting and checking rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivermeld.functions.rates import match_quality, three_class_label
from rivermeld.operators.keyed import first_per_key
from rivermeld.operators.nearest import nearest_join
from rivermeld.settings import (
    ACCEPTABLE_MATCH_M, CHEMISTRY, LAND, LEGACY_NAMES, MATRIX_COLUMNS, SEWAGE, STATUS_TO_LABEL,
)


def usable_readings(readings: DataFrame, country: str = "England",
                    position: tuple[str, str] = ("easting", "northing")) -> DataFrame:
    """Readings of one country with a position and both chemistry values."""
    return readings.where(F.col("country") == country).na.drop(subset=[*position, *CHEMISTRY])


def classified_rivers(classes: DataFrame) -> DataFrame:
    """Current-cycle rivers with a known status, one row per waterbody, with the three-class label."""
    chosen = classes.where(
        (F.col("cycle") == 3) & (F.col("water_body_type") == "River")
        & F.col("status").isin(list(STATUS_TO_LABEL)))
    if "classification_level" in classes.columns:
        chosen = chosen.where(F.col("classification_level") == "Overall Waterbody")
    labelled = chosen.withColumn("wfd_status", three_class_label("status"))
    return first_per_key(labelled, ["wb_id"], ["wb_name"])


def match_waterbodies(readings: DataFrame, rivers: DataFrame,
                      max_dist: float | None = ACCEPTABLE_MATCH_M) -> DataFrame:
    """Nearest river per reading with label, distance and match quality.

    With the default bound, readings farther than an acceptable match have no river and quality 'poor'.
    """
    matched = nearest_join(readings, rivers, place_id="wb_id", carry=["wb_name", "wfd_status"],
                           max_dist=max_dist, distance="wfd_dist_m")
    return matched.withColumn("match_q", match_quality("wfd_dist_m"))


def rename_legacy(df: DataFrame) -> DataFrame:
    """Current names for old long column names; absent names are ignored."""
    return df.withColumnsRenamed(LEGACY_NAMES)


def build_matrix(joined: DataFrame) -> DataFrame:
    """Canonical columns of valid rows: labelled, acceptably matched, with chemistry."""
    kept = joined.select(*[c for c in MATRIX_COLUMNS if c in joined.columns])
    valid = kept.where(F.col("wfd_status").isNotNull() & (F.col("match_q") != "poor"))
    return valid.na.drop(subset=CHEMISTRY).na.fill({"county": "Unknown", "rbd": "Unknown"})


def split_land_cover(readings: DataFrame, stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Readings that have stored land cover and those that lack it, compared as text ids."""
    ids = stored.select(F.col("fww_id").cast("string").alias("fww_id")).distinct()
    texted = readings.withColumn("fww_id", F.col("fww_id").cast("string"))
    return texted.join(ids, "fww_id", "left_semi"), texted.join(ids, "fww_id", "left_anti")


def attach_land_cover(readings: DataFrame, land: DataFrame) -> DataFrame:
    return readings.join(land.select("fww_id", *LAND), "fww_id", "left")


def feature_groups(features: list[str]) -> dict[str, list[str]]:
    """Features by data source; 'unassigned' lists what fits none."""
    groups = {
        "chemistry": [f for f in features if f in CHEMISTRY],
        "sewage": [f for f in features if f in SEWAGE],
        "land": [f for f in features if f.startswith("lc_")],
    }
    known = {f for group in groups.values() for f in group}
    groups["unassigned"] = [f for f in features if f not in known]
    return groups


def filled_features(df: DataFrame, features: list[str]) -> DataFrame:
    """Zeros for missing numeric features; features that are not there at all are an error."""
    missing = [f for f in features if f not in df.columns]
    if missing:
        raise ValueError(f"missing features: {missing}")
    return df.withColumns({f: F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features})
