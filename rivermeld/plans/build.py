"""Feature-matrix jobs: full build and incremental append."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivermeld.operators.landcover import land_shares
from rivermeld.operators.matrix import (
    attach_land_cover, build_matrix, match_waterbodies, split_land_cover,
)
from rivermeld.operators.sewage import attach_returns
from rivermeld.plans.reports import last_success
from rivermeld.session import written
from rivermeld.settings import CHEMISTRY, LAND
from rivermeld.sources.store import Warehouse


def full_build(readings: DataFrame, rivers: DataFrame, returns: DataFrame, cells: DataFrame | None = None,
               stored_land: DataFrame | None = None) -> DataFrame:
    """Match, add sewage, add land cover (stored where known, else computed from cells), keep valid rows.

    Rows that cannot enter the matrix leave before the joins that widen them.
    """
    matched = match_waterbodies(readings, rivers).where(F.col("match_q") != "poor")
    joined = attach_returns(matched, returns)
    if stored_land is not None and cells is not None:
        known, lacking = split_land_cover(joined, stored_land)
        fresh = land_shares(lacking.select("fww_id", "easting", "northing"), cells)
        joined = attach_land_cover(known, stored_land).unionByName(attach_land_cover(lacking, fresh))
    elif stored_land is not None:
        joined = attach_land_cover(joined, stored_land)
    elif cells is not None:
        joined = attach_land_cover(joined, land_shares(joined.select("fww_id", "easting", "northing"), cells))
    return build_matrix(joined)


def new_readings(readings: DataFrame, since: str | None) -> DataFrame:
    """Readings with chemistry received after `since` (exclusive); all of them when there is no cutoff."""
    rows = readings.na.drop(subset=CHEMISTRY)
    if since is None:
        return rows
    kind = readings.schema["received_at"].dataType.simpleString()
    return rows.where(F.col("received_at") > F.lit(since).cast(kind))


def rebuild(store: Warehouse, as_of: str, cells: DataFrame | None = None) -> DataFrame:
    """Full rebuild of the stored matrix from the staging tables."""
    stored = store.read("staging_lc")
    stored_land = stored.select("fww_id", *LAND) if store.exists("staging_lc") else None
    built = full_build(store.read("staging_fww").na.drop(subset=CHEMISTRY), store.read("staging_wfd"),
                       store.read("staging_edm_historical"), cells, stored_land)
    store.replace("feat_matrix", built, as_of)
    rows = store.read("feat_matrix")
    count = rows.count()
    store.log_run("feature_engineering", count, count, "success", as_of)
    return rows


def late_readings(readings: DataFrame, matrix: DataFrame, since: str, days: int | None = None) -> DataFrame:
    """Readings with chemistry up to the cutoff, or of the last `days` before it, that are not in the matrix: stored after it was drawn."""
    rows = readings.na.drop(subset=CHEMISTRY)
    cutoff = F.lit(since).cast("timestamp")
    at = F.col("received_at").cast("timestamp")
    if days is None:  # a reading without a time can only be found here
        window = rows.where((at <= cutoff) | at.isNull())
    else:
        window = rows.where((at <= cutoff) & (at > cutoff - F.make_dt_interval(F.lit(days))))
    return window.join(matrix.select("fww_id"), "fww_id", "left_anti").select(*rows.columns)


def append_new(store: Warehouse, as_of: str, cells: DataFrame | None = None, since: str | None = None,
               late_days: int | None = None) -> int:
    """Add readings received since the last successful run; a full rebuild when there was none.

    Rows that were stored late are added too, however late; `late_days` limits that to so many days before the cutoff.
    """
    if since is None:
        since = last_success(store.read("ingestion_log"), "feature_engineering").first()["last_run"]
        if since is None:
            return rebuild(store, as_of, cells).count()
    readings = store.read("staging_fww")
    fresh = written(new_readings(readings, str(since)).unionByName(
        late_readings(readings, store.read("feat_matrix"), str(since), late_days)), "new-readings")
    if fresh.isEmpty():
        store.log_run("feature_engineering", 0, 0, "success", as_of)
        return 0
    stored = store.read("staging_lc")
    stored_land = stored.select("fww_id", *LAND) if store.exists("staging_lc") else None
    built = full_build(fresh, store.read("staging_wfd"), store.read("staging_edm_historical"), cells, stored_land)
    added = store.extend("feat_matrix", built, as_of)
    store.log_run("feature_engineering", added, added, "success", as_of)
    return added
