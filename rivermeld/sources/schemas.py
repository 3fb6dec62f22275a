"""The twelve stored tables as Spark schemas, with their write modes and partition columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

from rivermeld.settings import LAND


def _schema(text: str = "", doubles: list[str] | None = None, longs: list[str] | None = None,
            times: list[str] | None = None, order: list[str] | None = None) -> T.StructType:
    kinds: dict[str, T.DataType] = {}
    kinds.update({c: T.StringType() for c in text.split()})
    kinds.update({c: T.DoubleType() for c in doubles or []})
    kinds.update({c: T.LongType() for c in longs or []})
    kinds.update({c: T.TimestampType() for c in times or []})
    names = order or list(kinds)
    return T.StructType([T.StructField(c, kinds[c]) for c in names])


@dataclass(frozen=True)
class StoredTable:
    """`mode` is append or replace; a replaced table with `history` is snapshotted first."""

    schema: T.StructType
    mode: str
    history: str | None = None
    day_of: str | None = None


def _with(schema: T.StructType, name: str) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField(name, T.TimestampType())])


_CLASSES = _schema("wb_id wb_name rbd wfd_status", ["easting", "northing"], times=["loaded_at"])
_RETURNS = _schema("wb_id outlet_ngr years",
                   ["spill_count", "spill_hrs", "avg_spills", "spills_per_pipe", "hrs_per_pipe", "edm_pct"],
                   ["n_overflows"], ["loaded_at"])
_LAND = _schema("fww_id", ["easting", "northing", *LAND], ["raster_year"], ["loaded_at"])

TABLES: dict[str, StoredTable] = {
    "staging_fww": StoredTable(_schema(
        "fww_id site_name fww_rating county rbd",
        ["lon", "lat", "easting", "northing", "nitrate_mid", "phosphate_mid", "turbidity", "ph",
         "conductivity", "dissolved_o2", "water_temp"], times=["sample_date", "received_at"]), "append"),
    "staging_wfd": StoredTable(_CLASSES, "replace", "staging_wfd_snapshot"),
    "staging_wfd_snapshot": StoredTable(_with(_CLASSES, "snapshot_at"), "append"),
    "staging_edm_historical": StoredTable(_RETURNS, "replace", "staging_edm_historical_snapshot"),
    "staging_edm_historical_snapshot": StoredTable(_with(_RETURNS, "snapshot_at"), "append"),
    "staging_edm_live": StoredTable(_schema(
        "wb_id outlet_ngr company status", ["duration_hrs"], times=["received_at"]),
        "append", day_of="received_at"),
    "staging_lc": StoredTable(_LAND, "replace", "staging_lc_snapshot"),
    "staging_lc_snapshot": StoredTable(_with(_LAND, "snapshot_at"), "append"),
    "feat_matrix": StoredTable(_schema(
        "fww_id site_name wb_id county rbd match_q wfd_status",
        ["easting", "northing", "nitrate_mid", "phosphate_mid", "spill_count", "spill_hrs", "avg_spills",
         "spills_per_pipe", "hrs_per_pipe", *LAND, "wfd_dist_m"],
        ["n_overflows"], ["sample_date", "loaded_at"]), "replace"),
    "predictions": StoredTable(_schema(
        "fww_id site_name wb_id predicted_status model_version data_source",
        ["easting", "northing", "prob_moderate", "prob_poor"], times=["predicted_at"]),
        "append", day_of="predicted_at"),
    "model_metrics": StoredTable(_schema(
        "model_type approach feature_set",
        ["weighted_f1", "mod_precision", "mod_recall", "mod_f1", "poor_precision", "poor_recall", "poor_f1"],
        ["fold_id", "n_train", "n_test"], ["recorded_at"]), "replace"),
    "ingestion_log": StoredTable(_schema(
        "source status error_msg", longs=["records_fetched", "records_new"], times=["run_at"]), "append"),
}
