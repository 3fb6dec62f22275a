"""Batch form of the live refresh: find touched waterbodies, recompute, rescore, log."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivermeld.operators.keyed import distinct_tuples
from rivermeld.operators.learning import prediction_rows, score
from rivermeld.operators.sewage import live_per_waterbody, live_totals, overwrite_with_live
from rivermeld.plans.reports import last_success, since
from rivermeld.plans.rolling import WINDOW_DAYS
from rivermeld.settings import CHEMISTRY, FEATURES, LAND
from rivermeld.sources.store import Warehouse

FIRST_CUTOFF = "2000-01-01 00:00:00"
JOB = "live_inference"


def touched_waterbodies(feed: DataFrame, cutoff: str) -> DataFrame:
    """Waterbodies with feed rows at or after the cutoff."""
    kind = feed.schema["received_at"].dataType.simpleString()
    fresh = feed.where((F.col("received_at") >= F.lit(cutoff).cast(kind)) & F.col("wb_id").isNotNull())
    return distinct_tuples(fresh, ["wb_id"])


def rolling_features(feed: DataFrame, touched: DataFrame, as_of: str, days: int = WINDOW_DAYS,
                     compat: bool = False) -> DataFrame:
    """Live sewage features of the touched waterbodies over the rolling window."""
    recent = since(feed, "received_at", as_of, days)
    return live_per_waterbody(recent.join(touched, "wb_id", "left_semi"), compat)


def rescored(matrix: DataFrame, touched: DataFrame, features: DataFrame, model: PipelineModel,
             names: list[str] | None = None) -> DataFrame:
    """Matrix rows of touched waterbodies with live sewage values and fresh scores."""
    points = matrix.join(touched, "wb_id", "left_semi")
    return score(model, overwrite_with_live(points, features), names or FEATURES)


def latest_slices(readings: DataFrame, feed: DataFrame, land: DataFrame, as_of: str) -> tuple[DataFrame, ...]:
    """Inputs of a live build: readings of seven days, feed totals of one day, current land cover."""
    columns = ["fww_id", "site_name", "easting", "northing", *CHEMISTRY, "county", "rbd"]
    week = since(readings, "received_at", as_of, 7).select(*columns)
    return week, live_totals(since(feed, "received_at", as_of, 1)), land.select("fww_id", *LAND)


def refresh(store: Warehouse, model: PipelineModel, as_of: str, batch: str | None = None,
            touched: DataFrame | None = None, names: list[str] | None = None, features: DataFrame | None = None) -> str:
    """One live run; returns the logged status.

    Only a run that scored rows moves the cutoff. With `batch`, rerunning the batch replaces its own rows. `features` of the touched
    waterbodies may come from a kept state (`rolling`); else the days of the window are read.
    """
    day = date.fromisoformat(as_of[:10])
    feed = store.read_days("staging_edm_live", str(day - timedelta(days=WINDOW_DAYS + 1)), str(day + timedelta(days=1)))
    if touched is None:
        last = last_success(store.read("ingestion_log"), JOB, moved_rows=True).first()["last_run"]
        touched = touched_waterbodies(feed, str(last) if last else FIRST_CUTOFF)
    entry = f"{JOB}-{batch}" if batch else None
    touched = touched.persist()
    try:
        n_touched = touched.count()
        if n_touched == 0:
            store.log_run(JOB, 0, 0, "no_new_data", as_of, batch=entry)
            return "no_new_data"
        if features is None:
            features = rolling_features(feed, touched, as_of, WINDOW_DAYS)
        if features.isEmpty():
            store.log_run(JOB, n_touched, 0, "skipped", as_of, batch=entry)
            return "skipped"
        scored = rescored(store.read("feat_matrix"), touched, features, model, names)
        rows = prediction_rows(scored, "rf_model_live", "live", as_of)
        name = batch or f"live-{as_of}".replace(" ", "T").replace(":", "")
        store.append("predictions", rows, batch=name)
        n = store.batch_rows("predictions", name)
        store.log_run(JOB, n if n else n_touched, n, "success", as_of, batch=entry)
        return "success"
    finally:
        touched.unpersist()
