from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from rivermeld.operators import learning
from rivermeld.operators.nearest import index_places
from rivermeld.plans import live
from rivermeld.sources.store import Warehouse
from rivermeld.streaming import live as streams

NAMES = ["n_overflows", "spills_per_pipe"]


@pytest.fixture
def store(spark, tmp_path):
    made = Warehouse(spark, str(tmp_path / "warehouse"))
    rows = [(str(i), f"WB{i % 4}", float(i % 4) * 20000, 0.0, i % 5, float(i % 7), "Poor" if i % 3 else "Moderate") for i in range(40)]
    made.replace("feat_matrix", spark.createDataFrame(
        rows, "fww_id STRING, wb_id STRING, easting DOUBLE, northing DOUBLE, n_overflows INT, spills_per_pipe DOUBLE, wfd_status STRING"),
        "2024-01-01 00:00:00")
    return made


@pytest.fixture
def model(store):
    return learning.train_final(store.read("feat_matrix"), NAMES, "rf", numTrees=3, maxDepth=3, minInstancesPerNode=1)


def test_refresh_scores_touched_sites_and_empty_runs_keep_the_cutoff(store, spark, model):
    assert live.refresh(store, model, "2024-01-10 00:00:00", names=NAMES) == "no_new_data"
    feed = [("WB1", "o1", "Discharging", datetime(2024, 1, 9)), ("WB1", "o2", "Offline", datetime(2024, 1, 9)), (None, "o3", "Discharging", datetime(2024, 1, 9))]
    store.append("staging_edm_live", spark.createDataFrame(feed, "wb_id STRING, outlet_ngr STRING, status STRING, received_at TIMESTAMP"))
    assert live.refresh(store, model, "2024-01-11 00:00:00", names=NAMES) == "success"
    assert store.read("predictions").count() == 10
    assert {r["wb_id"] for r in store.read("predictions").select("wb_id").distinct().collect()} == {"WB1"}
    assert live.refresh(store, model, "2024-01-12 00:00:00", names=NAMES) == "no_new_data"
    statuses = [r["status"] for r in store.read("ingestion_log").orderBy("run_at").collect()]
    assert statuses == ["no_new_data", "success", "no_new_data"]


def test_stream_matches_scores_and_survives_replay(store, spark, model, tmp_path):
    folder = tmp_path / "landing" / "company=x"
    at = datetime(2024, 2, 1)
    rows = [("x", "m1", "site 1", 20010.0, 5.0, "Discharging", None, at), ("x", "m2", None, 0.0, 5.0, None, None, at),
            ("x", "m3", None, 500000.0, 5.0, "Offline", None, at)]
    spark.createDataFrame(rows, "company STRING, monitor_key STRING, site_name STRING, x DOUBLE, y DOUBLE, current_status STRING, receiving_watercourse STRING, received_at TIMESTAMP").write.json(str(folder))
    index = index_places(store.read("feat_matrix").select("wb_id", "easting", "northing").distinct(), "wb_id")
    for attempt in ("c1", "c2"):
        feed = streams.feed_stream(spark, str(tmp_path / "landing"))
        streams.ingest(feed, index, store, str(tmp_path / attempt), model, NAMES).awaitTermination()
    got = {(r["outlet_ngr"], r["wb_id"], r["status"]) for r in store.read("staging_edm_live").collect()}
    assert got == {("site 1", "WB1", "Discharging"), ("m2", None, "Unknown"), ("m3", None, "Offline")}
    assert store.read("staging_edm_live").count() == 3
    assert store.read("predictions").count() == 10
    assert store.read("predictions").select("data_source").distinct().first()[0] == "live"


def test_repeats_and_late_rows_leave_the_stream(spark, tmp_path):
    start = datetime(2024, 1, 1)
    first = [("x", "o1", start + timedelta(hours=h)) for h in (0, 1, 1, 30)]
    second = [("x", "o1", start + timedelta(hours=1)), ("x", "o1", start + timedelta(hours=31)), ("x", "o1", start + timedelta(hours=30))]
    schema = "company STRING, outlet_ngr STRING, received_at TIMESTAMP"
    landing = str(tmp_path / "landing")
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    for part in (first, second):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(landing)
        feed = streams.without_repeats(streams.feed_stream(spark, landing, schema, "parquet"))
        streams.write_stream(feed, out, checkpoint).awaitTermination()
    hours = sorted(int((r["received_at"] - start).total_seconds() // 3600) for r in spark.read.parquet(out).collect())
    assert hours == [0, 1, 30, 31]


def test_touched_includes_the_cutoff_itself(spark):
    feed = spark.createDataFrame([("a", datetime(2024, 1, 2)), ("b", datetime(2024, 1, 1)), (None, datetime(2024, 1, 3))], "wb_id STRING, received_at TIMESTAMP")
    assert [r[0] for r in live.touched_waterbodies(feed, "2024-01-02 00:00:00").collect()] == ["a"]


def test_latest_slices(spark):
    readings = spark.createDataFrame([("1", "s", 1.0, 1.0, 1.0, 1.0, "k", "r", datetime(2024, 1, 30)), ("2", "s", 1.0, 1.0, 1.0, 1.0, "k", "r", datetime(2024, 1, 1))],
                                     "fww_id STRING, site_name STRING, easting DOUBLE, northing DOUBLE, nitrate_mid DOUBLE, phosphate_mid DOUBLE, county STRING, rbd STRING, received_at TIMESTAMP")
    feed = spark.createDataFrame([("a", 1.5, datetime(2024, 1, 30, 12)), ("a", 1.0, datetime(2024, 1, 29))], "wb_id STRING, duration_hrs DOUBLE, received_at TIMESTAMP")
    land = spark.createDataFrame([("1",)], "fww_id STRING")
    from rivermeld.settings import LAND
    land = land.withColumns({c: F.lit(1.0) for c in LAND})
    week, totals, cover = live.latest_slices(readings, feed, land, "2024-01-31 00:00:00")
    assert week.count() == 1 and cover.count() == 1
    assert [tuple(r) for r in totals.collect()] == [("a", 1.5, 1)]
