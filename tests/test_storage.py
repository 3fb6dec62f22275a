import pytest

from rivermeld.operators.sewage import attach_returns, live_per_waterbody, overwrite_with_live, returns_per_waterbody
from rivermeld.plans import reports
from rivermeld.sources import files
from rivermeld.sources.schemas import TABLES
from rivermeld.sources.store import Warehouse

AS_OF = "2024-01-31 00:00:00"


@pytest.fixture
def store(spark, tmp_path):
    made = Warehouse(spark, str(tmp_path / "warehouse"))
    made.create_tables()
    made.create_tables()
    return made


def rivers(spark, *names):
    return spark.createDataFrame([(n, "Poor") for n in names], "wb_id STRING, wfd_status STRING")


def test_empty_tables_count_zero(store):
    counts = {r["table_name"]: r["n"] for r in store.row_counts().collect()}
    assert set(counts) == set(TABLES) and set(counts.values()) == {0} and len(counts) == 12


def test_replace_from_itself_keeps_history_by_name(store, spark):
    store.replace("staging_wfd", rivers(spark, "a", "b"), "2024-01-01 00:00:00")
    assert not store.exists("staging_wfd_snapshot")
    store.replace("staging_wfd", store.read("staging_wfd").where("wb_id = 'a'"), AS_OF)
    assert [r["wb_id"] for r in store.read("staging_wfd").collect()] == ["a"]
    old = store.read("staging_wfd_snapshot").collect()
    assert sorted(r["wb_id"] for r in old) == ["a", "b"]
    assert {str(r["snapshot_at"]) for r in old} == {AS_OF}


def test_a_batch_replayed_replaces_itself(store, spark):
    rows = spark.createDataFrame([("1", "Poor", "2024-01-02 00:00:00")], "fww_id STRING, predicted_status STRING, predicted_at STRING")
    store.append("predictions", rows, batch="b1")
    store.append("predictions", rows, batch="b1")
    store.append("predictions", rows, batch="b2")
    assert store.read("predictions").count() == 2 and store.batch_rows("predictions", "b1") == 1


def test_unfinished_batches_are_not_read(store, spark, tmp_path):
    store.append("ingestion_log", rivers(spark, "a").selectExpr("wb_id AS source"), batch="good")
    half = tmp_path / "warehouse" / "ingestion_log" / "batch=half"
    half.mkdir(parents=True)
    (half / "part-0.parquet").write_bytes(b"broken")
    assert store.read("ingestion_log").count() == 1


def test_days_prune_the_scan(store, spark):
    rows = spark.createDataFrame([("a", "2024-01-01 10:00:00"), ("a", "2024-01-05 10:00:00")], "wb_id STRING, received_at STRING")
    store.append("staging_edm_live", rows)
    some = store.read_days("staging_edm_live", "2024-01-04", "2024-01-31")
    assert some.count() == 1
    assert "PartitionFilters: [isnotnull(day" in some._jdf.queryExecution().executedPlan().toString()
    assert store.retain_days("staging_edm_live", AS_OF, 28).count() == 1


def test_last_success_needs_moved_rows(store):
    store.log_run("live_inference", 5, 5, "success", "2024-01-01 00:00:00")
    store.log_run("live_inference", 0, 0, "success", "2024-01-02 00:00:00")
    store.log_run("live_inference", 0, 0, "no_new_data", "2024-01-03 00:00:00")
    log = store.read("ingestion_log")
    assert str(reports.last_success(log, "live_inference").first()[0]) == "2024-01-02 00:00:00"
    assert str(reports.last_success(log, "live_inference", moved_rows=True).first()[0]) == "2024-01-01 00:00:00"


def sheet(path, lines):
    path.mkdir(parents=True, exist_ok=True)
    (path / "sheet.csv").write_text("\n".join(lines) + "\n", encoding="utf-8")
    return str(path)


HEADER = ('"Unique\nID",Water Company Name,WFD Waterbody ID (Cycle 3) (discharge outlet),'
          'Outlet Discharge NGR (EA Consents Database),Counted spills using 12-24h count method,'
          '"Long-term\naverage spill count",EDM Operation - % of reporting period EDM operational,'
          'Total Duration (hh:mm:ss) all spills prior to processing through 12-24h count method')


def test_returns_with_offset_headers_summaries_and_repeats(spark, tmp_path):
    old = sheet(tmp_path / "y24", ["Title,,", HEADER, "u1,Co,WB1,O1,4,2,99,31:30:00", "u2,Co,WB1,O2,n/a,4,bad,",
                                   "u1,Co,WB1,O1,1,2,97,01:00:00"])
    body = [f"n{i},Co,WB2,O{i},{i},1,100,1 days 00:00:00" for i in range(6)]
    new = sheet(tmp_path / "y25a", ["Some company,,", "report,,", HEADER, *body, "n0,Co,WB2,O0,0,1,100,1 days 00:00:00"])
    small = sheet(tmp_path / "y25b", ["t,,", HEADER, "s1,Co,WB9,O1,1,1,1,01:00:00"])
    rows = files.read_returns(spark, old, [new, small])
    assert rows.where("data_year = 2024").count() == 3
    assert rows.where("data_year = 2025").count() == 6
    per = {r["wb_id"]: r for r in returns_per_waterbody(rows).collect()}
    assert set(per) == {"WB1", "WB2"}
    one = per["WB1"]
    assert (one["spill_count"], one["spill_hrs"], one["n_overflows"], one["n_outlets"], one["years"]) == (5.0, 32.5, 3, 2, "2024")
    assert (one["avg_spills"], one["edm_pct"]) == ((2 + 4 + 2) / 3, 98.0)
    assert per["WB2"]["spill_hrs"] == 144.0


def test_readings_export_is_cleaned(spark, tmp_path):
    names = ["Country", *files.READING_COLUMNS]
    good = ["England", "7", "Mill", "2024-01-02", "-0.1276", "51.5072", "1.5", "0.2", "", "7", "", "", "", "Good", "Kent", "Thames"]
    lines = [",".join(names), ",".join(good)]
    for change in ({0: "Wales"}, {4: ""}, {6: ""}):
        row = list(good)
        for at, value in change.items():
            row[at] = value
        lines.append(",".join(row))
    bad_date = list(good)
    bad_date[3] = "soon"
    lines.append(",".join(bad_date))
    path = sheet(tmp_path / "readings", lines)
    rows = files.read_readings(spark, path).collect()
    assert [str(r["sample_date"]) for r in rows] == ["2024-01-02 00:00:00", "None"]
    assert abs(rows[0]["easting"] - 530043) < 5 and abs(rows[0]["northing"] - 180358) < 5


def test_sewage_join_fills_zeros_and_live_overwrites(spark):
    readings = spark.createDataFrame([("1", "WB1"), ("2", "WB9")], "fww_id STRING, wb_id STRING")
    per = spark.createDataFrame([("WB1", 10.0, 4.0, 3.0, 4, 99.0)], "wb_id STRING, spill_count DOUBLE, spill_hrs DOUBLE, avg_spills DOUBLE, n_overflows BIGINT, edm_pct DOUBLE")
    got = {r["fww_id"]: r for r in attach_returns(readings, per).collect()}
    assert (got["1"]["spills_per_pipe"], got["1"]["hrs_per_pipe"]) == (2.5, 1.0)
    assert (got["2"]["spills_per_pipe"], got["2"]["n_overflows"]) == (0.0, 0)
    feed = spark.createDataFrame([("WB1", "o1", "Discharging"), ("WB1", "o1", "discharging"), ("WB1", "o2", "Offline"), (None, "o3", "Discharging")],
                                 "wb_id STRING, outlet_ngr STRING, status STRING")
    live = live_per_waterbody(feed)
    points = spark.createDataFrame([("1", "WB1", 9, 7.0), ("2", "WB9", 9, 7.0)], "fww_id STRING, wb_id STRING, n_overflows BIGINT, spills_per_pipe DOUBLE")
    fresh = {r["fww_id"]: (r["n_overflows"], r["spills_per_pipe"]) for r in overwrite_with_live(points, live).collect()}
    assert fresh == {"1": (2, 1.0), "2": (9, 0.0)}


def test_county_needs_thirty_rows(spark):
    rows = [(str(i), "k30" if i < 30 else "k29", "Poor" if i % 2 else "Moderate") for i in range(59)]
    predictions = spark.createDataFrame(rows, "fww_id STRING, county STRING, predicted_status STRING").selectExpr(
        "fww_id", "predicted_status", "TIMESTAMP '2024-01-01 00:00:00' AS predicted_at")
    matrix = spark.createDataFrame(rows, "fww_id STRING, county STRING, predicted_status STRING").select("fww_id", "county")
    got = reports.county_summary(predictions, matrix).collect()
    assert [(r["county"], r["n"], r["pct_poor"]) for r in got] == [("k30", 30, 50.0)]
