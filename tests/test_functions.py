import math
from datetime import datetime

from pyspark.sql import functions as F

from rivermeld.functions import grid, parsing, rates, wording
from rivermeld.operators.matrix import feature_groups
from rivermeld.settings import FEATURES


def one(df):
    return [tuple(r) for r in df.collect()]


def test_published_grid_example(spark):
    lat = math.radians(52 + 39 / 60 + 27.2531 / 3600)
    lon = math.radians(1 + 43 / 60 + 4.5177 / 3600)
    east, north = one(grid.airy_to_grid(spark.createDataFrame([(lat, lon)], ["_lat", "_lon"])).select(
        "easting", "northing"))[0]
    assert abs(east - 651409.903) < 0.001 and abs(north - 313177.270) < 0.001
    back = grid.grid_to_airy(spark.createDataFrame([(651409.903, 313177.270)], ["easting", "northing"]))
    got = one(back.select("_lat", "_lon"))[0]
    assert abs(got[0] - lat) < 1e-9 and abs(got[1] - lon) < 1e-9


def test_grid_round_trip_and_nulls(spark):
    df = spark.createDataFrame([(-0.1276, 51.5072), (-5.5, 50.1), (None, 51.0)], ["lon", "lat"])
    placed = grid.with_national_grid(df)
    back = grid.with_lon_lat(placed.select("easting", "northing")).select("lon", "lat")
    rows = one(back)
    assert abs(rows[0][0] + 0.1276) < 1e-6 and abs(rows[1][1] - 50.1) < 1e-6 and rows[2] == (None, None)


def test_dates_durations_and_numbers(spark):
    df = spark.createDataFrame(
        [("31:30:00", "5", "2024-01-02"), ("1 days 02:00:00", "n/a", "03/02/2024"), ("2 day, 01:00:30", None, "zz"),
         ("bad", "1.5", "2024-01-02T03:04:05"), (None, " 7 ", None)], "d STRING, n STRING, t STRING")
    got = one(df.select(parsing.duration_hours("d"), parsing.number_or_zero("n"), parsing.parse_date("t")))
    assert [g[0] for g in got] == [31.5, 26.0, 49 + 30 / 3600, None, None]
    assert [g[1] for g in got] == [5.0, 0.0, 0.0, 1.5, 7.0]
    assert [g[2] for g in got] == [datetime(2024, 1, 2), datetime(2024, 2, 3), None, datetime(2024, 1, 2, 3, 4, 5), None]


def test_header_names_are_cleaned(spark):
    df = spark.createDataFrame([(1, 2)], [" Unique\nID ", "Plain"])
    assert parsing.clean_names(df).columns == ["Unique ID", "Plain"]


def test_match_bands_include_their_limits(spark):
    df = spark.createDataFrame([(1000.0,), (1000.1,), (5000.0,), (5000.1,), (None,)], "d DOUBLE")
    assert [r[0] for r in one(df.select(rates.match_quality("d")))] == ["good", "acceptable", "acceptable", "poor", "poor"]


def test_rates_without_pipes(spark):
    df = spark.createDataFrame([(10.0, 0), (10.0, 4), (10.0, None)], "x DOUBLE, n INT")
    assert one(df.select(rates.per_pipe("x", "n"))) == [(0.0,), (2.5,), (0.0,)]
    live = spark.createDataFrame([(10, 0), (10, 4)], "x INT, n INT")
    assert one(live.select(rates.per_pipe_live("x", "n"))) == [(10.0,), (2.5,)]


def test_discharging_status_and_compat(spark):
    names = ["Discharging", " DISCHARGING ", "Not Discharging", "Recent Discharge", None]
    df = spark.createDataFrame([(n,) for n in names], "s STRING")
    assert [r[0] for r in one(df.select(rates.is_discharging("s")))] == [True, True, False, False, False]
    assert [r[0] for r in one(df.select(rates.is_discharging("s", compat=True)))] == [False, False, False, True, False]


def test_rules_take_missing_readings_as_below(spark):
    df = spark.createDataFrame([(0.2, None), (None, 3.0), (0.1, 2.0), (0.2, 3.0)], "phosphate_mid DOUBLE, nitrate_mid DOUBLE")
    got = one(df.select(*rates.threshold_rules().values()))
    poor = [[v == "Poor" for v in row] for row in got]
    assert poor == [[True, False, True, False], [False, True, True, False], [False] * 4, [True] * 4]


def test_levels_prefer_low_when_quartiles_meet(spark):
    df = spark.createDataFrame([(1.0, 1.0, 1.0), (2.0, 1.0, 2.0), (1.5, 1.0, 2.0), (1.0, None, None)], "v DOUBLE, a DOUBLE, b DOUBLE")
    got = [r[0] for r in one(df.select(rates.level_band("v", "a", "b")))]
    assert got == ["low compared to other places", "high compared to other places", "a typical level", ""]


def test_bands(spark):
    df = spark.createDataFrame([(0.75, 0.2), (0.76, 0.2), (0.5, 0.61)], "a DOUBLE, b DOUBLE")
    assert [r[0] for r in one(df.select(rates.confidence_band("a", "b")))] == [
        "reasonably confident", "fairly confident", "reasonably confident"]
    verdicts = spark.createDataFrame([(0.70, 0.70), (0.60, 0.70)], "wo DOUBLE, w DOUBLE")
    assert [r[0] for r in one(verdicts.select(rates.feature_verdict("wo", "w")))] == ["remove", "keep"]


def test_site_names(spark):
    df = spark.createDataFrame(
        [("Other", "Kent", 2), ("a", "Kent", 2), ("b", "Kent", 1), (" N/A ", None, 3), ("c", None, 2), (None, "x", 2), ("", "", 1)],
        "n STRING, c STRING, u INT")
    assert [r[0] for r in one(df.select(wording.display_name("n", "c", "u")))] == [
        "Unnamed site, Kent", "a, Kent", "b", "Unnamed site", "c", None, "Unnamed site"]


def test_land_words(spark):
    df = spark.createDataFrame([("lc_arable_5km", 12.0), ("lc_urban_1km", 0.49), ("lc_urban_1km", 0.5), ("nitrate_mid", 2.0), ("zz", 1.0)], "f STRING, v DOUBLE")
    assert [r[0] for r in one(df.select(wording.factor_text("f", "v")))] == [
        "9.4 km² of farmland within 5km", "No built-up area within 1km", "0.0 km² of built-up area within 1km",
        "Nitrate level", "zz"]
    assert [r[0] for r in one(df.select(wording.factor_title("f")))][:2] == ["Farmland (5km)", "Built-Up Area (1km)"]


def test_run_marks_and_meanings(spark):
    df = spark.createDataFrame([("success", "Poor"), ("odd", "None")], "s STRING, m STRING")
    got = one(df.select(wording.run_mark("s"), wording.status_meaning("m")))
    assert got[0][0] == "✅" and got[1] == ("⚠️", "")


def test_feature_groups_report_strangers():
    groups = feature_groups([*FEATURES, "pH"])
    assert (len(groups["chemistry"]), len(groups["sewage"]), len(groups["land"]), groups["unassigned"]) == (2, 3, 12, ["pH"])


def test_usable_position(spark):
    df = spark.createDataFrame([(1.0, 1.0), (0.0, 1.0), (None, 1.0)], "x DOUBLE, y DOUBLE")
    assert [r[0] for r in one(df.select(rates.usable_position(F.col("x"), F.col("y"))))] == [True, False, False]
