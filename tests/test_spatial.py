import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rivermeld.operators import landcover, matrix, nearest
from rivermeld.settings import LAND, LAND_GROUPS, RADII


def places_frame(spark, rows):
    return spark.createDataFrame(rows, "wb_id STRING, easting DOUBLE, northing DOUBLE")


def points_frame(spark, rows):
    return spark.createDataFrame(rows, "fww_id STRING, easting DOUBLE, northing DOUBLE")


def brute(points, places, limit=None):
    best = {}
    for pid, px, py in points:
        if px is None or py is None:
            best[pid] = (None, None)
            continue
        d2, wb = min(((x - px) ** 2 + (y - py) ** 2, wb) for wb, x, y in places)
        ok = limit is None or d2 <= limit * limit
        best[pid] = (wb, math.sqrt(d2)) if ok else (None, None)
    return best


def joined(df):
    return {r["fww_id"]: (r["wb_id"], r["dist_m"]) for r in df.collect()}


def test_ties_limits_and_missing_positions(spark):
    places = [("b", 0.0, 0.0), ("a", 2000.0, 0.0), ("c", 0.0, 9000.0)]
    points = [("tie", 1000.0, 0.0), ("edge", -5000.0, 0.0), ("out", -5000.1, 0.0), ("null", None, 1.0)]
    got = joined(nearest.nearest_join(points_frame(spark, points), places_frame(spark, places), place_id="wb_id", max_dist=5000.0))
    assert got == {"tie": ("a", 1000.0), "edge": ("b", 5000.0), "out": (None, None), "null": (None, None)}


@pytest.mark.parametrize("broadcast_rows", [200_000, 1])
@pytest.mark.parametrize("limit", [5000.0, None])
def test_crowded_places_equal_brute_force(spark, limit, broadcast_rows):
    """A third of all places and points sit in one town; some points lie far outside."""
    rng = random.Random(7)
    places = [(f"w{i:04d}", 420000 + rng.random() * 300, 210000 + rng.random() * 300) for i in range(200)]
    places += [(f"x{i:04d}", 400000 + rng.random() * 60000, 200000 + rng.random() * 60000) for i in range(200)]
    points = [(f"p{i}", 420000 + rng.random() * 400, 210000 + rng.random() * 400) for i in range(150)]
    points += [(f"q{i}", 380000 + rng.random() * 120000, 150000 + rng.random() * 120000) for i in range(250)]
    points += [("far", 900000.0, -50000.0)]
    df = nearest.nearest_join(points_frame(spark, points), places_frame(spark, places), place_id="wb_id",
                              max_dist=limit, list_target=24, broadcast_rows=broadcast_rows)
    want = brute(points, places, limit)
    got = joined(df)
    assert set(got) == set(want)
    for pid, (wb, dist) in want.items():
        assert got[pid][0] == wb
        assert dist is None or abs(got[pid][1] - dist) < 1e-6


def test_no_places_leaves_all_unmatched(spark):
    points = points_frame(spark, [("p", 1.0, 1.0)])
    got = joined(nearest.nearest_join(points, places_frame(spark, []), place_id="wb_id", max_dist=5000.0))
    assert got == {"p": (None, None)}


def test_index_is_reused_for_batches(spark):
    index = nearest.index_places(places_frame(spark, [("a", 0.0, 0.0)]), "wb_id")
    for x in (10.0, 20.0):
        row = index.attach(points_frame(spark, [("p", x, 0.0)])).first()
        assert (row["wb_id"], row["dist_m"]) == ("a", x)


def test_nearest_by_degrees(spark):
    df = spark.createDataFrame([("b", 1.0, 1.0), ("a", 1.0, 1.0), ("c", 5.0, 5.0)], "fww_id STRING, lat DOUBLE, lon DOUBLE")
    assert nearest.nearest_by_degrees(df, 1.1, 1.0, "fww_id").first()["fww_id"] == "a"


def test_land_shares_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    cells = [(e + 12.5, n + 12.5, int(rng.integers(0, 23)))
             for e in range(0, 3000, 100) for n in range(0, 3000, 100)]
    points = [("a", 1500.0, 1500.0), ("same", 1500.0, 1500.0), ("b", 2990.0, 10.0), ("none", 90000.0, 0.0), ("null", None, 0.0)]
    frame = spark.createDataFrame(cells, "easting DOUBLE, northing DOUBLE, code INT")
    got = {r["fww_id"]: r for r in landcover.land_shares(points_frame(spark, points), frame).collect()}
    assert len(got) == len(points)
    for pid, px, py in points:
        for label, radius in RADII.items():
            inside = [] if px is None else [
                c for e, n, c in cells if c != 0 and (e - px) ** 2 + (n - py) ** 2 <= radius ** 2]
            for group, codes in LAND_GROUPS.items():
                value = got[pid][f"lc_{group}_{label}"]
                if not inside:
                    assert value is None
                else:
                    assert value == 100.0 * sum(c in codes for c in inside) / len(inside)
                    assert 0 <= value <= 100
    assert [got["a"][c] for c in LAND] == [got["same"][c] for c in LAND]


def test_matrix_keeps_valid_rows_only(spark):
    rows = [("1", "s", "good", "Poor", 1.0, 0.1, None), ("2", "s", "poor", "Poor", 1.0, 0.1, "k"),
            ("3", "s", "good", None, 1.0, 0.1, "k"), ("4", "s", "good", "Poor", None, 0.1, "k")]
    df = spark.createDataFrame(rows, "fww_id STRING, site_name STRING, match_q STRING, wfd_status STRING, nitrate_mid DOUBLE, phosphate_mid DOUBLE, county STRING").withColumn("rbd", F.lit(None).cast("string"))
    got = matrix.build_matrix(df).collect()
    assert [(r["fww_id"], r["county"], r["rbd"]) for r in got] == [("1", "Unknown", "Unknown")]


def test_missing_features_fail(spark):
    with pytest.raises(ValueError, match="missing features"):
        matrix.filled_features(spark.createDataFrame([(1,)], ["a"]), ["a", "b"])
