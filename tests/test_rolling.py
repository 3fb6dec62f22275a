"""Kept rolling features against a full recomputation after every batch, with expiry, late rows and replay."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from rivermeld.plans import live, rolling
from rivermeld.sources.store import Warehouse

SCHEMA = "wb_id STRING, outlet_ngr STRING, company STRING, status STRING, duration_hrs DOUBLE, received_at TIMESTAMP"


def batch_rows(rng, day):
    """Rows of a few days up to `day`, some of them late beyond the window, some without waterbody, outlet or time."""
    at = lambda: datetime(2024, 1, 1) + timedelta(days=day - rng.choice([0, 0, 1, 2, 9]), minutes=rng.randrange(1440))
    return [(rng.choice(["a", "b", "c", None]), rng.choice(["o1", "o2", "o3", None]), "x", rng.choice(["Discharging", "Offline", None]), 0.0,
             at() if rng.random() > 0.05 else None) for _ in range(30)]


@pytest.mark.parametrize("days", [3, 7])
def test_equals_a_full_recomputation_after_every_batch(spark, tmp_path, monkeypatch, days):
    store, rng = Warehouse(spark, str(tmp_path)), random.Random(days)
    touched = spark.createDataFrame([("a",), ("b",), ("c",)], "wb_id STRING")
    for number, day in enumerate((10, 11, 13, 13, 25, 26)):
        key, as_of = f"b{number}", f"2024-01-{day:02d} 23:59:30"
        store.append("staging_edm_live", spark.createDataFrame(batch_rows(rng, day - 1), SCHEMA), batch=key)
        landed = store.read_batch("staging_edm_live", key)
        with monkeypatch.context() as m:
            if number:  # from here on the feed is read for one day only
                m.setattr(Warehouse, "read", lambda *a: pytest.fail("the whole feed was read"))
                asked = []
                plain = Warehouse.read_days
                m.setattr(Warehouse, "read_days", lambda self, name, a, b: asked.append((a, b)) or plain(self, name, a, b))
            for _ in range(2):  # the second time is a replay
                rolling.advance(store, key, as_of, landed, days)
            got = sorted(map(tuple, rolling.features(store, key, as_of, touched, days).collect()))
            if number:
                assert all(a == b for a, b in asked)
        feed = store.read("staging_edm_live")
        assert got == sorted(map(tuple, live.rolling_features(feed, touched, as_of, days).collect()))
        assert spark.read.parquet(f"{tmp_path}/rolling/{days}/outlets/batch={key}").count() <= 12
    assert rolling.prune(store, days) == 4 and rolling.prune(store, days) == 0


def test_backfilled_batches_do_not_move_the_window_back(spark, tmp_path):
    store = Warehouse(spark, str(tmp_path))
    row = lambda wb, at: (wb, "o", "x", "Discharging", 0.0, at)
    touched = spark.createDataFrame([("a",)], "wb_id STRING")
    for key, at, as_of in (("b1", datetime(2024, 1, 20), "2024-01-20 12:00:00"), ("b2", datetime(2024, 1, 2), "2024-01-20 12:00:00")):
        store.append("staging_edm_live", spark.createDataFrame([row("a", at)], SCHEMA), batch=key)
        rolling.advance(store, key, as_of, store.read_batch("staging_edm_live", key), 5)
    assert rolling.features(store, "b2", "2024-01-20 12:00:00", touched, 5).first().spill_count == 1
    empty = store.read_batch("staging_edm_live", "b2").where(F.lit(False))
    rolling.advance(store, "b3", "2024-03-01 00:00:00", empty, 5)
    assert rolling.features(store, "b3", "2024-03-01 00:00:00", touched, 5).count() == 0
