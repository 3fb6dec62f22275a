"""The streaming feature build against the full build, with restarts, replays and rebuilds between its batches."""

import pytest

from rivermeld.plans import build
from rivermeld.session import new_folder
from rivermeld.sources.store import Warehouse
from rivermeld.streaming.features import add_batch, build_features, stored_stream

AS_OF = "2024-01-01 00:00:00"


def readings(spark, ids, chemistry=1.0):
    rows = [(i, f"site {i}", "Kent", "r", 1000.0 * k, 1000.0, chemistry, 1.0) for k, i in enumerate(ids)]
    return spark.createDataFrame(rows, "fww_id string, site_name string, county string, rbd string, easting double, northing double, "
                                       "nitrate_mid double, phosphate_mid double")


@pytest.fixture
def store(spark):
    store = Warehouse(spark, new_folder(spark, "warehouse"))
    places = [(f"w{k}", f"river {k}", "r", "Good", 3000.0 * k, 1500.0) for k in range(4)]
    store.replace("staging_wfd", spark.createDataFrame(
        places, "wb_id string, wb_name string, rbd string, wfd_status string, easting double, northing double"), AS_OF)
    return store


def run(store, checkpoint):
    """Run what has landed; the rows that were read."""
    stream = build_features(stored_stream(store), store, checkpoint)
    stream.awaitTermination()
    return sum(p["numInputRows"] for p in stream.recentProgress)


def ids(store):
    return sorted(r["fww_id"] for r in store.read("feat_matrix").collect())


def full(store):
    rows = build.full_build(store.read("staging_fww").na.drop(subset=["nitrate_mid", "phosphate_mid"]), store.read("staging_wfd"),
                            store.read("staging_edm_historical"))
    return sorted(map(str, rows.select("fww_id", "wb_id", "wfd_status", "match_q", "hrs_per_pipe", "wfd_dist_m").collect()))


def test_batches_equal_full_build_after_restarts_and_a_replay(spark, store, tmp_path):
    checkpoint = str(tmp_path / "checkpoint")
    for n, names in ((5, "abcde"), (2, "fg"), (1, "h")):
        store.append("staging_fww", readings(spark, names))
        store.append("staging_fww", readings(spark, [names[0] + "-bare"], None))
        assert run(store, checkpoint) == n + 1  # earlier readings are not read again
    got = store.read("feat_matrix").select("fww_id", "wb_id", "wfd_status", "match_q", "hrs_per_pipe", "wfd_dist_m")
    assert sorted(map(str, got.collect())) == full(store) and len(full(store)) == 8
    # The last batch was built, but its end was not noted: it runs again and adds nothing.
    commits = sorted((tmp_path / "checkpoint" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    commits[-1].unlink()
    commits[-1].with_name(f".{commits[-1].name}.crc").unlink()
    run(store, checkpoint)
    assert len(ids(store)) == 8
    log = store.read("ingestion_log").where("source = 'feature_engineering'")
    assert {r["status"] for r in log.collect()} == {"success"} and log.count() == 3


def test_rebuild_between_batches_gives_no_row_twice(spark, store, tmp_path):
    checkpoint = str(tmp_path / "checkpoint")
    store.append("staging_fww", readings(spark, "ab"))
    run(store, checkpoint)
    store.append("staging_fww", readings(spark, "cd"))
    build.rebuild(store, AS_OF)  # takes c and d, which the stream has not read
    store.append("staging_fww", readings(spark, "e"))
    run(store, checkpoint)
    assert ids(store) == list("abcde")


def test_joined_parts_keep_the_last_batch(spark, store, monkeypatch):
    monkeypatch.setattr("rivermeld.sources.store.COMPACT", 2)
    for k in range(6):
        assert add_batch(store, readings(spark, [f"n{k}"]), f"stream-{k:012d}", AS_OF) == 1
        assert add_batch(store, readings(spark, [f"n{k}"]), f"stream-{k:012d}", AS_OF) == 0
        assert not store.has_other_parts("feat_matrix")
    assert ids(store) == [f"n{k}" for k in range(6)]
    store.replace("feat_matrix", store.read("feat_matrix"), AS_OF)
    assert store.has_other_parts("feat_matrix")
    for k in range(6, 10):
        assert add_batch(store, readings(spark, [f"n{k}"]), f"stream-{k:012d}", AS_OF) == 1
        assert store.holds("feat_matrix", f"stream-{k:012d}") and store.has_other_parts("feat_matrix")
    assert len(ids(store)) == 10


def test_batch_without_valid_rows_is_noted(spark, store):
    assert add_batch(store, readings(spark, "ab", None), "stream-000000000000", AS_OF) == 0
    assert store.holds("feat_matrix", "stream-000000000000") and ids(store) == []
