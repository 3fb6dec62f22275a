"""Discharge states against a plain replay, over restarts, out-of-order landings and outlets that fall silent."""

import random
from datetime import datetime, timedelta

import pytest

from rivermeld.streaming import discharges
from rivermeld.streaming.live import write_stream

START = datetime(2024, 1, 1)
SCHEMA = "company STRING, outlet_ngr STRING, status STRING, received_at TIMESTAMP"


def expected(rows, gap=timedelta(minutes=30), lateness=timedelta(hours=1)):
    mark = max(r[3] for r in rows if r[3] is not None) - lateness
    polls = {}
    for company, outlet, status, at in rows:
        if at is not None and at < mark:
            seen = polls.setdefault((company, outlet), {})
            seen[at] = seen.get(at, False) or (status or "").lower() == "discharging"
    found = set()
    for key, seen in polls.items():
        run = None
        for at, on in sorted(seen.items()):
            if run and at - run[1] >= gap:
                found.add((*key, *run, "silence"))
                run = None
            if on:
                run = (run[0], at, run[2] + 1) if run else (at, at, 1)
            elif run:
                found.add((*key, *run, "change"))
                run = None
        if run:
            found.add((*key, *run, "silence" if run[1] + gap < mark else "open"))
    return found


def streamed(spark, tmp_path, landings):
    landing, out, checkpoint = (str(tmp_path / n) for n in ("landing", "out", "checkpoint"))
    for rows in landings:  # each landing is a run of its own, restarted from the checkpoint
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(landing)
        feed = spark.readStream.schema(SCHEMA).parquet(landing)
        write_stream(discharges.discharge_states(feed), out, checkpoint).awaitTermination()
    rows = discharges.current_discharges(spark.read.parquet(out)).collect()
    return {(r.company, r.outlet_ngr, r.first_seen, r.last_seen, r.n_polls, r.ended) for r in rows}


def feed(seed, n=260):
    rng = random.Random(seed)
    rows = [(rng.choice(["x", "y", None]), f"o{rng.randrange(3)}", rng.choice(["Discharging", "DISCHARGING", "Offline", None]),
             START + timedelta(minutes=5 * rng.randrange(250))) for _ in range(n)]
    return sorted(rows, key=lambda r: r[3])


@pytest.mark.parametrize("seed", [1, 2])
def test_restarts_and_out_of_order_rows(spark, tmp_path, seed):
    rows = feed(seed)
    rng = random.Random(seed)
    jumbled = sorted(rows, key=lambda r: r[3] + timedelta(minutes=rng.randrange(50)))  # at most 50 minutes late
    got = streamed(spark, tmp_path, [jumbled[:90], jumbled[90:180], jumbled[180:]])
    assert got == expected(rows)
    assert {g[5] for g in got} >= {"change", "silence"}


def test_open_discharges_and_silence(spark, tmp_path):
    at = lambda m: START + timedelta(minutes=m)
    rows = [("x", "steady", "Discharging", at(m)) for m in range(0, 300, 15)] + [("x", "silent", "Discharging", at(10)), ("x", None, "Offline", at(300)),
            ("x", "twice", "Offline", at(20)), ("x", "twice", "Discharging", at(20)), ("x", "gone", "Discharging", None)]
    assert streamed(spark, tmp_path, [rows]) == {
        ("x", "steady", at(0), at(225), 16, "open"), ("x", "silent", at(10), at(10), 1, "silence"), ("x", "twice", at(20), at(20), 1, "silence")}
