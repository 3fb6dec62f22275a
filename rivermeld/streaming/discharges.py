"""Discharges per outlet as keyed state with event-time timers: open ones are seen while they last.

A discharge starts with a discharging poll and goes on while polls of its outlet say so and come within `gap`. It ends by
`change` (a poll says otherwise in time) or by `silence` (no poll for `gap`, which a timer notices without any new row).
Polls wait in the state until the watermark has passed them, so rows that arrive out of order are taken in order and
the result does not depend on how the feed was cut into batches.

The state of an outlet is its open discharge and the polls of the last `lateness`; an outlet with neither has none.
Polls of one outlet and instant count as one, which discharges if any of them does. Rows without a time are left out;
null companies and outlets are keys like others.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from rivermeld.functions.rates import is_discharging
from rivermeld.streaming.live import LATENESS

ROWS = "company STRING, outlet_ngr STRING, first_us LONG, last_us LONG, n_polls LONG, ended STRING"
STATE = "first_us LONG, last_us LONG, n_polls LONG, times ARRAY<LONG>, flags ARRAY<BOOLEAN>"


def _taken_in_order(polls: list[tuple[int, bool]], run: tuple[int, int, int] | None, gap_us: int):
    """(finished discharges with how they ended, the open one) after polls in time order."""
    done = []
    for at, on in polls:
        if run is not None and at - run[1] >= gap_us:
            done.append((*run, "silence"))
            run = None
        if on:
            run = (at, at, 1) if run is None else (run[0], at, run[2] + 1)
        elif run is not None:
            done.append((*run, "change"))
            run = None
    return done, run


def discharge_states(feed: DataFrame, gap_minutes: int = 30, lateness: str = LATENESS) -> DataFrame:
    """A stream of discharges: each finished one once, and the open one of an outlet whenever the outlet moved on."""
    gap_us = gap_minutes * 60_000_000

    def moved(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        first, last, n, times, flags = state.get if state.exists else (None, None, None, [], [])
        run = None if first is None else (int(first), int(last), int(n))
        waiting = dict(zip((int(t) for t in times), (bool(f) for f in flags), strict=True))
        for part in parts:
            for at, on in zip(part["at_us"], part["discharging"], strict=True):
                waiting[int(at)] = waiting.get(int(at), False) or bool(on)
        mark = state.getCurrentWatermarkMs()
        ready = sorted((at, on) for at, on in waiting.items() if at // 1000 < mark)
        done, after = _taken_in_order(ready, run, gap_us)
        if after is not None and (after[1] + gap_us) // 1000 < mark:
            done.append((*after, "silence"))
            after = None
        left = sorted((at, on) for at, on in waiting.items() if at // 1000 >= mark)
        if after is None and not left:
            state.remove()
        else:
            state.update((*(after or (None, None, None)), [at for at, _ in left], [on for _, on in left]))
            due = [left[0][0] // 1000] if left else []
            if after is not None:
                due.append((after[1] + gap_us) // 1000)
            state.setTimeoutTimestamp(max(min(due), mark + 1))
        rows = done + ([(*after, "open")] if after is not None and after != run else [])
        if rows:
            yield pd.DataFrame([(*key, *r) for r in rows], columns=["company", "outlet_ngr", "first_us", "last_us", "n_polls", "ended"])

    rows = (feed.where("received_at IS NOT NULL").withWatermark("received_at", lateness)
            .select("company", "outlet_ngr", "received_at", F.unix_micros("received_at").alias("at_us"),
                    F.coalesce(is_discharging("status"), F.lit(False)).alias("discharging")))
    found = rows.groupBy("company", "outlet_ngr").applyInPandasWithState(moved, ROWS, STATE, "append", GroupStateTimeout.EventTimeTimeout)
    return found.select("company", "outlet_ngr", F.timestamp_micros("first_us").alias("first_seen"),
                        F.timestamp_micros("last_us").alias("last_seen"), "n_polls", "ended")


def current_discharges(rows: DataFrame) -> DataFrame:
    """One row per discharge of what the stream appended: its end if it has ended, else how far it has come."""
    newest = F.max_by(F.struct("last_seen", "n_polls", "ended"), F.struct(F.col("ended") != "open", "last_seen")).alias("r")
    runs = rows.groupBy("company", "outlet_ngr", "first_seen").agg(newest)
    hours = (F.unix_micros("r.last_seen") - F.unix_micros("first_seen")) / 3.6e9
    return runs.select("company", "outlet_ngr", "first_seen", "r.last_seen", "r.n_polls", "r.ended", hours.alias("duration_hrs"))
