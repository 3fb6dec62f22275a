"""Rolling live features kept up to date by each batch instead of read again from a year of feed rows.

Every batch stores its counts per (waterbody, outlet, day) and a new state: counts per (waterbody, outlet) over all whole days
of the window. The state is the one before plus the days of the batch minus the stored days that have left the window; an outlet
whose rows have all left is dropped, so distinct outlets stay exact. The day on which the window begins is partly inside it and is
read from the feed, that one day only. A batch therefore reads the state, its own rows, the days that expire and one day of the feed,
however long the history is.

A batch that runs again replaces its own counts and starts from the same state as before. The window never moves back: with an
older `as_of` the state keeps its first day. Rows without waterbody or time count nowhere. The first batch counts the whole
stored feed once.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivermeld.functions.rates import is_discharging, per_pipe_live
from rivermeld.plans.reports import since
from rivermeld.sources.store import Warehouse

WINDOW_DAYS = 365
DAYS = "wb_id STRING, outlet_ngr STRING, n_rows LONG, n_discharging LONG, day DATE"
STATE = "wb_id STRING, outlet_ngr STRING, n_rows LONG, n_discharging LONG, first_day DATE"


def _first_whole_day(as_of: str, days: int) -> date:
    return date.fromisoformat(as_of[:10]) - timedelta(days=days - 1)


def _folder(store: Warehouse, kind: str, days: int) -> str:
    return f"{store.root}/rolling/{days}/{kind}"


def _state(store: Warehouse, days: int, batch: str) -> DataFrame:
    return store.spark.read.schema(STATE).parquet(f"{_folder(store, 'outlets', days)}/batch={batch}")


def _counted(rows: DataFrame) -> DataFrame:
    known = rows.where("wb_id IS NOT NULL AND received_at IS NOT NULL")
    return known.groupBy("wb_id", "outlet_ngr", F.to_date("received_at").alias("day")).agg(
        F.count("*").alias("n_rows"), F.count_if(is_discharging("status")).alias("n_discharging"))


def advance(store: Warehouse, batch: str, as_of: str, landed: DataFrame, days: int = WINDOW_DAYS) -> None:
    """Bring the state to `as_of` with the rows `landed` in `batch`; batches are in the order of their names."""
    spark, kept, totals = store.spark, _folder(store, "days", days), _folder(store, "outlets", days)
    earlier = [b for b in store.finished(totals, "batch=") if b < f"batch={batch}"]
    rows = landed if earlier else store.read("staging_edm_live")
    _counted(rows).write.mode("overwrite").partitionBy("day").parquet(f"{kept}/batch={batch}")
    fresh = spark.read.schema(DAYS).parquet(f"{kept}/batch={batch}")
    first = _first_whole_day(as_of, days)
    parts, counts = [], ["wb_id", "outlet_ngr", "n_rows", "n_discharging"]
    if earlier:
        before = _state(store, days, earlier[-1].split("=", 1)[1])
        # One date; an empty state has no days to lose.
        reached = before.agg(F.max("first_day")).first()[0] or first
        first = max(first, reached)
        parts.append(before.select(*counts))
        stored = [f"{kept}/{b}" for b in store.finished(kept, "batch=") if b < f"batch={batch}"]
        if stored and reached < first:
            old = spark.read.schema(DAYS).option("basePath", kept).parquet(*stored)
            gone = old.where(F.col("day").between(F.lit(reached), F.lit(first - timedelta(days=1))))
            parts.append(gone.select("wb_id", "outlet_ngr", (-F.col("n_rows")).alias("n_rows"), (-F.col("n_discharging")).alias("n_discharging")))
    total = fresh.where(F.col("day") >= F.lit(first)).select(*counts)
    for part in parts:
        total = total.unionByName(part)
    state = total.groupBy("wb_id", "outlet_ngr").agg(F.sum("n_rows").alias("n_rows"), F.sum("n_discharging").alias("n_discharging"))
    state.where("n_rows > 0").withColumn("first_day", F.lit(first)).write.mode("overwrite").parquet(f"{totals}/batch={batch}")


def features(store: Warehouse, batch: str, as_of: str, touched: DataFrame, days: int = WINDOW_DAYS) -> DataFrame:
    """Live features of the touched waterbodies after `batch`, equal to those computed from all rows of the window."""
    whole = _state(store, days, batch).join(touched, "wb_id", "left_semi").select("wb_id", "outlet_ngr", "n_discharging")
    edge = str(_first_whole_day(as_of, days) - timedelta(days=1))
    partly = since(store.read_days("staging_edm_live", edge, edge), "received_at", as_of, days)
    partly = _counted(partly.join(touched, "wb_id", "left_semi")).select("wb_id", "outlet_ngr", "n_discharging")
    per_outlet = whole.unionByName(partly).groupBy("wb_id", "outlet_ngr").agg(F.sum("n_discharging").alias("spill_count"))
    counted = per_outlet.groupBy("wb_id").agg(F.sum("spill_count").alias("spill_count"), F.count("outlet_ngr").alias("n_overflows"))
    return counted.withColumn("spills_per_pipe", per_pipe_live("spill_count", "n_overflows"))


def prune(store: Warehouse, days: int = WINDOW_DAYS, keep: int = 2) -> int:
    """Remove all but the newest `keep` states; returns how many went."""
    totals = _folder(store, "outlets", days)
    old = store.finished(totals, "batch=")[:-keep]
    for batch in old:
        store.remove(f"{totals}/{batch}")
    return len(old)
