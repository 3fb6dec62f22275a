"""Structured Streaming over the live discharge feed.

One query ingests landed polls, and its foreachBatch matches monitors, appends the feed and rescores the
touched sites. Both writes carry the batch id and replace that batch on replay, so a restart after a
failure leaves no duplicates. Windowed summaries are queries of their own.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from rivermeld.functions.rates import is_discharging, usable_position
from rivermeld.operators.keyed import distinct_tuples
from rivermeld.operators.nearest import PlaceIndex
from rivermeld.plans import rolling
from rivermeld.plans.live import refresh
from rivermeld.plans.reports import last_success
from rivermeld.session import written
from rivermeld.sources.files import LIVE_SCHEMA
from rivermeld.sources.store import Warehouse

POLL = "15 minutes"
LATENESS = "1 hour"


def feed_stream(spark: SparkSession, folder: str, schema: T.StructType | str = LIVE_SCHEMA,
                kind: str = "json", files_per_batch: int = 1000) -> DataFrame:
    """Landed polls as a stream: one folder per company below `folder`."""
    return (spark.readStream.schema(schema).format(kind).option("recursiveFileLookup", True)
            .option("maxFilesPerTrigger", files_per_batch).load(folder))


def without_repeats(feed: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """Feed rows without repeats of one monitor's poll; state lives only as long as the lateness."""
    return feed.withWatermark("received_at", lateness).dropDuplicatesWithinWatermark(
        ["company", "outlet_ngr", "received_at"])


def matched_feed(feed: DataFrame, index: PlaceIndex) -> DataFrame:
    """Stored shape of feed rows with the nearest waterbody within the index's reach, if any."""
    ok = usable_position("x", "y")
    placed = feed.withColumns({"x": F.when(ok, F.col("x")), "y": F.when(ok, F.col("y"))})
    name = [F.col("site_name")] if "site_name" in feed.columns else []
    near = index.attach(placed, ("x", "y"))
    return near.select(
        "wb_id", F.coalesce(*name, F.col("monitor_key")).alias("outlet_ngr"), "company",
        F.coalesce("current_status", F.lit("Unknown")).alias("status"),
        F.lit(0.0).alias("duration_hrs"), "received_at")


def ingest(feed: DataFrame, index: PlaceIndex, store: Warehouse, checkpoint: str,
           model: PipelineModel | None = None, names: list[str] | None = None, every: str | None = None) -> StreamingQuery:
    """Start the live query. Without `every` it takes what has landed and stops; with it, it runs on at that interval
    (`POLL` is the published one). An empty poll and a failing batch are logged as failed."""

    def step(batch: DataFrame, batch_id: int) -> None:
        key = f"stream-{batch_id:012d}"
        try:
            process(batch, key)
        except Exception as error:
            store.log_run("edm_live", 0, 0, "failed", now(), str(error)[:500], batch=f"edm-{key}")
            raise

    def process(batch: DataFrame, key: str) -> None:
        rows = matched_feed(batch, index)
        store.append("staging_edm_live", rows, batch=key)
        landed = store.read_batch("staging_edm_live", key)
        seen = landed.agg(F.count("*").alias("n"), F.count("wb_id").alias("matched"),
                          F.max("received_at").cast("string").alias("newest")).first()
        if seen["n"] == 0:
            store.log_run("edm_live", 0, 0, "failed", now(), "the poll was empty", batch=f"edm-{key}")
            return
        # A backfilled poll is scored as of the newest time known, so that its scores are the latest ones.
        reached = last_success(store.read("ingestion_log").where(F.col("source") == "edm_live"), "edm_live").first()["last_run"]
        newest = max(filter(None, (seen["newest"], str(reached) if reached else None)))
        store.log_run("edm_live", seen["n"], seen["matched"], "success", newest, batch=f"edm-{key}")
        if model is not None:
            touched = written(distinct_tuples(landed.where(F.col("wb_id").isNotNull()), ["wb_id"]), "touched")
            rolling.advance(store, key, newest, landed)
            refresh(store, model, newest, batch=key, touched=touched, names=names,
                    features=rolling.features(store, key, newest, touched))

    return (feed.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
            .trigger(**({"processingTime": every} if every else {"availableNow": True})).start())


def now() -> str:
    return datetime.now(timezone.utc).strftime("%Y-%m-%d %H:%M:%S")


def polls(feed: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """Rows and matched rows per company and status in tumbling poll windows."""
    return (feed.withWatermark("received_at", lateness)
            .groupBy(F.window("received_at", POLL), "company", "status")
            .agg(F.count("*").alias("n"), F.count("wb_id").alias("matched")))


def last_day(feed: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """The 24-hour summary, sliding every poll.

    Rows are counted per poll window first, so the 96 overlapping days copy counts, not rows.
    """
    stepped = polls(feed, lateness).select(
        F.window_time("window").alias("at"), "company", "status", "n", "matched")
    return (stepped.groupBy(F.window("at", "1 day", POLL), "company", "status")
            .agg(F.sum("n").alias("n"), F.sum("matched").alias("matched")))


def discharge_sessions(feed: DataFrame, gap: str = "30 minutes", lateness: str = LATENESS) -> DataFrame:
    """Runs of discharging polls per outlet with their length in hours."""
    on = feed.where(is_discharging("status")).withWatermark("received_at", lateness)
    runs = on.groupBy(F.session_window("received_at", gap).alias("run"), "company", "outlet_ngr").agg(
        F.count("*").alias("n_polls"), F.min("received_at").alias("first_seen"),
        F.max("received_at").alias("last_seen"))
    seconds = F.unix_micros("last_seen") - F.unix_micros("first_seen")
    return runs.select("company", "outlet_ngr", "first_seen", "last_seen", "n_polls",
                       (seconds / 3.6e9).alias("duration_hrs"))


def write_stream(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append finished rows to Parquet, processing what is available and stopping."""
    return (df.writeStream.format("parquet").outputMode("append").option("path", path)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
