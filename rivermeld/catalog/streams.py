"""Queries that run a stream over the whole feed and return what it wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivermeld.catalog.joins import full_matrix
from rivermeld.catalog.registry import Inputs, query
from rivermeld.catalog.sqltext import AS_OF, MATCHED, RIVERS, ctes
from rivermeld.operators import learning, matrix
from rivermeld.operators.nearest import index_places
from rivermeld.plans import build, live, rolling
from rivermeld.session import new_folder, written
from rivermeld.settings import FEATURES
from rivermeld.sources.driver_views import VIEWS
from rivermeld.sources.store import Warehouse
from rivermeld.streaming import discharges, features
from rivermeld.streaming import live as streams

def stream_of(t: Inputs, name: str) -> DataFrame:
    """A view over the events table as a stream, with event time as a timestamp."""
    schema = t.table("events").schema
    rows = t.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(t.sf_dir)
    shaped = t.spark.sql(VIEWS[name][1].replace("FROM events", "FROM {events}"), events=rows)
    return shaped.withColumn("received_at", F.col("received_at").cast("timestamp"))


def finished(df: DataFrame, t: Inputs) -> DataFrame:
    """Run a windowed stream to its end and read the rows it appended."""
    path = new_folder(t.spark, "stream")
    streams.write_stream(df, f"{path}/rows", f"{path}/checkpoint").awaitTermination()
    return t.spark.read.schema(df.schema).parquet(f"{path}/rows")


def landed_in_days(t: Inputs) -> str:
    """The monitors view landed as files of several days, so a stream takes several batches."""
    path = new_folder(t.spark, "landing")
    rows = t.monitors.withColumn("received_at", F.col("received_at").cast("timestamp"))
    rows.repartitionByRange(4, "received_at").write.parquet(path)
    return path


def time_quarter(rows: DataFrame):
    """The quarter of the whole time span in which a row was received, 0 to 3."""
    at = F.unix_micros("received_at")
    span = rows.agg(F.min(at).alias("a"), F.max(at).alias("b")).first()
    first = span["a"] or 0
    return F.least(F.lit(3), F.floor((at - first) * 4 / max((span["b"] or 0) - first, 1)))


def matrix_store(t: Inputs) -> Warehouse:
    """A warehouse with the matrix of all readings."""
    store = Warehouse(t.spark, new_folder(t.spark, "warehouse"))
    store.replace("feat_matrix", full_matrix(t), "2024-01-01 00:00:00")
    return store


def live_model(store: Warehouse):
    return learning.train_final(store.read("feat_matrix"), FEATURES, "rf")


@query("t1_s9_j2_stream_to_store", ctes(["monitors", "waterbodies"]) + """,
pairs AS (
  SELECT m.monitor_key, w.wb_id,
         (w.easting - m.x) * (w.easting - m.x) + (w.northing - m.y) * (w.northing - m.y) AS d2
  FROM monitors m CROSS JOIN waterbodies w WHERE m.x <> 0 AND m.y <> 0),
best AS (SELECT monitor_key, wb_id, ROW_NUMBER() OVER (PARTITION BY monitor_key ORDER BY d2, wb_id) AS rn
         FROM pairs WHERE d2 <= 25000000)
SELECT m.company, COALESCE(m.current_status, 'Unknown') AS status, COUNT(*) AS n, COUNT(b.wb_id) AS matched
FROM monitors m LEFT JOIN best b ON m.monitor_key = b.monitor_key AND b.rn = 1 GROUP BY 1, 2""")
def stream_to_store(t: Inputs) -> DataFrame:
    store = Warehouse(t.spark, new_folder(t.spark, "warehouse"))
    folder = landed_in_days(t)
    feed = streams.feed_stream(t.spark, folder, t.spark.read.parquet(folder).schema, "parquet", 1)
    index = index_places(t.waterbodies, "wb_id")
    streams.ingest(feed, index, store, new_folder(t.spark, "checkpoint")).awaitTermination()
    rows = store.read("staging_edm_live")
    return rows.groupBy("company", "status").agg(F.count("*").alias("n"), F.count("wb_id").alias("matched"))


@query("t1_t3_t4_t7_stream_rescores_sites")
def stream_rescores(t: Inputs) -> DataFrame:
    store = matrix_store(t)
    folder = landed_in_days(t)
    feed = streams.feed_stream(t.spark, folder, t.spark.read.parquet(folder).schema, "parquet", 1)
    index = index_places(store.read("feat_matrix").select("wb_id", "easting", "northing").distinct(), "wb_id")
    streams.ingest(feed, index, store, new_folder(t.spark, "checkpoint"), live_model(store), FEATURES).awaitTermination()
    scored = store.read("predictions").groupBy("data_source", "predicted_status").agg(F.count("*").alias("n"))
    logged = store.read("ingestion_log").groupBy("source", "status").agg(F.sum("records_new").alias("n"))
    return scored.toDF("part", "name", "n").unionByName(logged.toDF("part", "name", "n"))


@query("t2_touched_waterbodies", ctes(["edm_live"]) + """
SELECT DISTINCT wb_id FROM edm_live WHERE wb_id IS NOT NULL AND received_at >= TIMESTAMP '2024-01-30 12:00:00'""")
def touched(t: Inputs) -> DataFrame:
    return live.touched_waterbodies(t.edm_live, "2024-01-30 12:00:00")


@query("t3_rolling_features_of_touched", ctes(["edm_live"]) + f"""
SELECT wb_id, COUNT(*) FILTER (LOWER(status) = 'discharging') AS spill_count, COUNT(DISTINCT outlet_ngr) AS n_overflows,
       CAST(COUNT(*) FILTER (LOWER(status) = 'discharging') AS DOUBLE) / GREATEST(COUNT(DISTINCT outlet_ngr), 1) AS spills_per_pipe
FROM edm_live WHERE received_at >= TIMESTAMP '{AS_OF}' - INTERVAL 365 DAY AND wb_id IN (
  SELECT wb_id FROM edm_live WHERE received_at >= TIMESTAMP '2024-01-30 23:00:00') GROUP BY wb_id""")
def rolling_of_touched(t: Inputs) -> DataFrame:
    chosen = live.touched_waterbodies(t.edm_live, "2024-01-30 23:00:00")
    return live.rolling_features(t.edm_live, chosen, AS_OF)


KEPT = """SELECT {days} AS window_days, wb_id, COUNT(*) FILTER (LOWER(status) = 'discharging') AS spill_count, COUNT(DISTINCT outlet_ngr) AS n_overflows
FROM edm_live, last WHERE wb_id IS NOT NULL AND received_at >= newest - INTERVAL {days} DAY GROUP BY wb_id"""


@query("t3_features_kept_by_batches", ctes(["edm_live"]) + """, last AS (SELECT MAX(received_at) AS newest FROM edm_live)
""" + KEPT.format(days=365) + " UNION ALL " + KEPT.format(days=10))
def kept_features(t: Inputs) -> DataFrame:
    """The feed in four batches by time; features of all waterbodies after the last, over a year and over ten days, of which most expire."""
    store = Warehouse(t.spark, new_folder(t.spark, "warehouse"))
    feed = t.edm_live.withColumn("received_at", F.col("received_at").cast("timestamp"))
    quarter = time_quarter(feed)
    parts = []
    for part in range(4):
        store.append("staging_edm_live", feed.where(quarter == part), batch=f"b{part}")
        landed = store.read_batch("staging_edm_live", f"b{part}")
        newest = landed.agg(F.max("received_at").cast("string")).first()[0]
        for days in (365, 10):
            if newest is not None:
                rolling.advance(store, f"b{part}", newest, landed, days)
                last = (f"b{part}", newest)
    for days in (365, 10):
        every = feed.select("wb_id").where("wb_id IS NOT NULL").distinct()
        parts.append(rolling.features(store, *last, every, days).select(F.lit(days).alias("window_days"), "wb_id", "spill_count", "n_overflows"))
    return parts[0].unionByName(parts[1])


@query("t4_t7_batch_refresh_and_log", ctes(["readings", "waterbodies", "edm_live"], RIVERS, MATCHED) + """,
n AS (SELECT COUNT(*) AS n FROM matched WHERE country = 'England' AND match_q <> 'poor' AND nitrate_mid IS NOT NULL
        AND phosphate_mid IS NOT NULL AND wb_id IN (SELECT wb_id FROM edm_live))
SELECT '2024-01-01 00:00:00' AS run_at, 'live_inference' AS source, 'no_new_data' AS status,
       CAST(0 AS BIGINT) AS records_fetched, CAST(0 AS BIGINT) AS records_new
UNION ALL SELECT '2024-01-31 00:00:00', 'live_inference', 'success', n, n FROM n
UNION ALL SELECT '2024-02-01 00:00:00', 'live_inference', 'no_new_data', 0, 0""")
def batch_refresh(t: Inputs) -> DataFrame:
    store = matrix_store(t)
    model = live_model(store)
    feed = t.edm_live.withColumn("received_at", F.col("received_at").cast("timestamp"))
    live.refresh(store, model, "2024-01-01 00:00:00", names=FEATURES)
    store.append("staging_edm_live", feed)
    live.refresh(store, model, AS_OF, names=FEATURES)
    live.refresh(store, model, "2024-02-01 00:00:00", names=FEATURES)
    return store.read("ingestion_log").select(
        F.col("run_at").cast("string").alias("run_at"), "source", "status", "records_fetched", "records_new")


# A window is finished once the newest event is an hour past its end.
MARK = "mark AS (SELECT MAX(received_at) - INTERVAL 1 HOUR AS closed FROM edm_live)"
STEPS = f"""{MARK},
steps AS (SELECT time_bucket(INTERVAL 15 MINUTE, received_at) AS s, company, status, COUNT(*) AS n, COUNT(wb_id) AS matched
          FROM edm_live GROUP BY 1, 2, 3)"""


@query("t1_tumbling_poll_windows", ctes(["edm_live"], STEPS) + """
SELECT s AS window_start, company, status, n, matched FROM steps, mark WHERE s + INTERVAL 15 MINUTE <= closed""")
def poll_windows(t: Inputs) -> DataFrame:
    rows = finished(streams.polls(stream_of(t, "edm_live")), t)
    return rows.select(F.col("window.start").cast("timestamp_ntz").alias("window_start"), "company", "status", "n", "matched")


@query("t5_sliding_last_day", ctes(["edm_live"], STEPS) + """,
days AS (SELECT s - INTERVAL (15 * k) MINUTE AS ws, company, status, n, matched FROM steps, mark,
         (SELECT UNNEST(range(96)) AS k) WHERE s + INTERVAL 15 MINUTE <= closed)
SELECT ws AS window_start, company, status, CAST(SUM(n) AS BIGINT) AS n, CAST(SUM(matched) AS BIGINT) AS matched
FROM days, mark WHERE ws + INTERVAL 1 DAY <= closed GROUP BY 1, 2, 3""")
def sliding_day(t: Inputs) -> DataFrame:
    rows = finished(streams.last_day(stream_of(t, "edm_live")), t)
    return rows.select(F.col("window.start").cast("timestamp_ntz").alias("window_start"), "company", "status", "n", "matched")


@query("t9_stream_without_repeats", ctes(["edm_live"]) + """
SELECT company, COUNT(*) AS n FROM (SELECT DISTINCT company, outlet_ngr, received_at FROM edm_live) GROUP BY company""")
def without_repeats(t: Inputs) -> DataFrame:
    feed = stream_of(t, "edm_live")
    twice = feed.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    rows = finished(streams.without_repeats(twice).select("company", "outlet_ngr", "received_at"), t)
    return rows.groupBy("company").agg(F.count("*").alias("n"))


@query("t10_discharge_sessions", ctes(["edm_live"], MARK) + """,
polls AS (SELECT *, CASE WHEN LAG(received_at) OVER w + INTERVAL 30 MINUTE > received_at THEN 0 ELSE 1 END AS fresh
          FROM edm_live WHERE LOWER(status) = 'discharging' WINDOW w AS (PARTITION BY company, outlet_ngr ORDER BY received_at)),
runs AS (SELECT *, SUM(fresh) OVER (PARTITION BY company, outlet_ngr ORDER BY received_at) AS run FROM polls),
sessions AS (SELECT company, outlet_ngr, MIN(received_at) AS first_seen, MAX(received_at) AS last_seen, COUNT(*) AS n_polls
             FROM runs GROUP BY company, outlet_ngr, run),
last AS (SELECT MAX(received_at) - INTERVAL 1 HOUR AS closed FROM edm_live WHERE LOWER(status) = 'discharging')
SELECT s.* FROM sessions s, last WHERE last_seen + INTERVAL 30 MINUTE <= last.closed""")
def sessions(t: Inputs) -> DataFrame:
    rows = finished(streams.discharge_sessions(stream_of(t, "edm_live")), t)
    return rows.select("company", "outlet_ngr", F.col("first_seen").cast("timestamp_ntz").alias("first_seen"),
                       F.col("last_seen").cast("timestamp_ntz").alias("last_seen"), "n_polls")


@query("t6_incremental_build_equals_full", ctes(["readings", "waterbodies"], RIVERS, MATCHED) + """
SELECT fww_id, wb_id, wfd_status, match_q FROM matched
WHERE match_q <> 'poor' AND nitrate_mid IS NOT NULL AND phosphate_mid IS NOT NULL""")
def incremental_build(t: Inputs) -> DataFrame:
    store = Warehouse(t.spark, new_folder(t.spark, "warehouse"))
    rows = written(t.readings.withColumns({
        "received_at": F.col("received_at").cast("timestamp"), "sample_date": F.col("sample_date").cast("timestamp")}), "readings")
    store.replace("staging_wfd", matrix.classified_rivers(t.waterbodies), "1998-01-01 00:00:00")
    early = F.col("received_at") <= F.lit("1998-06-01 00:00:00").cast("timestamp")
    store.append("staging_fww", rows.where(early))
    build.append_new(store, "1998-06-01 00:00:00")
    store.append("staging_fww", rows.where(~early))
    build.append_new(store, "2001-12-31 00:00:00")
    return store.read("feat_matrix").select("fww_id", "wb_id", "wfd_status", "match_q")


@query("t6_streaming_build_equals_full", ctes(["readings", "waterbodies"], RIVERS, MATCHED) + """
SELECT fww_id, wb_id, wfd_status, match_q FROM matched
WHERE match_q <> 'poor' AND nitrate_mid IS NOT NULL AND phosphate_mid IS NOT NULL""")
def streaming_build(t: Inputs) -> DataFrame:
    """Readings land in two parts; the stream builds the first, stops, and starts again for the second."""
    store = Warehouse(t.spark, new_folder(t.spark, "warehouse"))
    rows = written(t.readings.withColumns({
        "received_at": F.col("received_at").cast("timestamp"), "sample_date": F.col("sample_date").cast("timestamp")}), "readings")
    store.replace("staging_wfd", matrix.classified_rivers(t.waterbodies), "1998-01-01 00:00:00")
    checkpoint = new_folder(t.spark, "checkpoint")
    early = F.coalesce(F.col("received_at") <= F.lit("1998-06-01 00:00:00").cast("timestamp"), F.lit(False))
    for part in (early, ~early):
        store.append("staging_fww", rows.where(part))
        features.build_features(features.stored_stream(store), store, checkpoint).awaitTermination()
    return store.read("feat_matrix").select("fww_id", "wb_id", "wfd_status", "match_q")


@query("t10_open_and_ended_discharges", ctes(["edm_live"]) + """,
mark AS (SELECT epoch_ms(MAX(received_at)) - 3600000 AS w FROM edm_live),
polls AS (SELECT company, outlet_ngr, received_at AS t, BOOL_OR(LOWER(status) = 'discharging') AS discharging
          FROM edm_live, mark WHERE epoch_ms(received_at) < w GROUP BY ALL),
marked AS (SELECT *, LAG(t) OVER o AS before_t, LAG(discharging) OVER o AS before_on, LEAD(t) OVER o AS after_t, LEAD(discharging) OVER o AS after_on
           FROM polls WINDOW o AS (PARTITION BY company, outlet_ngr ORDER BY t)),
starts AS (SELECT *, CASE WHEN before_on AND t - before_t < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM marked WHERE discharging),
runs AS (SELECT *, SUM(fresh) OVER (PARTITION BY company, outlet_ngr ORDER BY t) AS run FROM starts)
SELECT company, outlet_ngr, MIN(t) AS first_seen, MAX(t) AS last_seen, COUNT(*) AS n_polls,
       CASE WHEN MAX_BY(after_t, t) IS NULL OR MAX_BY(after_t, t) - MAX(t) >= INTERVAL 30 MINUTE THEN
              CASE WHEN MAX_BY(after_t, t) IS NULL AND epoch_ms(MAX(t)) + 1800000 >= MIN(w) THEN 'open' ELSE 'silence' END
            ELSE 'change' END AS ended
FROM runs, mark GROUP BY company, outlet_ngr, run""")
def open_and_ended(t: Inputs) -> DataFrame:
    """The feed in four landings by time; the stream is started again after each and goes on from its checkpoint."""
    rows = t.edm_live.withColumn("received_at", F.col("received_at").cast("timestamp"))
    quarter = time_quarter(rows)
    landing, out = new_folder(t.spark, "landing"), new_folder(t.spark, "stream")
    for part in range(4):
        rows.where(quarter == part).write.mode("append").parquet(landing)
        found = discharges.discharge_states(t.spark.readStream.schema(rows.schema).parquet(landing))
        streams.write_stream(found, f"{out}/rows", f"{out}/checkpoint").awaitTermination()
    runs = discharges.current_discharges(t.spark.read.schema(found.schema).parquet(f"{out}/rows"))
    return runs.select("company", "outlet_ngr", F.col("first_seen").cast("timestamp_ntz").alias("first_seen"),
                       F.col("last_seen").cast("timestamp_ntz").alias("last_seen"), "n_polls", "ended")
