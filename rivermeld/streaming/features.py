"""Feature build as a stream: stored readings, batch by batch, against the stored reference tables.

A batch of readings is matched and widened by the same full build as a whole table and becomes one part of the matrix.
The part carries the batch's key in its name, so rows and the note that the batch is done appear together: a batch run
again after a failure finds its part and adds nothing. Work grows with the readings of the batch. Only while the matrix
holds rows that this stream did not write (a full rebuild or an append) are the batch's keys compared with the stored
ones, and readings already there are left out.

Defined cases: readings without chemistry, and those the build finds invalid, are read once and leave no row; a batch
without valid rows leaves an empty part; readings that land twice in staging come twice, as in a full build; readings
without a time of receipt are taken like others. Staged batches must not be written again under their old name, as
Spark would deliver their new files once more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from rivermeld.plans.build import full_build
from rivermeld.settings import CHEMISTRY, LAND
from rivermeld.session import new_folder
from rivermeld.sources.schemas import TABLES
from rivermeld.sources.store import Warehouse
from rivermeld.streaming.live import now


def stored_stream(store: Warehouse, name: str = "staging_fww", files_per_batch: int = 1000) -> DataFrame:
    """Rows of an appended table as a stream, in the order in which their files landed."""
    names = TABLES[name].schema.names
    return (store.spark.readStream.schema(TABLES[name].schema).option("maxFilesPerTrigger", files_per_batch)
            .parquet(f"{store.root}/{name}").select(*names))


def add_batch(store: Warehouse, readings: DataFrame, key: str, as_of: str, cells: DataFrame | None = None) -> int:
    """Add the matrix rows of one batch of readings unless the batch is in the matrix; returns the rows it added."""
    if store.holds("feat_matrix", key):
        return 0
    fresh = readings.na.drop(subset=CHEMISTRY)
    if store.has_other_parts("feat_matrix"):
        # The batch is the small side: its keys go out, and the matrix gives up one column.
        known = store.read("feat_matrix").select("fww_id").join(fresh.select("fww_id").distinct(), "fww_id", "left_semi")
        fresh = fresh.join(known.distinct(), "fww_id", "left_anti")
    stored_land = store.read("staging_lc").select("fww_id", *LAND) if store.exists("staging_lc") else None
    built = full_build(fresh, store.read("staging_wfd"), store.read("staging_edm_historical"), cells, stored_land)
    return store.extend("feat_matrix", built, as_of, key)


def build_features(readings: DataFrame, store: Warehouse, checkpoint: str, cells: DataFrame | None = None,
                   every: str | None = None) -> StreamingQuery:
    """Start the build over a stream of readings. Without `every` it takes what has landed and stops."""

    def step(batch: DataFrame, batch_id: int) -> None:
        key = f"stream-{batch_id:012d}"
        folder = new_folder(store.spark, "batch-readings")
        try:
            batch.write.parquet(folder)  # the source is read once; counting and building read this copy
            landed = store.spark.read.schema(batch.schema).parquet(folder)
            added = add_batch(store, landed, key, now(), cells)
            store.log_run("feature_engineering", landed.count(), added, "success", now(), batch=f"features-{key}")
        except Exception as error:
            store.log_run("feature_engineering", 0, 0, "failed", now(), str(error)[:500], batch=f"features-{key}")
            raise
        finally:
            store.remove(folder)

    return (readings.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
            .trigger(**({"processingTime": every} if every else {"availableNow": True})).start())
