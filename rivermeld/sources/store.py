"""Parquet warehouse: append, replace with snapshot, audit log, backup and row counts.

A replaced table is written to a new version folder; readers take the newest version that finished, so a
table can be replaced by a result computed from itself, and a lost job leaves the old version in place.
Appends go to one folder per batch: running a batch again replaces its own rows and nothing else.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rivermeld.sources.schemas import TABLES

#: Parts of a version after which they are written together.
COMPACT = 50


def at_time(as_of: str):
    return F.lit(as_of).cast("timestamp")


class Warehouse:
    """Tables of `schemas.TABLES` below one folder that all executors can reach."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    # ---- folders ---------------------------------------------------------------------------------
    def _files(self, path: str):
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark._jsc.hadoopConfiguration()), target

    def finished(self, path: str, prefix: str) -> list[str]:
        """Names of child folders with the prefix whose write finished, in name order."""
        files, marks = self._files(f"{path}/{prefix}*/_SUCCESS")
        # One listing by pattern, whatever the number of folders.
        return sorted(s.getPath().getParent().getName() for s in files.globStatus(marks) or [])

    @staticmethod
    def _version(folder: str) -> int:
        """The number of a version folder; rows added later lie in folders named version=<number>.<part>."""
        return int(folder.split("=")[1].split(".")[0])

    def _current(self, path: str) -> list[str]:
        """Folders of the newest version: the version itself and the parts added to it."""
        folders = self.finished(path, "version=")
        return [f for f in folders if self._version(f) == self._version(folders[-1])]

    def remove(self, path: str) -> None:
        files, target = self._files(path)
        files.delete(target, True)

    def create_tables(self) -> None:
        """Make the folders of all tables; does nothing for those that exist."""
        for name in TABLES:
            files, target = self._files(f"{self.root}/{name}")
            files.mkdirs(target)

    # ---- reading ---------------------------------------------------------------------------------
    def exists(self, name: str) -> bool:
        prefix = "version=" if TABLES[name].mode == "replace" else "batch="
        return bool(self.finished(f"{self.root}/{name}", prefix))

    def read(self, name: str) -> DataFrame:
        """Current rows of a table; an unwritten table is empty."""
        entry = TABLES[name]
        path = f"{self.root}/{name}"
        if entry.mode == "replace":
            chosen = self._current(path)
        else:
            chosen = self.finished(path, "batch=")
        if not chosen:
            return self.spark.createDataFrame([], entry.schema)
        schema = entry.schema
        if entry.day_of:
            schema = T.StructType([*schema.fields, T.StructField("day", T.DateType())])
        rows = self.spark.read.schema(schema).option("basePath", path).parquet(*[f"{path}/{c}" for c in chosen])
        return rows.select(*entry.schema.names)

    def read_days(self, name: str, first: str, last: str) -> DataFrame:
        """Rows of a day-partitioned table between two dates; files of other days are not read."""
        entry = TABLES[name]
        path = f"{self.root}/{name}"
        schema = T.StructType([*entry.schema.fields, T.StructField("day", T.DateType())])
        chosen = self.finished(path, "batch=")
        if not chosen:
            return self.spark.createDataFrame([], entry.schema)
        rows = self.spark.read.schema(schema).option("basePath", path).parquet(*[f"{path}/{c}" for c in chosen])
        wanted = F.col("day").between(F.lit(first).cast("date"), F.lit(last).cast("date"))
        return rows.where(wanted).select(*entry.schema.names)

    def read_batch(self, name: str, batch: str) -> DataFrame:
        """Rows one batch appended."""
        entry = TABLES[name]
        return self.spark.read.schema(entry.schema).parquet(f"{self.root}/{name}/batch={batch}").select(
            *entry.schema.names)

    def batch_rows(self, name: str, batch: str) -> int:
        """Rows one batch appended, from the file footers."""
        return self.spark.read.parquet(f"{self.root}/{name}/batch={batch}").count()

    # ---- writing ---------------------------------------------------------------------------------
    def _conform(self, name: str, df: DataFrame) -> DataFrame:
        """The table's columns by name and type; columns the frame lacks become null."""
        present = set(df.columns)
        return df.select(*[
            (F.col(f.name) if f.name in present else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in TABLES[name].schema.fields])

    def _write(self, name: str, df: DataFrame, path: str) -> None:
        entry = TABLES[name]
        rows = self._conform(name, df)
        if entry.day_of:
            # Rows of one day from all tasks meet in files of the advised size: adaptive execution splits large days
            # over as many writers as their bytes need and joins small ones.
            rows = rows.withColumn("day", F.to_date(entry.day_of)).hint("rebalance", "day")
            rows.write.mode("overwrite").partitionBy("day").parquet(path)
        else:
            rows.write.mode("overwrite").parquet(path)

    def append(self, name: str, df: DataFrame, as_of: str | None = None, batch: str | None = None) -> None:
        """Append rows as one batch, stamping received_at or loaded_at when given a time."""
        stamp = next((c for c in ("received_at", "loaded_at") if c in TABLES[name].schema.names), None)
        if as_of is not None and stamp:
            df = df.withColumn(stamp, at_time(as_of))
        self._write(name, df, f"{self.root}/{name}/batch={batch or uuid.uuid4().hex}")

    def snapshot(self, name: str, as_of: str) -> bool:
        """Copy current rows to the history table, matched by name; an empty table is skipped."""
        history = TABLES[name].history
        current = self.read(name)
        if history is None or current.isEmpty():
            return False
        self.append(history, current.withColumn("snapshot_at", at_time(as_of)))
        return True

    def replace(self, name: str, df: DataFrame, as_of: str) -> None:
        """Snapshot the current rows if the table keeps history, then publish a new version."""
        self.snapshot(name, as_of)
        names = TABLES[name].schema.names
        stamp = next((c for c in ("loaded_at", "recorded_at") if c in names), None)
        if stamp:
            df = df.withColumn(stamp, at_time(as_of))
        versions = self.finished(f"{self.root}/{name}", "version=")
        number = self._version(versions[-1]) + 1 if versions else 0
        self._write(name, df, f"{self.root}/{name}/version={number:08d}")

    def extend(self, name: str, df: DataFrame, as_of: str, batch: str | None = None) -> int:
        """Add rows to a replaced table and return their number.

        Only the new rows are written, as a part of the current version; after `COMPACT` parts the version and its
        parts become a new version. A part of a named batch carries that name, and so does a version it went into,
        until the next batch; `holds` finds it.
        """
        stamp = next((c for c in ("loaded_at", "recorded_at") if c in TABLES[name].schema.names), None)
        if stamp:
            df = df.withColumn(stamp, at_time(as_of))
        path = f"{self.root}/{name}"
        folders = self.finished(path, "version=")
        current = self._current(path) if folders else []
        number = self._version(current[-1]) if current else 0
        if batch:
            folder = f"{path}/version={number:08d}.{batch}"
        else:
            folder = f"{path}/version={number:08d}.{len(current):06d}" if current else f"{path}/version={0:08d}"
        self._write(name, df, folder)
        added = self.spark.read.schema(TABLES[name].schema).parquet(folder).count()
        if len(current) >= COMPACT:
            owner = "" if not batch else f".joined-{batch}" if self.has_other_parts(name) else f".{batch}"
            self._write(name, self.read(name), f"{path}/version={number + 1:08d}{owner}")
        return added

    def _parts(self, name: str) -> list[str]:
        """What follows the number in the folder names of the current version; empty for a version written whole."""
        path = f"{self.root}/{name}"
        folders = self._current(path) if self.finished(path, "version=") else []
        return [f.partition(".")[2] for f in folders]

    def holds(self, name: str, batch: str) -> bool:
        """Whether the rows of the named batch are in the current version."""
        return any(p in (batch, f"joined-{batch}") for p in self._parts(name))

    def has_other_parts(self, name: str, prefix: str = "stream-") -> bool:
        """Whether the current version has rows that no named batch of this prefix alone has written."""
        return any(not p.startswith(prefix) for p in self._parts(name))

    def prune(self, name: str, keep: int = 2) -> int:
        """Remove all but the newest `keep` versions of a replaced table; returns how many folders went."""
        path = f"{self.root}/{name}"
        folders = self.finished(path, "version=")
        numbers = sorted({self._version(f) for f in folders})[-keep:]
        old = [f for f in folders if self._version(f) not in numbers]
        for folder in old:
            self.remove(f"{path}/{folder}")
        return len(old)

    def drop_days(self, name: str, before: str) -> int:
        """Remove the day folders of a day-partitioned table that lie before a date; returns how many went."""
        if not TABLES[name].day_of:
            raise ValueError(f"{name} has no days")
        files, days = self._files(f"{self.root}/{name}/batch=*/day=*")
        found = [(s.getPath().getName().split("=")[1], s.getPath()) for s in files.globStatus(days) or []]
        old = [at for day, at in found if day < before[:10]]  # days without a date sort behind all dates
        for at in old:
            files.delete(at, True)
        return len(old)

    def retain_days(self, name: str, as_of: str, days: int) -> DataFrame:
        """Rows of the last `days` days of a day-partitioned table, as the retention run keeps them."""
        column = TABLES[name].day_of
        floor = at_time(as_of) - F.expr(f"INTERVAL {int(days)} DAYS")
        return self.read(name).where(F.col(column) >= floor)

    # ---- audit -----------------------------------------------------------------------------------
    def log_run(self, source: str, fetched: int, new: int, status: str, as_of: str,
                error: str | None = None, batch: str | None = None) -> None:
        row = self.spark.range(1).select(
            F.lit(source).alias("source"), F.lit(int(fetched)).alias("records_fetched"),
            F.lit(int(new)).alias("records_new"), F.lit(status).alias("status"),
            F.lit(error).cast("string").alias("error_msg"), at_time(as_of).alias("run_at"))
        self.append("ingestion_log", row.coalesce(1), batch=batch)

    def row_counts(self) -> DataFrame:
        """Rows of every table; unwritten tables count zero."""
        counts = [self.read(name).agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n")
                  for name in TABLES]
        return reduce(DataFrame.unionByName, counts)

    def backup(self, stamp: str) -> str:
        """Copy every table's current rows below snapshots/<stamp>."""
        target = f"{self.root}/snapshots/{stamp}"
        for name in TABLES:
            self.read(name).write.mode("overwrite").parquet(f"{target}/{name}")
        return target
