"""Saved scoring models: versions below one folder, the newest finished one is current."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import SparkSession


class ModelStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def versions(self, kind: str) -> list[str]:
        """Version names of one model type, oldest first; unfinished saves are left out."""
        paths = self.spark._jvm.org.apache.hadoop.fs.Path
        folder = paths(f"{self.root}/{kind}")
        files = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(folder):
            return []
        names = [s.getPath().getName() for s in files.listStatus(folder)]
        done = [n for n in names if n.startswith("version=")
                and files.exists(paths(f"{self.root}/{kind}/{n}/finished/_SUCCESS"))]
        return sorted(n.split("=", 1)[1] for n in done)

    def save(self, model: PipelineModel, kind: str, as_of: str) -> str:
        """Save a new version; older versions stay as backups."""
        version = as_of.replace(" ", "T").replace(":", "")
        path = f"{self.root}/{kind}/version={version}"
        model.write().overwrite().save(path)
        self.spark.range(1).coalesce(1).write.mode("overwrite").parquet(f"{path}/finished")
        return version

    def load(self, kind: str, version: str | None = None) -> PipelineModel:
        known = self.versions(kind)
        if not known:
            raise FileNotFoundError(f"no saved {kind} model below {self.root}")
        return PipelineModel.load(f"{self.root}/{kind}/version={version or known[-1]}")
