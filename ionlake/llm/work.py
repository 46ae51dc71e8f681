"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

class Workspace:
    """Writes tables under spark.checkpoint.dir, or in the warehouse where that
    is unset, so that lineage ends there and a lost executor costs at most the
    stage in hand.  Folders go when dropped, or at the latest when the driver's
    file systems close."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
        if base.startswith("file:/") and not base.startswith("file://"):
            base = f"file://{base[5:]}"  # the form that readers outside the JVM know
        self.dir = f"{base.rstrip('/')}/ws-{uuid.uuid4().hex}"
        self.n = 0
        jvm = spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.dir)
        self.fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        self.fs.mkdirs(path)
        self.fs.deleteOnExit(path)

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.dir}/{self.n:03d}-{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """The same rows, written once and read back."""
        path = self.path(name)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.kept_at = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Deletes tables that no later plan reads."""
        for df in frames:
            self.fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(df.kept_at), True)
