"""Cutting lineage through tables written in the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names, else the one set on the
    context. Where neither is set, a session within one process (local master, as
    in tests) gets a folder of its own; on a cluster that is an error, as a folder
    of one machine would not be seen by the executors."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir is not set: it must name a folder that all executors share")
    path = tempfile.mkdtemp(prefix="strataq-checkpoint-")
    spark.sparkContext.setCheckpointDir(path)
    return path


class Scratch:
    """Tables written to the shared folder by one operator call.

    ``put`` writes a DataFrame as parquet and returns it read back, so that the
    plan restarts from files every executor can reach. ``drop`` deletes a table
    that no later plan reads, ``clear`` all of them.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self._tables: list[tuple[DataFrame, str]] = []
        self._n = 0

    def put(self, df: DataFrame, *partition_by: str) -> DataFrame:
        self._n += 1
        path = f"{self.root}/{self._n}"
        (df.write.partitionBy(*partition_by) if partition_by else df.write).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._tables.append((out, path))
        return out

    def drop(self, *tables: DataFrame | None) -> None:
        for path in [p for t, p in self._tables if any(t is x for x in tables)]:
            self._delete(path)
        self._tables = [(t, p) for t, p in self._tables if not any(t is x for x in tables)]

    def clear(self) -> None:
        self._delete(self.root)
        self._tables = []

    def _delete(self, path: str) -> None:
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
