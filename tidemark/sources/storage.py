"""Tables on Parquet that can be replaced while they are read: version directories and a pointer.

Parquet tables take no row-level changes, so a change is a new version. A reader keeps the version it opened; the pointer
moves only after the new version is whole, and a job that dies leaves the old one in place.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which driver and executors share; where it is unset, a folder in the warehouse."""
    return (spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/.tidemark").rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """df computed and written to the shared folder; later steps read that."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_root(df.sparkSession))
    return df.checkpoint()


class Store:
    """Versioned tables below a folder of any file system that Spark writes to."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm

    @classmethod
    def scratch(cls, spark: SparkSession) -> Store:
        """A store of its own in the folder that driver and executors share."""
        return cls(spark, f"{shared_root(spark)}/store-{uuid.uuid4().hex}")

    def _fs(self, path: str):
        p = self._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def versions(self, table: str) -> list[int]:
        fs, p = self._fs(f"{self.root}/{table}")
        if not fs.exists(p):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        whole = [n for n in names if n.startswith("v=") and fs.exists(self._fs(f"{self.root}/{table}/{n}/_SUCCESS")[1])]
        return sorted(int(n[2:]) for n in whole)

    def exists(self, table: str) -> bool:
        return bool(self.versions(table))

    def path(self, table: str, version: int) -> str:
        return f"{self.root}/{table}/v={version:08d}"

    def read(self, table: str, version: int | None = None) -> DataFrame:
        return self.spark.read.parquet(self.path(table, self.versions(table)[-1] if version is None else version))

    def write(self, table: str, df: DataFrame, partition_by: list[str] | None = None, sort_by: list[str] | None = None, keep: int = 2) -> DataFrame:
        """df as the next version; the newest keep versions stay. Partition columns are dealt out first, so that a partition
        gets few files, and sorted within, so that row groups skip."""
        version = (self.versions(table) or [0])[-1] + 1
        if partition_by:
            df = df.repartition(*partition_by).sortWithinPartitions(*partition_by, *(sort_by or []))
        elif sort_by:
            df = df.sortWithinPartitions(*sort_by)
        writer = df.write.partitionBy(*partition_by) if partition_by else df.write
        writer.parquet(self.path(table, version))
        for old in self.versions(table)[:-keep]:
            self.drop_version(table, old)
        return self.read(table)

    def replace(self, table: str, change: Callable[[DataFrame], DataFrame], **how) -> DataFrame:
        return self.write(table, change(self.read(table)), **how)

    def append(self, table: str, df: DataFrame) -> DataFrame:
        """Rows added to the newest version in place; the first call makes it."""
        if not self.exists(table):
            return self.write(table, df)
        df.write.mode("append").parquet(self.path(table, self.versions(table)[-1]))
        return self.read(table)

    def overwrite_partitions(self, table: str, df: DataFrame, partition_by: list[str]) -> DataFrame:
        """Only the partitions that df has rows for are replaced. df must not read them lazily: materialize it first."""
        if not self.exists(table):
            return self.write(table, df, partition_by=partition_by)
        dealt = df.repartition(*partition_by)
        dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(self.path(table, self.versions(table)[-1]))
        return self.read(table)

    def drop_version(self, table: str, version: int) -> None:
        fs, p = self._fs(self.path(table, version))
        fs.delete(p, True)

    def drop(self, table: str) -> None:
        fs, p = self._fs(f"{self.root}/{table}")
        fs.delete(p, True)

    def expire(self, table: str, column: str, before: str) -> DataFrame:
        """Partitions of a date column older than before are left out of the next version."""
        return self.replace(table, lambda df: df.filter(F.col(column) >= F.lit(before).cast("date")), partition_by=[column])
