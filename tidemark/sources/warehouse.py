"""Staging, quarantine and warehouse tables as partitioned parquet folders.

All folders live below one root that driver and executors share. Staging and quarantine replace a
batch's folder by Spark's dynamic partition overwrite; dimensions and facts are :mod:`snapshots`.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.snapshots import NumberedFiles, SnapshotTable, reserve_range

LAYOUT = "buckets int"


@dataclass(frozen=True)
class Warehouse:
    """Tables below ``root``; dimensions are cut into ``buckets`` by identifier."""

    spark: SparkSession
    root: str
    buckets: int = 64

    # --- folders -----------------------------------------------------------

    def path(self, area: str, name: str) -> str:
        return f"{self.root.rstrip('/')}/{area}/{name}"

    def checkpoint_fallback(self) -> str:
        return f"{self.root.rstrip('/')}/_checkpoints"

    def _file_system(self, path: str):
        jvm = self.spark._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        return target, target.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def exists(self, path: str) -> bool:
        target, files = self._file_system(path)
        return files.exists(target)

    def delete(self, path: str) -> None:
        target, files = self._file_system(path)
        files.delete(target, True)

    def read(self, area: str, name: str, schema: str) -> DataFrame:
        """The table, or an empty frame of the same shape before the first write."""
        path = self.path(area, name)
        empty = self.spark.createDataFrame([], schema)
        if not self.exists(path):
            return empty
        return self.spark.read.schema(schema).parquet(path).select(*empty.columns)

    def check_layout(self) -> None:
        """Store the bucket count with the warehouse; refuse another one than it was made with.

        Rows of one identifier are looked for in one bucket, so a different count would miss them.
        """
        stored = self.read("warehouse", "layout", LAYOUT).agg(F.max("buckets").alias("n")).first().n
        if stored is None:
            self.spark.createDataFrame([(self.buckets,)], LAYOUT).coalesce(1).write.mode(
                "append").parquet(self.path("warehouse", "layout"))
        elif stored != self.buckets:
            raise ValueError(f"the warehouse has {stored} buckets, not {self.buckets}")

    def bucket(self, identifier: str) -> Column:
        return F.pmod(F.xxhash64(identifier), F.lit(self.buckets)).cast("int")

    def table(self, name: str) -> SnapshotTable:
        """A dimension or fact: files that never change, behind one committed manifest."""
        return SnapshotTable(self.spark, self.path("warehouse", name))

    def reserve_keys(self, table: str, count: int) -> int:
        """Reserve ``count`` surrogate keys and return the last one used before them.

        A reservation stands before the rows that use it, and only one writer can make the next one, so keys
        are never handed out twice: not after a failed batch, and not to two batches at a time. The
        table itself need not be scanned for its maximum.
        """
        return reserve_range(NumberedFiles(self.spark, self.path("warehouse", f"key_range/{table}")), count)

    # --- batches: staging and quarantine -----------------------------------

    def append_batch(self, df: DataFrame, area: str, name: str) -> None:
        df.write.mode("append").partitionBy("batch_id").parquet(self.path(area, name))

    def replace_batch(self, df: DataFrame, area: str, name: str) -> None:
        """Write one batch so that writing it again leaves a single copy."""
        self._overwrite_partitions(df, self.path(area, name), "batch_id")

    def purge_batch(self, area: str, name: str, batch_id: str) -> None:
        """Delete one batch's folder, under the name that Spark's writer gave it."""
        escape = self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
        self.delete(f"{self.path(area, name)}/batch_id={escape(batch_id)}")

    @staticmethod
    def _overwrite_partitions(df: DataFrame, path: str, column: str) -> None:
        (
            df.write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy(column)
            .parquet(path)
        )


def purge_rows(staged: DataFrame, batch_id: str) -> DataFrame:
    """Staging without one merged batch, as a relation."""
    return staged.filter(F.col("batch_id") != batch_id)


def stage_projection(df: DataFrame, columns: Iterable[str], batch_id: str) -> DataFrame:
    """The staging contract: batch id first, then the entity's columns."""
    return df.select(F.lit(batch_id).alias("batch_id"), *columns)
