"""Relational tables over JDBC."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from tidemark.sources.windows import incremental_window, watermark_value


def checked_identifier(name: str) -> str:
    """Names end up in SQL text: letters, digits and underscores only."""
    if not name.replace("_", "").isalnum():
        raise ValueError(f"invalid identifier: {name!r}")
    return name


@dataclass(frozen=True)
class RelationalSource:
    """Connection of a JDBC source. ``quote`` is its identifier quote."""

    url: str
    driver: str
    options: dict[str, str] = field(default_factory=dict)
    quote: str = ""

    def _quoted(self, name: str) -> str:
        return f"{self.quote}{checked_identifier(name)}{self.quote}"

    def _load(self, spark: SparkSession, **options: str) -> DataFrame:
        return (
            spark.read.format("jdbc")
            .options(url=self.url, driver=self.driver, **self.options, **options)
            .load()
        )

    def read(
        self, spark: SparkSession, table: str, partition_column: str | None = None,
        partitions: int = 1,
    ) -> DataFrame:
        """Whole table; with a numeric or time ``partition_column`` in parallel ranges."""
        target = self._quoted(table)
        if partition_column is None or partitions < 2:
            return self._load(spark, dbtable=target)
        column = self._quoted(partition_column)
        bounds = self._load(
            spark,
            query=f"SELECT MIN({column}) AS low, MAX({column}) AS high FROM {target}",
        ).first()
        if bounds[0] is None:
            return self._load(spark, dbtable=target)
        return self._load(
            spark,
            dbtable=target,
            partitionColumn=checked_identifier(partition_column),
            lowerBound=str(bounds[0]),
            upperBound=str(bounds[1]),
            numPartitions=str(partitions),
        )

    def high_watermark(self, spark: SparkSession, table: str, column: str) -> datetime | None:
        """Largest value of ``column``; the database computes it."""
        query = f"SELECT MAX({self._quoted(column)}) AS watermark_to FROM {self._quoted(table)}"
        return watermark_value(self._load(spark, query=query).toDF("watermark_to"))

    def read_window(
        self, spark: SparkSession, table: str, column: str, lower: datetime | None,
        upper: datetime | None, partition_column: str | None = None, partitions: int = 1,
    ) -> DataFrame:
        """Incremental window; Spark pushes the two comparisons into the database."""
        checked_identifier(column)
        rows = self.read(spark, table, partition_column, partitions)
        return incremental_window(rows, column, lower, upper)
