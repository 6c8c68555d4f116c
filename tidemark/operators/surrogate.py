"""Surrogate keys: dense, increasing from the current maximum, repeatable."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Hex digits of the digest that name a numbering bucket: 16 ** 3 = 4096 buckets.
BUCKET_DIGITS = 3


def number_bucket(order_by: Sequence[str], digits: int = BUCKET_DIGITS) -> Column:
    """Bucket of a row, from its values alone.

    Range partitions are sampled and may be cut differently when a plan runs a
    second time; a digest of the row is the same on every executor and re-run.
    It covers the whole ordering, so one hot identifier spreads over buckets.
    """
    text = F.concat_ws("|", *[F.col(c).cast("string") for c in order_by])
    return F.substring(F.md5(text), 1, digits)


def bucket_offsets(rows: DataFrame, order_by: Sequence[str], digits: int = BUCKET_DIGITS) -> DataFrame:
    """How many rows precede each bucket; at most ``16 ** digits`` rows."""
    earlier = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    return (
        rows.groupBy(number_bucket(order_by, digits).alias("_bucket"))
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select("_bucket", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_offset"))
    )


def assign_keys(
    rows: DataFrame, key_column: str, order_by: Sequence[str], after: int | Column = 0,
    digits: int = BUCKET_DIGITS,
) -> DataFrame:
    """Number ``rows`` from ``after + 1`` without gaps.

    ``order_by`` must identify a row. Rows are ranked inside their bucket in
    parallel; the only unpartitioned window sees the bucket counts.
    """
    offsets = bucket_offsets(rows, order_by, digits).withColumnRenamed("_bucket", "_offset_bucket")
    rank = F.row_number().over(Window.partitionBy("_bucket").orderBy(*order_by))
    base = F.lit(after) if isinstance(after, int) else after
    return (
        rows.withColumn("_bucket", number_bucket(order_by, digits))
        .withColumn("_rank", rank)
        .join(F.broadcast(offsets), F.col("_bucket") == F.col("_offset_bucket"))
        .withColumn(key_column, (base + F.col("_offset") + F.col("_rank")).cast("long"))
        .drop("_bucket", "_offset_bucket", "_rank", "_offset")
    )


def highest_key(table: DataFrame, key_column: str) -> int:
    """Current maximum, 0 for an empty table."""
    return table.agg(F.coalesce(F.max(key_column), F.lit(0)).alias("top")).first()["top"]
