"""Type-2 dimension versioning as functions of (old dimension, staged batch).

Spark has no row-level MERGE on plain files, so a merge is a pure function that
returns the new state. ``source`` frames hold at most one row per identifier:
the staged batch after de-duplication. ``key`` is the natural identifier.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VERSION_COLUMNS = ["valid_from", "valid_to", "is_current", "hash_diff", "source_updated_at"]


def _staged_marks(staged: DataFrame, key: str) -> DataFrame:
    return staged.select(
        F.col(key).alias("_key"),
        F.col("hash_diff").alias("_hash"),
        F.col("source_updated_at").alias("_updated"),
    )


def _supersedes() -> Column:
    """The staged row changes the tracked attributes and is strictly newer."""
    return F.coalesce(
        (F.col("_hash") != F.col("hash_diff"))
        & (F.col("_updated") > F.col("source_updated_at"))
        & (F.col("_updated") > F.col("valid_from")),
        F.lit(False),
    )


def current_rows(dimension: DataFrame) -> DataFrame:
    return dimension.filter(F.col("is_current"))


def scd2_closes(dimension: DataFrame, staged: DataFrame, key: str) -> DataFrame:
    """Current rows that the batch ends, with their new end."""
    marks = _staged_marks(staged, key)
    return (
        current_rows(dimension)
        .join(marks, F.col(key) == F.col("_key"))
        .filter(_supersedes())
        .withColumn("valid_to", F.col("_updated"))
        .withColumn("is_current", F.lit(False))
        .drop("_key", "_hash", "_updated")
    )


def scd2_inserts(dimension: DataFrame, staged: DataFrame, key: str) -> DataFrame:
    """Staged rows that become the current version of their identifier.

    These are identifiers without a current row once the closes are applied. The
    first version starts at the source's creation time, later ones at its update
    time. Only a narrow (identifier, flag) frame of the dimension takes part.
    """
    versions = dimension.select(
        F.col(key).alias("_key"), "is_current", "hash_diff", "source_updated_at", "valid_from"
    )
    marks = _staged_marks(staged, key).withColumnRenamed("_key", "_staged_key")
    known = (
        versions.join(marks, F.col("_key") == F.col("_staged_key"))
        .groupBy("_key")
        .agg(F.bool_or(F.col("is_current") & ~_supersedes()).alias("_stays_current"))
    )
    return (
        staged.join(known, F.col(key) == F.col("_key"), "left")
        .filter(~F.coalesce("_stays_current", F.lit(False)))
        .withColumn(
            "valid_from",
            F.when(F.col("_key").isNotNull(), F.col("source_updated_at")).otherwise(
                F.col("valid_from")
            ),
        )
        .withColumn("valid_to", F.lit(None).cast("timestamp_ntz"))
        .withColumn("is_current", F.lit(True))
        .drop("_key", "_stays_current")
    )


def scd2_existing(dimension: DataFrame, staged: DataFrame, key: str) -> DataFrame:
    """All old rows of the dimension after the closes, in one pass over it.

    The join keeps every dimension row once, and its other side is the staged
    batch: when that is small Spark broadcasts it and the dimension stays put.
    """
    marks = _staged_marks(staged, key)
    closes = F.col("is_current") & _supersedes()
    return (
        dimension.join(marks, (F.col(key) == F.col("_key")) & F.col("is_current"), "left")
        .withColumn("_closes", closes)
        .withColumn("valid_to", F.when(F.col("_closes"), F.col("_updated")).otherwise(F.col("valid_to")))
        .withColumn("is_current", F.col("is_current") & ~F.col("_closes"))
        .drop("_key", "_hash", "_updated", "_closes")
    )


def scd2_apply(dimension: DataFrame, staged: DataFrame, key: str) -> DataFrame:
    """The dimension after the batch (rows without the surrogate key)."""
    inserts = scd2_inserts(dimension, staged, key)
    return scd2_existing(dimension, staged, key).unionByName(inserts, allowMissingColumns=True)


def uniqueness_conflicts(
    staged: DataFrame, dimension: DataFrame, key: str, normalized: Column
) -> DataFrame:
    """Values claimed by two identifiers, inside the batch or against current rows.

    One row per (value, place of the conflict). Both sides shrink to the lowest
    and highest identifier per value before they meet, so a value shared by very
    many rows is never paired up.
    """

    def span(df: DataFrame, prefix: str) -> DataFrame:
        return (
            df.select(normalized.alias("value"), F.col(key).alias("_id"))
            .filter(F.col("value").isNotNull())
            .groupBy("value")
            .agg(F.min("_id").alias(f"{prefix}_low"), F.max("_id").alias(f"{prefix}_high"))
        )

    incoming = span(staged, "_in")
    held = span(current_rows(dimension), "_held")
    inside = incoming.filter(F.col("_in_low") != F.col("_in_high")).select(
        "value", F.lit("batch").alias("conflict")
    )
    same_single_owner = (
        (F.col("_in_low") == F.col("_in_high"))
        & (F.col("_held_low") == F.col("_held_high"))
        & (F.col("_in_low") == F.col("_held_low"))
    )
    against = (
        incoming.join(held, "value")
        .filter(~same_single_owner)
        .select("value", F.lit("current").alias("conflict"))
    )
    return inside.unionByName(against)


def version_columns(attributes: Sequence[str], key: str) -> list[str]:
    return [key, *attributes, *VERSION_COLUMNS, "batch_id"]
