"""Left lookups against another source's rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def distinct_keys(df: DataFrame, key: Column, name: str) -> DataFrame:
    return df.select(key.alias(name)).filter(F.col(name).isNotNull()).distinct()


# Distinct values of the second join column; any small number above one works.
KEY_PARTS = 64


def splittable_join(
    df: DataFrame, lookup: DataFrame, left: str, right: str, how: str = "left"
) -> DataFrame:
    """Equi join in which a hot key of ``df`` can be split over many tasks.

    ``lookup`` was de-duplicated or grouped by its key, so it already lies in the
    partitions a join on that key needs, and Spark would join without another
    exchange. Adaptive execution splits a skewed partition only between two
    exchanges. A second join column, a digest of the key on both sides, asks for
    one: the narrow lookup moves once more and hot keys no longer bind one task.
    """
    part = lambda name: F.pmod(F.xxhash64(name), F.lit(KEY_PARTS))
    parted = df.withColumn("_left_part", part(left))
    narrow = lookup.withColumn("_right_part", part(right))
    same = (F.col(left) == F.col(right)) & (F.col("_left_part") == F.col("_right_part"))
    return parted.join(narrow, same, how).drop("_left_part", "_right_part")


def left_lookup(df: DataFrame, lookup: DataFrame, left: str, right: str) -> DataFrame:
    """Attach the columns of ``lookup`` (unique on ``right``) to ``df``.

    The lookup has at most one row per key, so no row of ``df`` is multiplied.
    There is no broadcast hint: Spark broadcasts a lookup whose measured size is
    under its threshold and otherwise sort-merges.
    """
    return splittable_join(df, lookup, left, right)


def rows_of_keys(
    parent: DataFrame, parent_key: Column, changes: DataFrame, change_key: Column
) -> DataFrame:
    """Only the parent rows that the changed rows refer to.

    There is no hint: Spark broadcasts the keys when they measure small, and the parent is then
    filtered where it is scanned.
    """
    keys = changes.select(change_key.alias("_wanted")).filter(F.col("_wanted").isNotNull())
    return parent.join(keys.distinct(), parent_key == F.col("_wanted"), "left_semi")
