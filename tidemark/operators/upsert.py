"""Newer-wins upsert of facts as functions of (old fact, resolved batch).

``incoming`` holds one row per source id with all surrogate keys resolved. The
fact's own surrogate key survives an update.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _overwrites(key_columns: Sequence[str]) -> Column:
    """Newer source row, or an equally old one that resolves a key differently."""
    repaired = reduce(
        lambda a, b: a | b, [F.col(f"_in_{k}") != F.col(k) for k in key_columns], F.lit(False)
    )
    newer = F.col("_in_updated") > F.col("source_updated_at")
    replay = F.col("_in_updated") == F.col("source_updated_at")
    return newer | (replay & repaired)


def _marks(incoming: DataFrame, source_id: str, key_columns: Sequence[str]) -> DataFrame:
    return incoming.select(
        F.col(source_id).alias("_in_id"),
        F.col("source_updated_at").alias("_in_updated"),
        *[F.col(k).alias(f"_in_{k}") for k in key_columns],
    )


def fact_hits(
    fact: DataFrame, incoming: DataFrame, source_id: str, key_columns: Sequence[str],
    keep: Sequence[str] = (),
) -> DataFrame:
    """One row per incoming id that the fact already holds.

    ``_overwrite`` says whether the incoming row replaces it; ``keep`` columns of
    the fact (its surrogate key, its partition) ride along. Only those, the id,
    the timestamp and the keys are read from the fact.
    """
    narrow = fact.select(
        source_id, "source_updated_at", *[c for c in dict.fromkeys([*key_columns, *keep])]
    )
    return (
        narrow.join(
            _marks(incoming, source_id, key_columns), F.col(source_id) == F.col("_in_id")
        )
        .withColumn("_overwrite", _overwrites(key_columns))
        .select(source_id, *[c for c in keep if c != source_id], "_overwrite")
    )


def fact_updates(
    fact: DataFrame, incoming: DataFrame, source_id: str, key_columns: Sequence[str],
    surrogate: str | None = None,
) -> DataFrame:
    """Incoming rows that replace a stored row, carrying its surrogate key."""
    keep = [surrogate] if surrogate else []
    hits = (
        fact_hits(fact, incoming, source_id, key_columns, keep)
        .groupBy(F.col(source_id).alias("_hit_id"))
        .agg(
            F.bool_or("_overwrite").alias("_overwrite"),
            *[F.min(c).alias(c) for c in keep],
        )
        .filter("_overwrite")
        .drop("_overwrite")
    )
    return incoming.join(hits, F.col(source_id) == F.col("_hit_id")).drop("_hit_id")


def fact_inserts(fact: DataFrame, incoming: DataFrame, source_id: str) -> DataFrame:
    known = fact.select(F.col(source_id).alias("_known_id"))
    return incoming.join(known, F.col(source_id) == F.col("_known_id"), "left_anti")


def fact_upsert(
    fact: DataFrame, incoming: DataFrame, source_id: str, key_columns: Sequence[str],
    surrogate: str | None = None,
) -> DataFrame:
    """The fact after the batch; inserted rows have no surrogate key yet."""
    updates = fact_updates(fact, incoming, source_id, key_columns, surrogate)
    replaced = updates.select(F.col(source_id).alias("_replaced_id"))
    kept = fact.join(replaced, F.col(source_id) == F.col("_replaced_id"), "left_anti")
    inserts = fact_inserts(fact, incoming, source_id)
    return kept.unionByName(updates).unionByName(inserts, allowMissingColumns=True)
