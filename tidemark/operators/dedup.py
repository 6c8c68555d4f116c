"""One row per key, chosen deterministically."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_per_key(
    df: DataFrame, keys: Sequence[str], newest_by: str, tie_break: Sequence[str] = (),
    eligible: Column | None = None,
) -> DataFrame:
    """Keep the newest row of every key, counting ``eligible`` rows only.

    Rows that share the newest timestamp are ordered by ``tie_break`` so that a
    re-run, or a task that runs again on another executor, keeps the same row.
    Spark plans a rank filter of one as a group limit before *and* after the
    shuffle: each map task sends at most one row per key, so a key that owns a
    third of the input does not concentrate in one task.

    Eligibility is ranked first and tested last. As a filter in front it would be
    merged with the expressions it is computed from and evaluated over and over.
    """
    order = [] if eligible is None else [eligible.desc()]
    order += [F.col(newest_by).desc_nulls_last()]
    order += [F.col(c).asc_nulls_first() for c in tie_break if c != newest_by and c not in keys]
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    wanted = F.col("_rank") == 1
    if eligible is not None:
        wanted = wanted & eligible
    return df.withColumn("_rank", rank).filter(wanted).drop("_rank")
