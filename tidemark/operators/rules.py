"""Row rules: the first violated rule names the reason a row is rejected."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REASON = "rejection_reason"


@dataclass(frozen=True)
class Rule:
    reason: str
    violated: Column


def reason_of(rules: Sequence[Rule]) -> Column:
    """First matching reason, NULL when the row is valid."""
    return F.coalesce(*[F.when(rule.violated, F.lit(rule.reason)) for rule in rules])


def assign_reason(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    return df.withColumn(REASON, reason_of(rules))


def valid_rows(checked: DataFrame) -> DataFrame:
    return checked.filter(F.col(REASON).isNull())


def rejected_rows(checked: DataFrame) -> DataFrame:
    return checked.filter(F.col(REASON).isNotNull())


def row_counts(checked: DataFrame) -> DataFrame:
    """Input, valid and rejected counts in one aggregate over one evaluation."""
    return checked.agg(
        F.count(F.lit(1)).alias("input_rows"),
        F.count_if(F.col(REASON).isNull()).alias("valid_rows"),
        F.count_if(F.col(REASON).isNotNull()).alias("rejected_rows"),
    )


def quarantine_counts(checked: DataFrame) -> DataFrame:
    """Rows per reason. Valid rows form a group whose reason counts nothing."""
    groups = checked.groupBy(REASON).agg(F.count(REASON).alias("rejected_rows"))
    return groups.filter(F.col("rejected_rows") > 0)
