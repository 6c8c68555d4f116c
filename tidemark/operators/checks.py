"""Violation counts: generic distributed checks returning (check_name, violations)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NAME = "check_name"
COUNT = "violations"


def row_checks(df: DataFrame, violations: Mapping[str, Column]) -> DataFrame:
    """All row-level checks of one table in a single pass over it.

    A condition that is NULL does not count, as with a SQL CHECK constraint.
    """
    counts = df.agg(
        *[F.count_if(condition).alias(f"_{i}") for i, condition in enumerate(violations.values())]
    )
    rows = [
        F.struct(F.lit(name).alias(NAME), F.col(f"_{i}").alias(COUNT))
        for i, name in enumerate(violations)
    ]
    return counts.select(F.inline(F.array(*rows)))


def _named_count(groups: DataFrame, name: str) -> DataFrame:
    return groups.agg(F.count(F.lit(1)).alias(COUNT)).select(F.lit(name).alias(NAME), COUNT)


def repeated_keys(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Number of key values that occur more than once (any NULL part: not a key)."""
    present = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    groups = df.filter(present).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    return _named_count(groups, name)


def shared_values(df: DataFrame, value: Column, key: str, name: str) -> DataFrame:
    """Number of values held by two or more different keys.

    Lowest and highest key per value combine before the shuffle; a distinct
    count would first spread every (value, key) pair.
    """
    groups = (
        df.select(value.alias("_value"), key)
        .groupBy("_value")
        .agg(F.min(key).alias("_low"), F.max(key).alias("_high"))
        .filter("_low <> _high")
    )
    return _named_count(groups, name)


def missing_references(
    df: DataFrame, column: str, parent: DataFrame, parent_column: str, name: str
) -> DataFrame:
    """Rows whose non-NULL reference has no parent row.

    References are counted per value first, so a key that a third of the rows
    share reaches the join as one row per map task.
    """
    references = (
        df.filter(F.col(column).isNotNull())
        .groupBy(F.col(column).alias("_reference"))
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    parents = parent.select(F.col(parent_column).alias("_parent"))
    return (
        references.join(parents, F.col("_reference") == F.col("_parent"), "left_anti")
        .agg(F.coalesce(F.sum("_n"), F.lit(0)).alias(COUNT))
        .select(F.lit(name).alias(NAME), COUNT)
    )


@dataclass(frozen=True)
class Key:
    """The values of ``columns`` must not repeat in ``table``, unless one of them is NULL."""

    name: str
    table: str
    columns: tuple[str, ...]


@dataclass(frozen=True)
class Reference:
    """A value of ``table.column`` must be one of ``parent.parent_column``, unless it is NULL."""

    name: str
    table: str
    column: str
    parent: str
    parent_column: str


_WHOLE_NUMBERS = {"tinyint", "smallint", "int", "bigint"}


def _number_or_texts(df: DataFrame, columns: Sequence[str], as_number: bool) -> list[Column]:
    """The values as one number or as texts, so that keys of all types fit in one frame; NULL if a part is."""
    types = dict(df.dtypes)

    def text(name: str) -> Column:
        # instants by number: their text names two of them in the autumn hour
        exact = {"timestamp": F.unix_micros, "binary": F.hex}.get(types[name], F.col)
        return exact(name).cast("string")

    present = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])
    number = F.col(columns[0]).cast("bigint") if as_number else F.lit(None).cast("bigint")
    texts = F.lit(None).cast("array<string>") if as_number else F.when(present, F.array(*map(text, columns)))
    return [number.alias("number"), texts.alias("texts")]


def _spread(df: DataFrame, entries: Sequence[Column]) -> DataFrame:
    """One row per entry and row of ``df``, from a single scan."""
    return df.select(F.inline(F.array(*entries))).filter("number IS NOT NULL OR texts IS NOT NULL")


def key_checks(tables: Mapping[str, DataFrame], keys: Sequence[Key]) -> DataFrame:
    """Number of repeated values of every key: one scan per table and one aggregate for all.

    A value that many rows share is counted before the shuffle.
    """
    rows = []
    for t in dict.fromkeys(k.table for k in keys):
        df = tables[t]
        types = dict(df.dtypes)
        rows.append(_spread(df, [
            F.struct(F.lit(i).alias("key"), *_number_or_texts(
                df, k.columns, len(k.columns) == 1 and types[k.columns[0]] in _WHOLE_NUMBERS))
            for i, k in enumerate(keys) if k.table == t
        ]))
    groups = combine(rows).groupBy("key", "number", "texts").agg(F.count(F.lit(1)).alias("n"))
    return row_checks(groups.filter("n > 1"), {k.name: F.col("key") == i for i, k in enumerate(keys)})


def reference_checks(
    tables: Mapping[str, DataFrame], references: Sequence[Reference]
) -> DataFrame:
    """Rows whose non-NULL reference has no parent row, for every reference.

    A table is scanned once for all references it makes and all keys it offers. References meet
    keys in one aggregate by value instead of a join each, so a hot value reaches it as
    one row per map task. Whole numbers meet as numbers; where either side is not one, both meet as text.
    """
    offered = list(dict.fromkeys((r.parent, r.parent_column) for r in references))
    types = {t: dict(df.dtypes) for t, df in tables.items()}
    as_number = {o: types[o[0]][o[1]] in _WHOLE_NUMBERS for o in offered}
    for r in references:
        as_number[r.parent, r.parent_column] &= types[r.table][r.column] in _WHOLE_NUMBERS

    def entry(t: str, column: str, parent: tuple[str, str], reference: int) -> Column:
        return F.struct(
            F.lit(offered.index(parent)).alias("parent"), F.lit(reference).alias("reference"),
            *_number_or_texts(tables[t], [column], as_number[parent]))

    entries: dict[str, list[Column]] = {}
    for o in offered:
        entries.setdefault(o[0], []).append(entry(*o, o, -1))
    for i, r in enumerate(references):
        entries.setdefault(r.table, []).append(entry(r.table, r.column, (r.parent, r.parent_column), i))
    rows = combine([_spread(tables[t], of_table) for t, of_table in entries.items()])
    values = rows.groupBy("parent", "number", "texts").agg(
        F.bool_or(F.col("reference") == -1).alias("known"),
        *[F.count_if(F.col("reference") == i).alias(f"_{i}") for i in range(len(references))])
    counts = values.filter("NOT known").agg(
        *[F.coalesce(F.sum(f"_{i}"), F.lit(0)).alias(f"_{i}") for i in range(len(references))])
    return counts.select(F.inline(F.array(*[
        F.struct(F.lit(r.name).alias(NAME), F.col(f"_{i}").alias(COUNT))
        for i, r in enumerate(references)])))


def total_rows(tables: Sequence[DataFrame], name: str) -> DataFrame:
    """Rows in all tables together."""
    counts = [t.agg(F.count(F.lit(1)).alias("_n")) for t in tables]
    return (
        reduce(DataFrame.unionByName, counts)
        .agg(F.sum("_n").alias(COUNT))
        .select(F.lit(name).alias(NAME), COUNT)
    )


def combine(checks: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)
