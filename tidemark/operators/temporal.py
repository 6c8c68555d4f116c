"""Point-in-time lookups against versioned dimensions.

A version is valid in the half-open interval ``[valid_from, valid_to)``; a NULL
``valid_to`` means open. Dimension frames carry ``valid_from`` and ``valid_to``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import UNKNOWN_KEY
from tidemark.operators.lookup import splittable_join

# Width of the time slices over which one identifier's versions are split.
SLICE_SECONDS = 86400


@dataclass(frozen=True)
class VersionLookup:
    """Where to find the surrogate key of one versioned dimension."""

    dimension: DataFrame = field(repr=False)
    id_column: str
    key_column: str
    #: Identifiers may have very many versions *and* events: meet in time cells (see :func:`as_of_lookup`).
    busy: bool = False

    def versions(self) -> DataFrame:
        return self.dimension.select(self.id_column, self.key_column, "valid_from", "valid_to")


@dataclass(frozen=True)
class CodeLookup:
    """Equality lookup in a static dimension: event column -> dimension column.

    ``bounded=True`` states that the dimension has a fixed, small row count (the date
    and payment-method dimensions), which makes the broadcast safe at any scale.
    """

    dimension: DataFrame = field(repr=False)
    event_column: str
    dimension_column: str
    key_column: str
    output: str
    bounded: bool = False

    def pairs(self) -> DataFrame:
        return self.dimension.select(
            F.col(self.dimension_column).alias("_code"), F.col(self.key_column).alias("_code_key")
        )


def covers(time: Column, valid_from: Column, valid_to: Column) -> Column:
    return (time >= valid_from) & (valid_to.isNull() | (time < valid_to))


# Widths of the time cells grow by this factor; the narrowest are 64 seconds, the widest some 2,000 years.
CELL_BITS, NARROWEST, CELL_LEVELS = 4, 6, 9
# The level of versions that are open or longer than the widest cells: one cell for all time.
OPEN_LEVEL = CELL_LEVELS


def _cell_level(length: Column) -> Column:
    """The narrowest cells that are at least as wide as a version is long, in seconds."""
    level = F.lit(OPEN_LEVEL)
    for n in reversed(range(CELL_LEVELS)):
        level = F.when(length <= 1 << (NARROWEST + n * CELL_BITS), F.lit(n)).otherwise(level)
    return level


def _cell(seconds: Column, level: Column) -> Column:
    """Number of the cell of a level that a moment lies in."""
    return F.when(level == OPEN_LEVEL, F.lit(0)).otherwise(
        F.call_function("shiftright", seconds, (F.lit(NARROWEST) + level * CELL_BITS).cast("int")))


def _matches_in_cells(events: DataFrame, versions: DataFrame, id_column: str, event_time: str) -> DataFrame:
    """(_event_id, _time, _key) for each distinct identifier and moment of ``events`` and each version in force then.

    A version lies in cells about as wide as it is long: at most two of them, or the one cell of open versions. A moment
    looks into one cell of each level that its identifier has versions of. Versions that do not overlap and are longer
    than a sixteenth of a cell fit into it some sixteen at a time, so a moment meets a bounded number of them
    per level, however many its identifier has. Overlapping versions are all met, as they all match.
    """
    length = _clock_seconds(F.col("_to")) - _clock_seconds(F.col("_from")) + 1
    placed = versions.filter(F.col("_to").isNull() | (F.col("_from") < F.col("_to"))).withColumn(
        "_level", F.coalesce(_cell_level(length), F.lit(OPEN_LEVEL)))
    first, last = (_cell(_clock_seconds(F.col(c)), F.col("_level")).cast("long") for c in ("_from", "_to"))
    placed = placed.withColumn("_cell", F.explode(F.when(
        F.col("_level") == OPEN_LEVEL, F.array(F.lit(0).cast("long"))).otherwise(F.sequence(first, last))))
    levels = placed.groupBy(F.col("_id").alias("_level_id")).agg(F.collect_set("_level").alias("_levels"))
    moments = events.select(F.col(id_column).alias("_event_id"), F.col(event_time).alias("_time")).dropna().distinct()
    spread = (
        splittable_join(moments, levels, "_event_id", "_level_id", "inner")
        .select("_event_id", "_time", F.explode("_levels").alias("_event_level"))
        .withColumn("_event_cell", _cell(_clock_seconds(F.col("_time")), F.col("_event_level")).cast("long"))
    )
    inside = (
        (F.col("_event_id") == F.col("_id")) & (F.col("_event_level") == F.col("_level"))
        & (F.col("_event_cell") == F.col("_cell")) & covers(F.col("_time"), F.col("_from"), F.col("_to")))
    return spread.join(placed, inside).select("_event_id", "_time", "_key")


def as_of_lookup(events: DataFrame, lookup: VersionLookup, event_time: str) -> DataFrame:
    """Surrogate key of the version in force at ``event_time``, 0 when there is none.

    An equi join with the interval as residual condition, which Spark runs as a broadcast or
    sort-merge join; adaptive execution splits an identifier with very many events. That pairs each event with
    all versions of its identifier. Where a lookup is ``busy`` they meet in time cells instead, and the work is
    linear in both. A version that ends where it starts, or before, covers no time and matches nothing.
    """
    versions = lookup.versions().select(
        F.col(lookup.id_column).alias("_id"),
        F.col("valid_from").alias("_from"),
        F.col("valid_to").alias("_to"),
        F.col(lookup.key_column).alias("_key"),
    )
    if lookup.busy:
        matches = _matches_in_cells(events, versions, lookup.id_column, event_time)
        condition = (F.col(lookup.id_column) == F.col("_event_id")) & (F.col(event_time) == F.col("_time"))
        return (
            events.join(matches, condition, "left")
            .withColumn(lookup.key_column, F.coalesce("_key", F.lit(UNKNOWN_KEY)))
            .drop("_event_id", "_time", "_key")
        )
    condition = (F.col(lookup.id_column) == F.col("_id")) & covers(
        F.col(event_time), F.col("_from"), F.col("_to")
    )
    return (
        events.join(versions, condition, "left")
        .withColumn(lookup.key_column, F.coalesce("_key", F.lit(UNKNOWN_KEY)))
        .drop("_id", "_from", "_to", "_key")
    )


def _clock_seconds(moment: Column) -> Column:
    """Seconds of a zone-less timestamp, untouched by the session's daylight saving."""
    days = F.unix_date(moment.cast("date")).cast("long")
    return days * 86400 + F.hour(moment) * 3600 + F.minute(moment) * 60 + F.second(moment)


def running_latest(df: DataFrame, keys: Sequence[str], time: str, value: str, slice_seconds: int,
                   order: Sequence[str] = (), inclusive: bool = True) -> DataFrame:
    """Add ``_running``: the largest ``value`` of the key's rows up to each row.

    One window over a key would put all its rows into one task. Here the window
    runs per (key, time slice); what earlier slices contribute is a second,
    small window over one pre-aggregated row per (key, slice).
    """
    sliced = df.withColumn("_slice", F.floor(_clock_seconds(F.col(time)) / slice_seconds))
    cells = [*keys, "_slice"]
    frame_end = Window.currentRow if inclusive else -1
    within = (
        Window.partitionBy(*cells)
        .orderBy(time, *order)
        .rowsBetween(Window.unboundedPreceding, frame_end)
    )
    before = (
        Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    )
    carried = (
        sliced.groupBy(*cells)
        .agg(F.max(value).alias("_slice_value"))
        .select(*cells, F.max("_slice_value").over(before).alias("_carried"))
    )
    return (
        sliced.withColumn("_within", F.max(value).over(within))
        .join(carried, cells)
        .withColumn("_running", F.greatest("_within", "_carried"))
        .drop("_within", "_carried", "_slice")
    )


def code_lookup(events: DataFrame, lookup: CodeLookup) -> DataFrame:
    pairs = F.broadcast(lookup.pairs()) if lookup.bounded else lookup.pairs()
    return (
        events.join(pairs, F.col(lookup.event_column) == F.col("_code"), "left")
        .withColumn(lookup.output, F.coalesce("_code_key", F.lit(UNKNOWN_KEY)))
        .drop("_code", "_code_key")
    )


def resolve_keys(
    events: DataFrame,
    event_time: str,
    versioned: Sequence[VersionLookup],
    coded: Sequence[CodeLookup] = (),
) -> DataFrame:
    """Attach every surrogate key of a fact row; misses become the unknown key."""
    for lookup in coded:
        events = code_lookup(events, lookup)
    for lookup in versioned:
        events = as_of_lookup(events, lookup, event_time)
    return events


# --- guards ----------------------------------------------------------------

_OPEN_END = "9999-12-31 00:00:00"


def _with_previous_end(dimension: DataFrame, id_column: str) -> DataFrame:
    """Versions with the latest end among the identifier's earlier versions.

    Several versions may start together; ordering by the end as well keeps the
    comparison of neighbours complete.
    """
    ended = dimension.select(
        id_column,
        "valid_from",
        F.coalesce("valid_to", F.lit(_OPEN_END).cast("timestamp_ntz")).alias("_end"),
    ).filter(F.col("_end") > F.col("valid_from"))
    return running_latest(
        ended, [id_column], "valid_from", "_end", SLICE_SECONDS, order=["_end"], inclusive=False,
    ).withColumnRenamed("_running", "_previous_end")


def version_overlaps(dimension: DataFrame, id_column: str) -> DataFrame:
    """Stretches of time in which an identifier has more than one valid version.

    ``overlap_to`` is NULL while the overlap is still open.
    """
    end = F.least("_end", "_previous_end")
    return (
        _with_previous_end(dimension, id_column)
        .filter(F.col("valid_from") < F.col("_previous_end"))
        .select(
            id_column,
            F.col("valid_from").alias("overlap_from"),
            F.when(end < F.lit(_OPEN_END).cast("timestamp_ntz"), end).alias("overlap_to"),
        )
    )


def _inside_overlap(
    events: DataFrame, event_id: str, event_time: str, lookup: VersionLookup
) -> DataFrame:
    """Ids of the events that fall into an overlap of their identifier's versions."""
    overlaps = version_overlaps(lookup.dimension, lookup.id_column).withColumnRenamed(
        lookup.id_column, "_id"
    )
    timed = events.select(
        F.col(lookup.id_column).alias("_event_id"), F.col(event_time).alias("_time"), event_id
    )
    inside = (F.col("_event_id") == F.col("_id")) & covers(
        F.col("_time"), F.col("overlap_from"), F.col("overlap_to")
    )
    return timed.join(overlaps, inside, "left_semi").select(event_id)


def ambiguous_events(
    events: DataFrame, event_id: str, event_time: str, versioned: Sequence[VersionLookup],
    coded: Sequence[CodeLookup] = (),
) -> DataFrame:
    """(event id, dimension) for every event that more than one dimension row matches.

    An event is ambiguous exactly when it falls into a stretch where versions
    overlap, so only such stretches are looked at. A healthy warehouse has none,
    and no event is paired with a version to find that out.
    """
    found = [
        _inside_overlap(events, event_id, event_time, lookup).select(
            event_id, F.lit(lookup.key_column).alias("dimension"))
        for lookup in versioned
    ]
    for lookup in coded:
        repeated = lookup.pairs().groupBy("_code").count().filter(F.col("count") > 1)
        found.append(
            events.select(event_id, lookup.event_column)
            .join(repeated, F.col(lookup.event_column) == F.col("_code"), "left_semi")
            .select(event_id, F.lit(lookup.output).alias("dimension"))
        )
    return reduce(DataFrame.unionByName, found).distinct()
