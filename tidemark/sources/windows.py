"""High-water-mark windows ``(from, to]`` over any source frame."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.columns import utc_from_text

# Where the first run of a pipeline starts.
FIRST_WATERMARK = datetime(1900, 1, 1)


def as_utc_naive(moment: datetime | str) -> datetime:
    """Normalise a watermark: text or datetime, with or without zone, to naive UTC."""
    if isinstance(moment, str):
        moment = datetime.fromisoformat(moment.strip().replace("Z", "+00:00"))
    if moment.tzinfo is not None:
        moment = moment.astimezone(timezone.utc).replace(tzinfo=None)
    return moment


def _literal(moment: datetime | str, data_type: T.DataType) -> Column:
    """Literal of the column's own type, so the comparison reaches the scan."""
    text = as_utc_naive(moment).isoformat(sep=" ", timespec="microseconds")
    if isinstance(data_type, T.TimestampType):
        return F.lit(text + "+00:00").cast("timestamp")
    return F.lit(text).cast("timestamp_ntz")


def _between(moment: Column, data_type: T.DataType, lower, upper) -> Column:
    return (moment > _literal(lower, data_type)) & (moment <= _literal(upper, data_type))


def incremental_window(
    df: DataFrame, column: str, lower: datetime | str | None, upper: datetime | str | None
) -> DataFrame:
    """Rows changed after ``lower`` and not after ``upper``.

    An unknown ``upper`` (empty source) gives no rows with the full schema; an
    unknown ``lower`` is a mistake of the caller.
    """
    if lower is None:
        raise ValueError("the lower watermark is required")
    if upper is None:
        return df.filter(F.lit(False))
    return df.filter(_between(F.col(column), df.schema[column].dataType, lower, upper))


def lookback_window(
    df: DataFrame, column: str, lower: datetime | str | None, upper: datetime | str | None,
    lookback: timedelta,
) -> DataFrame:
    """Window that reaches back before ``lower`` for rows committed late.

    Reading rows again is harmless: dimension versions and fact rows only change
    when the source row is newer.
    """
    if lower is None:
        raise ValueError("the lower watermark is required")
    return incremental_window(df, column, as_utc_naive(lower) - lookback, upper)


def document_window(
    df: DataFrame, field: str, lower: datetime | str | None, upper: datetime | str | None
) -> DataFrame:
    """The same window over a text timestamp; unreadable text is never selected."""
    if lower is None:
        raise ValueError("the lower watermark is required")
    if upper is None:
        return df.filter(F.lit(False))
    return df.filter(_between(utc_from_text(field), T.TimestampNTZType(), lower, upper))


def high_watermark(df: DataFrame, column: str) -> DataFrame:
    """One row ``watermark_to``: the largest value, NULL for an empty source."""
    return df.agg(F.max(column).alias("watermark_to"))


def document_watermark(df: DataFrame, field: str) -> DataFrame:
    return df.agg(F.max(utc_from_text(field)).alias("watermark_to"))


def watermark_value(watermark: DataFrame) -> datetime | None:
    """The probe's value as naive UTC, whatever zone the session or the driver's host is in."""
    moment = F.col("watermark_to")
    if isinstance(watermark.schema["watermark_to"].dataType, T.TimestampType):
        micros = watermark.select(F.unix_micros(moment)).first()[0]
        return None if micros is None else datetime(1970, 1, 1) + timedelta(microseconds=micros)
    text = watermark.select(moment.cast("timestamp_ntz").cast("string")).first()[0]
    return None if text is None else datetime.fromisoformat(text)
