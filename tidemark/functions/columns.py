"""Column builders used by the cleaning plans.

Every function returns an unevaluated ``Column`` made of Spark built-ins, so the
expressions stay inside whole-stage code generation. Nothing here raises on bad
data: a value that cannot be converted becomes NULL and the rules decide.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the warehouse contract.
MONEY = "decimal(12,2)"
DISTANCE = "decimal(8,2)"
BUSINESS_TIMEZONE = "Asia/Bangkok"
UNKNOWN_KEY = 0
HASH_SEPARATOR = "||"
HASH_NULL = "<NULL>"
TAG_SEPARATOR = ","

# Anything but a fraction after the clock time is a zone: ``Z``, an offset, or a name.
ZONE_AFTER_TIME = r":\d{1,2}(\.\d*)?\s*[A-Za-z+\-]"


def _column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


# --- conversions -----------------------------------------------------------


def safe_cast(value: Column | str, data_type: str) -> Column:
    """Cast that yields NULL for text it cannot read, also under ANSI mode."""
    return _column(value).try_cast(data_type)


def to_long(value: Column | str) -> Column:
    return safe_cast(value, "bigint")


def utc_of_instant(instant: Column) -> Column:
    """An instant as zone-less UTC by arithmetic, so that no wall clock is read twice or skipped."""
    seconds = (F.unix_micros(instant).cast("decimal(20,0)") * F.lit(Decimal("0.000001"))).cast("decimal(18,6)")
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=seconds)


def utc_from_text(value: Column | str) -> Column:
    """Read timestamp text as a zone-less UTC timestamp, NULL if unreadable.

    Text with a zone (``Z``, an offset or a zone's name) is moved to UTC; text without one is
    UTC already. The result does not depend on the session time zone.
    """
    text = _column(value)
    with_zone = utc_of_instant(text.try_cast("timestamp"))
    return F.when(text.rlike(ZONE_AFTER_TIME), with_zone).otherwise(text.try_cast("timestamp_ntz"))


def utc(df: DataFrame, name: str) -> Column:
    """The column ``name`` of ``df`` as a zone-less UTC timestamp, whatever its type."""
    data_type = df.schema[name].dataType
    if isinstance(data_type, T.TimestampNTZType):
        return F.col(name)
    if isinstance(data_type, T.TimestampType):
        return utc_of_instant(F.col(name))
    if isinstance(data_type, T.DateType):
        return F.col(name).cast("timestamp_ntz")
    return utc_from_text(F.col(name).cast("string"))


# --- text ------------------------------------------------------------------


def trimmed(value: Column | str) -> Column:
    return F.trim(_column(value))


def code_text(value: Column | str) -> Column:
    """Upper-case code without surrounding spaces (statuses, methods, plates)."""
    return F.upper(F.trim(_column(value)))


def email_text(value: Column | str) -> Column:
    return F.lower(F.trim(_column(value)))


def title_text(value: Column | str) -> Column:
    return F.initcap(F.lower(F.trim(_column(value))))


def optional_text(value: Column | str) -> Column:
    """Trimmed text, NULL when nothing is left."""
    return F.nullif(F.trim(_column(value)), F.lit(""))


# --- documents -------------------------------------------------------------


def first_castable(df: DataFrame, candidates: Sequence[str], data_type: str) -> Column:
    """First of several columns that exists and converts: absorbs renamed fields."""
    present = [safe_cast(c, data_type) for c in candidates if c in df.columns]
    return F.coalesce(*present) if present else F.lit(None).cast(data_type)


def normalized_array(value: Column | str) -> Column:
    """Sorted array, NULL elements last; a missing array is an empty one."""
    array = _column(value)
    return F.array_sort(F.coalesce(array, F.array().cast("array<string>")))


def array_text(value: Column | str) -> Column:
    return F.array_join(_column(value), TAG_SEPARATOR)


def array_to_json(value: Column | str) -> Column:
    return F.to_json(_column(value))


def json_to_array(value: Column | str) -> Column:
    return F.from_json(_column(value), T.ArrayType(T.StringType()))


# --- money -----------------------------------------------------------------


def order_total(subtotal: Column | str, discount: Column | str, fee: Column | str) -> Column:
    return (_column(subtotal) - _column(discount) + _column(fee)).try_cast(MONEY)


def line_total(quantity: Column | str, unit_price: Column | str) -> Column:
    return (_column(quantity) * _column(unit_price)).try_cast(MONEY)


def was_corrected(source_total: Column | str, computed_total: Column | str) -> Column:
    return _column(source_total) != _column(computed_total)


# --- dates -----------------------------------------------------------------


def business_time(value: Column | str, timezone: str = BUSINESS_TIMEZONE) -> Column:
    """Local wall-clock time of a zone-less UTC timestamp."""
    return F.convert_timezone(F.lit("UTC"), F.lit(timezone), _column(value))


def date_number(local: Column) -> Column:
    """YYYYMMDD as an integer; plain arithmetic instead of formatting text."""
    return F.year(local) * 10000 + F.month(local) * 100 + F.dayofmonth(local)


def business_date_key(value: Column | str, timezone: str = BUSINESS_TIMEZONE) -> Column:
    return date_number(business_time(value, timezone)).cast("int")


def date_key_or_unknown(value: Column | str, timezone: str = BUSINESS_TIMEZONE) -> Column:
    return F.coalesce(business_date_key(value, timezone), F.lit(UNKNOWN_KEY))


# --- change detection ------------------------------------------------------


def change_hash(tracked: Iterable[Column | str], nullable: Iterable[str] = ()) -> Column:
    """SHA-256 over the tracked attributes in order.

    ``concat_ws`` skips NULLs, so attributes that may be NULL have to be listed
    in ``nullable`` and enter the hash as a marker text.
    """
    optional = set(nullable)
    parts = [
        F.coalesce(_column(c).cast("string"), F.lit(HASH_NULL))
        if isinstance(c, str) and c in optional
        else _column(c).cast("string")
        for c in tracked
    ]
    return F.sha2(F.concat_ws(HASH_SEPARATOR, *parts), 256)
