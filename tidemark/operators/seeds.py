"""Static dimensions, unknown members and insert-if-absent seeding."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.columns import date_number
from tidemark.operators.ledger import BOOTSTRAP_BATCH

# Fixed values of the warehouse contract.
FIRST_DATE, LAST_DATE = "2020-01-01", "2035-12-31"
PAYMENT_METHODS = [
    (0, "UNKNOWN", "Unknown", True),
    (1, "CARD", "Card", True),
    (2, "PROMPTPAY", "PromptPay", True),
    (3, "CASH", "Cash", True),
    (4, "WALLET", "Wallet", True),
]
UNKNOWN_SINCE = datetime(1900, 1, 1)
UNKNOWN_HASH = "0" * 64
UNKNOWN_ATTRIBUTES = {
    "customer": {"customer_key": 0, "customer_id": 0, "full_name": "Unknown",
                 "email": "unknown@invalid", "phone": "UNKNOWN", "city": "Unknown"},
    "restaurant": {"restaurant_key": 0, "restaurant_id": 0, "restaurant_name": "Unknown",
                   "category": "Unknown", "city": "Unknown", "status": "UNKNOWN"},
    "menu_item": {"menu_item_key": 0, "menu_item_id": "UNKNOWN", "restaurant_id": 0,
                  "menu_item_name": "Unknown", "category": "Unknown", "base_price": 0,
                  "available": False, "tags": []},
    "driver": {"driver_key": 0, "driver_id": 0, "driver_name": "Unknown", "phone": "UNKNOWN",
               "number_plate": "UNKNOWN", "driver_status": "UNKNOWN"},
}
SCHEMA_PAYMENT_METHOD = (
    "payment_method_key int, payment_method_code string, payment_method_name string, "
    "is_active boolean"
)


def dim_payment_method(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PAYMENT_METHODS, SCHEMA_PAYMENT_METHOD)


def dim_date(spark: SparkSession, first: str = FIRST_DATE, last: str = LAST_DATE) -> DataFrame:
    """One row per calendar day and the unknown date, key 0."""
    day = F.col("full_date")
    iso_weekday = F.weekday(day) + 1
    days = spark.range(1).select(
        F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias(
            "full_date"
        )
    )
    calendar = days.select(
        date_number(day).cast("int").alias("date_key"),
        day,
        F.dayofmonth(day).alias("day_of_month"),
        iso_weekday.alias("day_of_week"),
        F.date_format(day, "EEE").alias("day_name"),
        F.weekofyear(day).alias("week_of_year"),
        F.month(day).alias("month_number"),
        F.date_format(day, "MMM").alias("month_name"),
        F.quarter(day).alias("quarter_number"),
        F.year(day).alias("year_number"),
        (iso_weekday >= 6).alias("is_weekend"),
    )
    unknown = spark.range(1).select(F.lit(0).alias("date_key"))
    return calendar.unionByName(unknown, allowMissingColumns=True)


def unknown_member(dimension: DataFrame, entity: str) -> DataFrame:
    """The dimension's key-0 row in the dimension's own schema."""
    values = {
        **UNKNOWN_ATTRIBUTES[entity],
        "hash_diff": UNKNOWN_HASH,
        "is_current": True,
        "batch_id": BOOTSTRAP_BATCH,
    }
    since = F.lit(str(UNKNOWN_SINCE)).cast("timestamp_ntz")
    times = {"valid_from": since, "source_updated_at": since, "loaded_at": since}

    def cell(field):
        if field.name in times:
            return times[field.name].cast(field.dataType)
        value = values.get(field.name)
        made = F.array() if isinstance(value, list) else F.lit(value)
        return made.cast(field.dataType)

    return dimension.sparkSession.range(1).select(
        *[cell(field).alias(field.name) for field in dimension.schema.fields]
    )


def insert_if_absent(table: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Seed ``rows`` whose key the table lacks. Seeding twice changes nothing."""
    fresh = rows.join(table.select(*keys), list(keys), "left_anti").select(*rows.columns)
    return table.unionByName(fresh, allowMissingColumns=True)
