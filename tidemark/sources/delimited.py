"""Delimited source extracts with the ingest's column normalisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.columns import safe_cast, utc_from_text

# File layouts in column order with the type each column loads as.
LAYOUTS = {
    "customers": "customer_id bigint, full_name string, email string, phone string, "
    "city string, created_at timestamp_ntz, updated_at timestamp_ntz",
    "restaurants": "restaurant_id bigint, restaurant_name string, category string, city string, "
    "address string, status string, created_at timestamp_ntz, updated_at timestamp_ntz",
    "drivers": "driver_id bigint, driver_name string, phone string, number_plate string, "
    "driver_status string, created_at timestamp_ntz, updated_at timestamp_ntz",
    "orders": "order_id bigint, customer_id bigint, restaurant_id bigint, "
    "delivery_address string, order_status string, subtotal decimal(12,2), "
    "discount decimal(12,2), delivery_fee decimal(12,2), total_amount decimal(12,2), "
    "ordered_at timestamp_ntz, created_at timestamp_ntz, updated_at timestamp_ntz",
    "order_items": "order_item_id bigint, order_id bigint, menu_item_id string, "
    "menu_item_name string, quantity int, unit_price decimal(12,2), "
    "total_price decimal(12,2), created_at timestamp_ntz, updated_at timestamp_ntz",
    "payments": "payment_id bigint, order_id bigint, payment_method string, "
    "payment_status string, amount decimal(12,2), transaction_ref string, "
    "paid_at timestamp_ntz, created_at timestamp_ntz, updated_at timestamp_ntz",
    "deliveries": "delivery_id bigint, order_id bigint, driver_id bigint, "
    "delivery_status string, distance_km decimal(8,2), assigned_at timestamp_ntz, "
    "picked_up_at timestamp_ntz, delivered_at timestamp_ntz, created_at timestamp_ntz, "
    "updated_at timestamp_ntz",
}

# Text columns the ingest changes on the way in.
LOWERED = {"customers": {"email"}}
TRIMMED = {"customers": {"phone"}, "drivers": {"phone", "number_plate"},
           "orders": {"delivery_address"}}
BLANK_IS_NULL = {"restaurants": {"address"}, "payments": {"transaction_ref"}}


def _loaded(table: str, name: str, data_type: str) -> Column:
    raw = F.col(name)
    if data_type == "timestamp_ntz":
        return utc_from_text(raw)
    if data_type != "string":
        return safe_cast(raw, data_type)
    if name in LOWERED.get(table, ()):
        return F.lower(F.trim(raw))
    if name in TRIMMED.get(table, ()):
        return F.trim(raw)
    if name in BLANK_IS_NULL.get(table, ()):
        return F.nullif(raw, F.lit(""))
    return raw


def read_delimited(
    spark: SparkSession, path: str, table: str, multi_line: bool = False
) -> DataFrame:
    """One extract with header line and doubled quotes, columns typed and normalised.

    Files stay splittable unless ``multi_line`` allows line breaks inside quotes.
    """
    columns = [part.strip().split(" ", 1) for part in _split_layout(LAYOUTS[table])]
    text_schema = ", ".join(f"{name} string" for name, _ in columns)
    raw = (
        spark.read.schema(text_schema)
        .options(header=True, quote='"', escape='"', multiLine=multi_line, mode="PERMISSIVE")
        .csv(path)
    )
    return raw.select(*[_loaded(table, name, kind).alias(name) for name, kind in columns])


def _split_layout(layout: str) -> list[str]:
    """Column definitions; the comma of ``decimal(12,2)`` does not separate columns."""
    return layout.replace(", ", "\n").split("\n")
