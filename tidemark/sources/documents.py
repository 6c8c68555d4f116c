"""Nested menu documents as JSON Lines or parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The document layout. Prices are text because producers send
# numbers, numeric text, or the older field name.
MENU_DOCUMENT = """
    _id string, restaurantId bigint, name string, description string, category string,
    basePrice string, base_price string, available string, tags array<string>,
    options array<struct<name: string, required: boolean,
        choices: array<struct<name: string, extraPrice: decimal(12,2)>>>>,
    createdAt string, updatedAt string
"""


def read_documents(
    spark: SparkSession, path: str, schema: str = MENU_DOCUMENT, data_format: str = "json"
) -> DataFrame:
    """Explicit schema: an empty or partial batch keeps every column."""
    return spark.read.format(data_format).schema(schema).load(path)


def parse_documents(rows: DataFrame, column: str, schema: str = MENU_DOCUMENT) -> DataFrame:
    """Documents kept as JSON text in a column, with the same explicit schema."""
    return rows.select(F.from_json(column, schema).alias("_document")).select("_document.*")
