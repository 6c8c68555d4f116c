"""Nested option and choice arrays as two child relations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def flatten_options(menu_items: DataFrame) -> DataFrame:
    """One row per option of a menu item; id = parent id and ordinal from 1."""
    return (
        menu_items.select(F.col("_id").alias("menu_item_id"), F.posexplode("options"))
        .select(
            F.concat_ws("-", "menu_item_id", (F.col("pos") + 1).cast("string")).alias(
                "menu_option_id"
            ),
            "menu_item_id",
            F.trim("col.name").alias("option_name"),
            F.col("col.required").alias("required"),
            F.col("col.choices").alias("choices"),
        )
    )


def menu_options(menu_items: DataFrame) -> DataFrame:
    return flatten_options(menu_items).drop("choices")


def menu_option_choices(menu_items: DataFrame) -> DataFrame:
    """One row per choice of an option; both explodes run in the same stage."""
    return (
        flatten_options(menu_items)
        .select("menu_option_id", F.posexplode("choices"))
        .select(
            F.concat_ws("-", "menu_option_id", (F.col("pos") + 1).cast("string")).alias(
                "choice_id"
            ),
            "menu_option_id",
            F.trim("col.name").alias("choice_name"),
            F.col("col.extraPrice").try_cast("decimal(12,2)").alias("extra_price"),
        )
    )
