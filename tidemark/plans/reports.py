"""Star-schema reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import business_time


def hourly_item_sales(order_items: DataFrame, dim_menu_item: DataFrame) -> DataFrame:
    """Lines, quantity and revenue per local hour and menu item, from the item fact alone.

    The fact shrinks to (hour, item key) before the dimension joins, so the join
    moves report rows, not fact rows, and a popular item cannot skew it.
    """
    sales = (
        order_items.groupBy(
            F.hour(business_time("ordered_at")).alias("local_hour"), "menu_item_key"
        )
        .agg(
            F.count(F.lit(1)).alias("order_lines"),
            F.sum(F.col("quantity").cast("long")).alias("quantity"),
            F.sum("total_price").cast("decimal(18,2)").alias("revenue"),
        )
    )
    names = dim_menu_item.select(
        F.col("menu_item_key").alias("_key"), "menu_item_id", "menu_item_name"
    )
    return (
        sales.join(names, F.col("menu_item_key") == F.col("_key"), "left")
        .select(
            "local_hour", "menu_item_key",
            F.coalesce("menu_item_id", F.lit("UNKNOWN")).alias("menu_item_id"),
            F.coalesce("menu_item_name", F.lit("Unknown")).alias("menu_item_name"),
            "order_lines", "quantity", "revenue",
        )
    )
