"""The eight entities: how their source rows are cleaned, judged and projected.

Each ``check_*`` returns the cleaned rows with ``rejection_reason``; ``accept``
keeps the valid rows, one per natural key, in the staging contract.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.functions import predicates as P
from tidemark.operators.dedup import latest_per_key
from tidemark.operators.lookup import distinct_keys, left_lookup
from tidemark.operators.rules import REASON, Rule, assign_reason, rejected_rows

# Accepted codes.
ACTIVITY_STATES = ("ACTIVE", "INACTIVE")
ORDER_STATES = ("DELIVERED", "CANCELLED", "PREPARING")
PAYMENT_METHOD_CODES = ("CARD", "PROMPTPAY", "CASH", "WALLET")
PAYMENT_STATES = ("PAID", "PENDING", "REFUNDED")
SETTLED_STATES = ("PAID", "REFUNDED")
DELIVERY_STATES = ("ASSIGNED", "DELIVERED")
LONGEST_DISTANCE_KM = 200


@dataclass(frozen=True)
class Entity:
    """Names of one entity. ``carried`` columns exist before de-duplication."""

    name: str
    key: str
    carried: tuple[str, ...]
    columns: tuple[str, ...]
    finish: Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Outcome:
    checked: DataFrame
    valid: DataFrame
    rejected: DataFrame


def accept(checked: DataFrame, entity: Entity) -> DataFrame:
    """Valid rows, the newest per natural key, as the staging contract wants them."""
    narrow = checked.select(*entity.carried, REASON)
    single = latest_per_key(
        narrow, [entity.key], "source_updated_at", entity.carried,
        eligible=F.col(REASON).isNull(),
    )
    return entity.finish(single).select(*entity.columns)


def outcome(checked: DataFrame, entity: Entity) -> Outcome:
    return Outcome(checked, accept(checked, entity), rejected_rows(checked))


def _ordered_times(created: str, updated: str) -> list[Rule]:
    return [
        Rule("INVALID_CREATED_AT", P.missing(created)),
        Rule("INVALID_UPDATED_AT", P.missing(updated)),
        Rule("UPDATED_BEFORE_CREATED", P.earlier(updated, created)),
    ]


# --- customers -------------------------------------------------------------


def check_customers(customers: DataFrame, null_is_violation: bool = True) -> DataFrame:
    cleaned = customers.select(
        C.safe_cast("customer_id", "bigint").alias("customer_id"),
        C.trimmed("full_name").alias("full_name"),
        C.email_text("email").alias("email"),
        C.optional_text("phone").alias("phone"),
        C.title_text("city").alias("city"),
        C.utc(customers, "created_at").alias("valid_from"),
        C.utc(customers, "updated_at").alias("source_updated_at"),
    )
    return assign_reason(cleaned, [
        Rule("INVALID_CUSTOMER_ID", P.not_positive("customer_id")),
        Rule("MISSING_FULL_NAME", P.blank("full_name")),
        Rule("MISSING_EMAIL", P.blank("email")),
        Rule("MISSING_PHONE", P.blank("phone")),
        Rule("MISSING_CITY", P.blank("city")),
        *_ordered_times("valid_from", "source_updated_at"),
    ])


CUSTOMER = Entity(
    "customer", "customer_id",
    ("customer_id", "full_name", "email", "phone", "city", "valid_from", "source_updated_at"),
    ("customer_id", "full_name", "email", "phone", "city", "valid_from", "hash_diff",
     "source_updated_at"),
    lambda df: df.withColumn(
        "hash_diff", C.change_hash(["full_name", "email", "phone", "city"], nullable=["phone"])
    ),
)


# --- restaurants -----------------------------------------------------------


def check_restaurants(restaurants: DataFrame, null_is_violation: bool = True) -> DataFrame:
    cleaned = restaurants.select(
        C.safe_cast("restaurant_id", "bigint").alias("restaurant_id"),
        C.trimmed("restaurant_name").alias("restaurant_name"),
        C.title_text("category").alias("category"),
        C.title_text("city").alias("city"),
        C.optional_text("address").alias("address"),
        C.code_text("status").alias("status"),
        C.utc(restaurants, "created_at").alias("valid_from"),
        C.utc(restaurants, "updated_at").alias("source_updated_at"),
    )
    return assign_reason(cleaned, [
        Rule("INVALID_RESTAURANT_ID", P.not_positive("restaurant_id")),
        Rule("MISSING_RESTAURANT_NAME", P.blank("restaurant_name")),
        Rule("MISSING_CATEGORY", P.blank("category")),
        Rule("MISSING_CITY", P.blank("city")),
        Rule("INVALID_RESTAURANT_STATUS",
             P.outside("status", ACTIVITY_STATES, null_is_violation)),
        *_ordered_times("valid_from", "source_updated_at"),
    ])


RESTAURANT = Entity(
    "restaurant", "restaurant_id",
    ("restaurant_id", "restaurant_name", "category", "city", "address", "status", "valid_from",
     "source_updated_at"),
    ("restaurant_id", "restaurant_name", "category", "city", "address", "status", "valid_from",
     "hash_diff", "source_updated_at"),
    lambda df: df.withColumn("hash_diff", C.change_hash(
        ["restaurant_name", "category", "city", "address", "status"], nullable=["address"]
    )),
)


# --- drivers ---------------------------------------------------------------


def check_drivers(drivers: DataFrame, null_is_violation: bool = True) -> DataFrame:
    cleaned = drivers.select(
        C.safe_cast("driver_id", "bigint").alias("driver_id"),
        C.trimmed("driver_name").alias("driver_name"),
        C.trimmed("phone").alias("phone"),
        F.upper(C.optional_text("number_plate")).alias("number_plate"),
        C.code_text("driver_status").alias("driver_status"),
        C.utc(drivers, "created_at").alias("valid_from"),
        C.utc(drivers, "updated_at").alias("source_updated_at"),
    )
    return assign_reason(cleaned, [
        Rule("INVALID_DRIVER_ID", P.not_positive("driver_id")),
        Rule("MISSING_DRIVER_NAME", P.blank("driver_name")),
        Rule("MISSING_PHONE", P.blank("phone")),
        Rule("MISSING_NUMBER_PLATE", P.blank("number_plate")),
        Rule("INVALID_DRIVER_STATUS",
             P.outside("driver_status", ACTIVITY_STATES, null_is_violation)),
        *_ordered_times("valid_from", "source_updated_at"),
    ])


DRIVER = Entity(
    "driver", "driver_id",
    ("driver_id", "driver_name", "phone", "number_plate", "driver_status", "valid_from",
     "source_updated_at"),
    ("driver_id", "driver_name", "phone", "number_plate", "driver_status", "valid_from",
     "hash_diff", "source_updated_at"),
    lambda df: df.withColumn(
        "hash_diff", C.change_hash(["driver_name", "phone", "number_plate", "driver_status"])
    ),
)


# --- menu items ------------------------------------------------------------


def check_menu_items(
    menu_items: DataFrame, restaurants: DataFrame, null_is_violation: bool = True
) -> DataFrame:
    """Menu documents; each must belong to a restaurant the other source knows."""
    cleaned = menu_items.select(
        C.trimmed("_id").alias("menu_item_id"),
        C.safe_cast("restaurantId", "bigint").alias("restaurant_id"),
        C.trimmed("name").alias("menu_item_name"),
        C.title_text("category").alias("category"),
        C.first_castable(menu_items, ["basePrice", "base_price"], C.MONEY).alias("base_price"),
        C.safe_cast("available", "boolean").alias("available"),
        C.normalized_array("tags").alias("tags"),
        C.utc(menu_items, "createdAt").alias("valid_from"),
        C.utc(menu_items, "updatedAt").alias("source_updated_at"),
    )
    known = distinct_keys(
        restaurants, C.safe_cast("restaurant_id", "bigint"), "known_restaurant_id"
    )
    joined = left_lookup(cleaned, known, "restaurant_id", "known_restaurant_id")
    return assign_reason(joined, [
        Rule("INVALID_MENU_ITEM_ID", P.blank("menu_item_id")),
        Rule("INVALID_RESTAURANT_ID", P.not_positive("restaurant_id")),
        Rule("RESTAURANT_NOT_FOUND", P.missing("known_restaurant_id")),
        Rule("MISSING_MENU_ITEM_NAME", P.blank("menu_item_name")),
        Rule("MISSING_CATEGORY", P.blank("category")),
        Rule("INVALID_BASE_PRICE", P.negative("base_price")),
        Rule("INVALID_AVAILABLE_FLAG", P.missing("available")),
        *_ordered_times("valid_from", "source_updated_at"),
    ])


MENU_ITEM = Entity(
    "menu_item", "menu_item_id",
    ("menu_item_id", "restaurant_id", "menu_item_name", "category", "base_price", "available",
     "tags", "valid_from", "source_updated_at"),
    ("menu_item_id", "restaurant_id", "menu_item_name", "category", "base_price", "available",
     "tags", "valid_from", "hash_diff", "source_updated_at"),
    lambda df: df.withColumn("hash_diff", C.change_hash(
        ["restaurant_id", "menu_item_name", "category", "base_price", "available",
         C.array_text("tags")]
    )),
)


# --- orders ----------------------------------------------------------------


def check_orders(orders: DataFrame, null_is_violation: bool = True) -> DataFrame:
    """Orders with the total recomputed; the source's total is kept for audit."""
    cleaned = orders.select(
        C.safe_cast("order_id", "bigint").alias("order_id"),
        C.safe_cast("customer_id", "bigint").alias("customer_id"),
        C.safe_cast("restaurant_id", "bigint").alias("restaurant_id"),
        C.trimmed("delivery_address").alias("delivery_address"),
        C.code_text("order_status").alias("order_status"),
        C.safe_cast("subtotal", C.MONEY).alias("subtotal"),
        C.safe_cast("discount", C.MONEY).alias("discount"),
        C.safe_cast("delivery_fee", C.MONEY).alias("delivery_fee"),
        C.safe_cast("total_amount", C.MONEY).alias("source_total_amount"),
        C.utc(orders, "ordered_at").alias("ordered_at"),
        C.utc(orders, "created_at").alias("created_at"),
        C.utc(orders, "updated_at").alias("source_updated_at"),
    ).withColumn("total_amount", C.order_total("subtotal", "discount", "delivery_fee"))
    return assign_reason(cleaned, [
        Rule("INVALID_ORDER_ID", P.not_positive("order_id")),
        Rule("INVALID_CUSTOMER_ID", P.not_positive("customer_id")),
        Rule("INVALID_RESTAURANT_ID", P.not_positive("restaurant_id")),
        Rule("MISSING_DELIVERY_ADDRESS", P.blank("delivery_address")),
        Rule("INVALID_ORDER_STATUS", P.outside("order_status", ORDER_STATES, null_is_violation)),
        Rule("INVALID_SUBTOTAL", P.negative("subtotal")),
        Rule("INVALID_DISCOUNT", P.negative("discount")),
        Rule("INVALID_DELIVERY_FEE", P.negative("delivery_fee")),
        Rule("INVALID_TOTAL_AMOUNT", P.negative("total_amount")),
        Rule("INVALID_ORDERED_AT", P.missing("ordered_at")),
        *_ordered_times("created_at", "source_updated_at"),
    ])


def with_correction_flag(checked_orders: DataFrame) -> DataFrame:
    """Audit view: whether the recomputed total differs from the source's."""
    return checked_orders.withColumn(
        "total_was_corrected", C.was_corrected("source_total_amount", "total_amount")
    )


ORDER = Entity(
    "order", "order_id",
    ("order_id", "customer_id", "restaurant_id", "delivery_address", "order_status", "subtotal",
     "discount", "delivery_fee", "total_amount", "ordered_at", "source_updated_at"),
    ("order_id", "customer_id", "restaurant_id", "delivery_address", "order_date_key",
     "order_status", "subtotal", "discount", "delivery_fee", "total_amount", "ordered_at",
     "source_updated_at"),
    lambda df: df.withColumn("order_date_key", C.business_date_key("ordered_at")),
)


def parent_orders(orders: DataFrame) -> DataFrame:
    """What payments, items and deliveries need of their order, one row per order."""
    narrow = orders.select(
        C.safe_cast("order_id", "bigint").alias("lookup_order_id"),
        C.safe_cast("customer_id", "bigint").alias("customer_id"),
        C.safe_cast("restaurant_id", "bigint").alias("restaurant_id"),
        C.order_total(
            C.safe_cast("subtotal", C.MONEY), C.safe_cast("discount", C.MONEY),
            C.safe_cast("delivery_fee", C.MONEY),
        ).alias("expected_payment_amount"),
        C.utc(orders, "ordered_at").alias("ordered_at"),
        C.utc(orders, "updated_at").alias("_order_updated_at"),
    ).filter(F.col("lookup_order_id").isNotNull())
    return latest_per_key(
        narrow, ["lookup_order_id"], "_order_updated_at",
        ["customer_id", "restaurant_id", "expected_payment_amount", "ordered_at"],
    ).drop("_order_updated_at")


# --- order items -----------------------------------------------------------


def menu_restaurants(menu_items: DataFrame) -> DataFrame:
    """Restaurant of each menu item, one row per menu item."""
    narrow = menu_items.select(
        C.trimmed("_id").alias("lookup_menu_item_id"),
        C.safe_cast("restaurantId", "bigint").alias("menu_restaurant_id"),
        C.utc(menu_items, "updatedAt").alias("_menu_updated_at"),
    ).filter(F.col("lookup_menu_item_id").isNotNull())
    return latest_per_key(
        narrow, ["lookup_menu_item_id"], "_menu_updated_at", ["menu_restaurant_id"]
    ).drop("_menu_updated_at")


def check_order_items(
    order_items: DataFrame, orders: DataFrame, menu_items: DataFrame,
    null_is_violation: bool = True,
) -> DataFrame:
    """Order lines against their order and the menu of the other source."""
    cleaned = order_items.select(
        C.safe_cast("order_item_id", "bigint").alias("order_item_id"),
        C.safe_cast("order_id", "bigint").alias("order_id"),
        C.trimmed("menu_item_id").alias("menu_item_id"),
        C.trimmed("menu_item_name").alias("menu_item_name"),
        C.safe_cast("quantity", "int").alias("quantity"),
        C.safe_cast("unit_price", C.MONEY).alias("unit_price"),
        C.safe_cast("total_price", C.MONEY).alias("source_total_price"),
        C.utc(order_items, "created_at").alias("created_at"),
        C.utc(order_items, "updated_at").alias("source_updated_at"),
    ).withColumn("total_price", C.line_total("quantity", "unit_price"))
    parents = parent_orders(orders).drop("expected_payment_amount")
    joined = left_lookup(cleaned, parents, "order_id", "lookup_order_id")
    joined = left_lookup(
        joined, menu_restaurants(menu_items), "menu_item_id", "lookup_menu_item_id"
    )
    return assign_reason(joined, [
        Rule("INVALID_ORDER_ITEM_ID", P.not_positive("order_item_id")),
        Rule("ORDER_NOT_FOUND", P.missing("lookup_order_id")),
        Rule("INVALID_MENU_ITEM_ID", P.blank("menu_item_id")),
        Rule("MENU_ITEM_NOT_FOUND", P.missing("lookup_menu_item_id")),
        Rule("MENU_RESTAURANT_MISMATCH",
             P.differs("restaurant_id", "menu_restaurant_id", null_is_violation)),
        Rule("MISSING_MENU_ITEM_NAME", P.blank("menu_item_name")),
        Rule("INVALID_QUANTITY", P.not_positive("quantity")),
        Rule("INVALID_UNIT_PRICE", P.negative("unit_price")),
        Rule("INVALID_TOTAL_PRICE", P.negative("total_price")),
        Rule("INVALID_ORDERED_AT", P.missing("ordered_at")),
        *_ordered_times("created_at", "source_updated_at"),
    ])


ORDER_ITEM = Entity(
    "order_item", "order_item_id",
    ("order_item_id", "order_id", "customer_id", "restaurant_id", "menu_item_id", "quantity",
     "unit_price", "total_price", "ordered_at", "source_updated_at"),
    ("order_item_id", "order_id", "customer_id", "restaurant_id", "menu_item_id",
     "order_date_key", "quantity", "unit_price", "total_price", "ordered_at",
     "source_updated_at"),
    lambda df: df.withColumn("order_date_key", C.business_date_key("ordered_at")),
)


# --- payments --------------------------------------------------------------


def check_payments(
    payments: DataFrame, orders: DataFrame, null_is_violation: bool = True
) -> DataFrame:
    """Payments reconciled with the recomputed total of their order."""
    cleaned = payments.select(
        C.safe_cast("payment_id", "bigint").alias("payment_id"),
        C.safe_cast("order_id", "bigint").alias("order_id"),
        C.code_text("payment_method").alias("payment_method"),
        C.code_text("payment_status").alias("payment_status"),
        C.safe_cast("amount", C.MONEY).alias("amount"),
        C.optional_text("transaction_ref").alias("transaction_ref"),
        C.utc(payments, "created_at").alias("payment_created_at"),
        C.utc(payments, "paid_at").alias("paid_at"),
        C.utc(payments, "updated_at").alias("source_updated_at"),
    )
    parents = parent_orders(orders).drop("ordered_at")
    joined = left_lookup(cleaned, parents, "order_id", "lookup_order_id")
    status, paid = F.col("payment_status"), F.col("paid_at")
    return assign_reason(joined, [
        Rule("INVALID_PAYMENT_ID", P.not_positive("payment_id")),
        Rule("ORDER_NOT_FOUND", P.missing("lookup_order_id")),
        Rule("INVALID_PAYMENT_METHOD",
             P.outside("payment_method", PAYMENT_METHOD_CODES, null_is_violation)),
        Rule("INVALID_PAYMENT_STATUS",
             P.outside("payment_status", PAYMENT_STATES, null_is_violation)),
        Rule("INVALID_PAYMENT_AMOUNT", P.negative("amount")),
        Rule("INVALID_ORDER_AMOUNT", P.missing("expected_payment_amount")),
        Rule("PAYMENT_AMOUNT_MISMATCH", P.differs("amount", "expected_payment_amount", False)),
        Rule("MISSING_TRANSACTION_REFERENCE",
             P.blank("transaction_ref") & (F.col("payment_method") != "CASH")),
        Rule("INVALID_PAYMENT_CREATED_AT", P.missing("payment_created_at")),
        Rule("INVALID_UPDATED_AT", P.missing("source_updated_at")),
        Rule("UPDATED_BEFORE_CREATED", P.earlier("source_updated_at", "payment_created_at")),
        Rule("PENDING_PAYMENT_HAS_PAID_AT", paid.isNotNull() & (status == "PENDING")),
        Rule("MISSING_PAID_AT", paid.isNull() & status.isin(*SETTLED_STATES)),
        Rule("PAID_BEFORE_CREATED", P.earlier("paid_at", "payment_created_at")),
    ])


PAYMENT = Entity(
    "payment", "payment_id",
    ("payment_id", "order_id", "customer_id", "restaurant_id", "payment_method",
     "payment_status", "amount", "transaction_ref", "payment_created_at", "paid_at",
     "source_updated_at"),
    ("payment_id", "order_id", "customer_id", "restaurant_id", "payment_method",
     "payment_created_date_key", "paid_date_key", "payment_status", "amount", "transaction_ref",
     "payment_created_at", "paid_at", "source_updated_at"),
    lambda df: df.withColumns({
        "payment_created_date_key": C.business_date_key("payment_created_at"),
        "paid_date_key": C.date_key_or_unknown("paid_at"),
    }),
)


# --- deliveries ------------------------------------------------------------


def check_deliveries(
    deliveries: DataFrame, orders: DataFrame, null_is_violation: bool = True
) -> DataFrame:
    """Delivery attempts with the customer and restaurant of their order."""
    cleaned = deliveries.select(
        C.safe_cast("delivery_id", "bigint").alias("delivery_id"),
        C.safe_cast("order_id", "bigint").alias("order_id"),
        C.safe_cast("driver_id", "bigint").alias("driver_id"),
        C.code_text("delivery_status").alias("delivery_status"),
        C.safe_cast("distance_km", C.DISTANCE).alias("distance_km"),
        C.utc(deliveries, "assigned_at").alias("assigned_at"),
        C.utc(deliveries, "picked_up_at").alias("picked_up_at"),
        C.utc(deliveries, "delivered_at").alias("delivered_at"),
        C.utc(deliveries, "updated_at").alias("source_updated_at"),
    )
    parents = parent_orders(orders).select("lookup_order_id", "customer_id", "restaurant_id")
    joined = left_lookup(cleaned, parents, "order_id", "lookup_order_id")
    picked, delivered = F.col("picked_up_at"), F.col("delivered_at")
    return assign_reason(joined, [
        Rule("INVALID_DELIVERY_ID", P.not_positive("delivery_id")),
        Rule("ORDER_NOT_FOUND", P.any_of(
            [P.missing("order_id"), P.missing("customer_id"), P.missing("restaurant_id")])),
        Rule("INVALID_DRIVER_ID", P.not_positive("driver_id")),
        Rule("INVALID_DELIVERY_STATUS",
             P.outside("delivery_status", DELIVERY_STATES, null_is_violation)),
        Rule("INVALID_DISTANCE", P.outside_range("distance_km", 0, LONGEST_DISTANCE_KM)),
        Rule("INVALID_ASSIGNED_AT", P.missing("assigned_at")),
        Rule("INVALID_UPDATED_AT", P.missing("source_updated_at")),
        Rule("PICKED_UP_BEFORE_ASSIGNED", P.earlier("picked_up_at", "assigned_at")),
        Rule("DELIVERED_WITHOUT_PICKUP", delivered.isNotNull() & picked.isNull()),
        Rule("DELIVERED_BEFORE_PICKUP", P.earlier("delivered_at", "picked_up_at")),
        Rule("MISSING_DELIVERED_AT",
             delivered.isNull() & (F.col("delivery_status") == "DELIVERED")),
    ])


DELIVERY = Entity(
    "delivery", "delivery_id",
    ("delivery_id", "order_id", "customer_id", "restaurant_id", "driver_id", "delivery_status",
     "distance_km", "assigned_at", "picked_up_at", "delivered_at", "source_updated_at"),
    ("delivery_id", "order_id", "customer_id", "restaurant_id", "driver_id",
     "assigned_date_key", "delivery_status", "distance_km", "assigned_at", "picked_up_at",
     "delivered_at", "source_updated_at"),
    lambda df: df.withColumn("assigned_date_key", C.business_date_key("assigned_at")),
)


# --- valid / rejected pairs ------------------------------------------------


def clean_customers(customers: DataFrame) -> Outcome:
    return outcome(check_customers(customers), CUSTOMER)


def clean_restaurants(restaurants: DataFrame) -> Outcome:
    return outcome(check_restaurants(restaurants), RESTAURANT)


def clean_drivers(drivers: DataFrame) -> Outcome:
    return outcome(check_drivers(drivers), DRIVER)


def clean_menu_items(menu_items: DataFrame, restaurants: DataFrame) -> Outcome:
    return outcome(check_menu_items(menu_items, restaurants), MENU_ITEM)


def clean_orders(orders: DataFrame) -> Outcome:
    return outcome(check_orders(orders), ORDER)


def clean_order_items(
    order_items: DataFrame, orders: DataFrame, menu_items: DataFrame
) -> Outcome:
    return outcome(check_order_items(order_items, orders, menu_items), ORDER_ITEM)


def clean_payments(payments: DataFrame, orders: DataFrame) -> Outcome:
    return outcome(check_payments(payments, orders), PAYMENT)


def clean_deliveries(deliveries: DataFrame, orders: DataFrame) -> Outcome:
    return outcome(check_deliveries(deliveries, orders), DELIVERY)
