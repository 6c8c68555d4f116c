"""What a loaded warehouse must satisfy: post-load checks and declared constraints.

``tables`` maps warehouse table names to frames; each function checks the tables
that are present and returns (check_name, violations), 0 meaning passed.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.checks import (
    Key,
    Reference,
    combine,
    key_checks,
    reference_checks,
    repeated_keys,
    row_checks,
    shared_values,
    total_rows,
)
from tidemark.operators.ledger import recent_batches
from tidemark.plans import entities as E
from tidemark.plans.facts import DIMENSIONS, FACTS

Tables = Mapping[str, DataFrame]

DIMENSION_OF = {d.table: d for d in DIMENSIONS.values()}
FACT_OF = {f.table: f for f in FACTS.values()}

# Longest text per warehouse column.
TEXT_LIMITS = {
    "full_name": 255, "email": 255, "phone": 100, "city": 100, "restaurant_name": 255,
    "category": 100, "address": 255, "status": 50, "driver_name": 255, "number_plate": 50,
    "driver_status": 50, "menu_item_id": 50, "menu_item_name": 255, "delivery_address": 500,
    "order_status": 50, "payment_status": 50, "transaction_ref": 100, "delivery_status": 50,
    "batch_id": 36,
}
HASH_LENGTH = 64
OPTIONAL_COLUMNS = {"valid_to", "address", "transaction_ref", "paid_at", "picked_up_at",
                    "delivered_at"}


def _present(tables: Tables, names) -> list[str]:
    return [n for n in names if n in tables]


def _blank(name: str) -> Column:
    return F.col(name).isNull() | (F.length(F.trim(name)) == 0)


def _any(conditions: list[Column]) -> Column:
    total = conditions[0]
    for condition in conditions[1:]:
        total = total | condition
    return total


# --- post-load checks ------------------------------------------------------


def one_current(tables: Tables) -> DataFrame:
    return combine([
        repeated_keys(
            tables[t].filter("is_current"), [DIMENSION_OF[t].identifier],
            f"{DIMENSION_OF[t].entity.name}_has_at_most_one_current_version",
        )
        for t in _present(tables, DIMENSION_OF)
    ])


def unique_current(tables: Tables) -> DataFrame:
    # Check names.
    names = {"dim_customer": "current_customer_email_is_unique",
             "dim_driver": "current_driver_number_plate_is_unique"}
    return combine([
        shared_values(
            tables[t].filter("is_current"), DIMENSION_OF[t].unique(),
            DIMENSION_OF[t].identifier, names[t],
        )
        for t in _present(tables, names)
    ])


def required(tables: Tables) -> DataFrame:
    # Check names and the columns that must hold text.
    texts = {
        "dim_customer": ("customer_contacts_are_present", ["email", "phone"]),
        "dim_driver": ("driver_identity_fields_are_present", ["phone", "number_plate"]),
        "fact_order": ("fact_order_delivery_address_is_present", ["delivery_address"]),
    }
    return combine([
        row_checks(tables[t], {texts[t][0]: _any([_blank(c) for c in texts[t][1]])})
        for t in _present(tables, texts)
    ])


def current_open(tables: Tables) -> DataFrame:
    return combine([
        row_checks(tables[t], {
            f"current_{DIMENSION_OF[t].entity.name}_has_null_valid_to":
                F.col("is_current") & F.col("valid_to").isNotNull()
        })
        for t in _present(tables, DIMENSION_OF)
    ])


def fact_keys(tables: Tables) -> DataFrame:
    # Check names.
    names = {
        "fact_order": "fact_order_foreign_keys_are_not_null",
        "fact_order_item": "fact_order_item_foreign_keys_are_not_null",
        "fact_payment": "fact_payment_foreign_keys_are_not_null",
        "fact_delivery_attempt": "fact_delivery_foreign_keys_are_not_null",
    }
    return combine([
        row_checks(tables[t], {names[t]: _any(
            [F.col(c).isNull() for c in [*FACT_OF[t].key_columns(), "batch_id"]])})
        for t in _present(tables, names)
    ])


def staging_empty(staging: list[DataFrame]) -> DataFrame:
    return total_rows(staging, "staging_tables_are_empty")


def post_load_checks(tables: Tables, staging: list[DataFrame], batches: DataFrame) -> DataFrame:
    """All nineteen checks."""
    return combine([
        staging_empty(staging), one_current(tables), unique_current(tables), required(tables),
        current_open(tables), fact_keys(tables), recent_batches(batches),
    ])


# --- declared constraints --------------------------------------------------


def not_null(tables: Tables) -> DataFrame:
    """Every column a table has must be filled, except the optional ones."""
    return combine([
        row_checks(df, {
            f"{t}.{c}": F.col(c).isNull() for c in df.columns if c not in OPTIONAL_COLUMNS
        })
        for t, df in tables.items()
    ])


def unique(tables: Tables) -> DataFrame:
    keys = []
    for t in _present(tables, DIMENSION_OF):
        d = DIMENSION_OF[t]
        keys.append(Key(f"{t} primary key", t, (d.key,)))
        keys.append(Key(f"{t} version", t, (d.identifier, "valid_from")))
    for t in _present(tables, FACT_OF):
        f = FACT_OF[t]
        if f.key in tables[t].columns:
            keys.append(Key(f"{t} primary key", t, (f.key,)))
        keys.append(Key(f"{t} source id", t, (f.identifier,)))
    for t, key in (("dim_date", "date_key"), ("dim_payment_method", "payment_method_code"),
                   ("etl_batch", "batch_id")):
        if t in tables:
            keys.append(Key(f"{t} {key}", t, (key,)))
    return key_checks(tables, keys)


def foreign_keys(tables: Tables) -> DataFrame:
    """Fact keys that point nowhere: dimensions, dates, methods, batches."""
    references = []
    for t in _present(tables, FACT_OF):
        fact = FACT_OF[t]
        parents = [(DIMENSIONS[n].key, DIMENSIONS[n].table, DIMENSIONS[n].key)
                   for n in fact.dimensions]
        parents += [(d, "dim_date", "date_key") for d in fact.dates]
        if fact.methods:
            parents.append(("payment_method_key", "dim_payment_method", "payment_method_key"))
        parents.append(("batch_id", "etl_batch", "batch_id"))
        references += [Reference(f"{t}.{column}", t, column, parent, parent_key)
                       for column, parent, parent_key in parents if parent in tables]
    if "etl_batch" in tables:
        references += [Reference(f"{t}.batch_id", t, "batch_id", "etl_batch", "batch_id")
                       for t in _present(tables, DIMENSION_OF)]
    return reference_checks(tables, references)


def source_foreign_keys(sources: Tables) -> DataFrame:
    """Source rows whose customer, restaurant, order or driver is not among the source rows."""
    # Source tables and the tables their identifiers refer to.
    parents = {
        "orders": [("customer_id", "customers"), ("restaurant_id", "restaurants")],
        "order_items": [("order_id", "orders")],
        "payments": [("order_id", "orders")],
        "deliveries": [("order_id", "orders"), ("driver_id", "drivers")],
    }
    return reference_checks(sources, [
        Reference(f"{t}.{column}", t, column, parent, column)
        for t in _present(sources, parents) for column, parent in parents[t] if parent in sources
    ])


def identifiers(tables: Tables) -> DataFrame:
    """Source identifiers of the dimensions: not negative, not empty."""
    # The identifiers a dimension carries.
    conditions = {
        "dim_customer": {"dim_customer identifier": F.col("customer_id") < 0},
        "dim_restaurant": {"dim_restaurant identifier": F.col("restaurant_id") < 0},
        "dim_driver": {"dim_driver identifier": F.col("driver_id") < 0},
        "dim_menu_item": {"dim_menu_item identifier": F.length("menu_item_id") == 0,
                          "dim_menu_item restaurant": F.col("restaurant_id") < 0},
    }
    return combine([row_checks(tables[t], conditions[t]) for t in _present(tables, conditions)])


def valid_period(tables: Tables) -> DataFrame:
    is_open = F.col("is_current") & F.col("valid_to").isNull()
    is_closed = (
        ~F.col("is_current") & F.col("valid_to").isNotNull()
        & (F.col("valid_to") > F.col("valid_from"))
    )
    return combine([
        row_checks(tables[t], {
            f"{t} valid period": ~(is_open | is_closed),
            f"{t} source time": F.col("source_updated_at") < F.col("valid_from"),
            f"{t} hash length": F.length("hash_diff") != HASH_LENGTH,
        })
        for t in _present(tables, DIMENSION_OF)
    ])


def amounts(tables: Tables) -> DataFrame:
    order_signs = _any([F.col(c) < 0 for c in ("subtotal", "discount", "delivery_fee",
                                               "total_amount")])
    conditions = {
        "fact_order": {
            "fact_order signs": order_signs,
            "fact_order total": F.col("total_amount")
            != F.col("subtotal") - F.col("discount") + F.col("delivery_fee"),
        },
        "fact_order_item": {
            "fact_order_item signs": (F.col("quantity") <= 0) | (F.col("unit_price") < 0)
            | (F.col("total_price") < 0),
            "fact_order_item total":
                F.col("total_price") != F.col("quantity") * F.col("unit_price"),
        },
        "fact_payment": {"fact_payment signs": F.col("amount") < 0},
        "dim_menu_item": {"dim_menu_item price": F.col("base_price") < 0},
    }
    return combine([row_checks(tables[t], conditions[t]) for t in _present(tables, conditions)])


def domains(tables: Tables) -> DataFrame:
    """Status values, distance range, timelines and the paid-date rule."""
    paid, key = F.col("paid_at"), F.col("paid_date_key")
    picked, delivered = F.col("picked_up_at"), F.col("delivered_at")
    conditions = {
        "fact_order": {"fact_order status": ~F.col("order_status").isin(*E.ORDER_STATES)},
        "fact_payment": {
            "fact_payment status": ~F.col("payment_status").isin(*E.PAYMENT_STATES),
            "fact_payment timeline": paid < F.col("payment_created_at"),
            "fact_payment paid date": (paid.isNull() & (key != 0)) | (paid.isNotNull() & (key <= 0)),
        },
        "fact_delivery_attempt": {
            "fact_delivery_attempt status":
                ~F.col("delivery_status").isin(*E.DELIVERY_STATES),
            "fact_delivery_attempt distance": (F.col("distance_km") <= 0)
            | (F.col("distance_km") > E.LONGEST_DISTANCE_KM),
            "fact_delivery_attempt timeline": (picked < F.col("assigned_at"))
            | (delivered.isNotNull() & (picked.isNull() | (delivered < picked))),
        },
    }
    return combine([row_checks(tables[t], conditions[t]) for t in _present(tables, conditions)])


def date_rows(dim_date: DataFrame) -> DataFrame:
    """A date row is complete, or it is the unknown date."""
    details = [c for c in dim_date.columns if c != "date_key"]
    day = F.col("full_date")
    number = F.year(day) * 10000 + F.month(day) * 100 + F.dayofmonth(day)
    empty = ~_any([F.col(c).isNotNull() for c in details])
    complete = ~_any([F.col(c).isNull() for c in details])
    ranges = (
        F.col("day_of_month").between(1, 31) & F.col("day_of_week").between(1, 7)
        & F.col("week_of_year").between(1, 53) & F.col("month_number").between(1, 12)
        & F.col("quarter_number").between(1, 4)
    )
    unknown = (F.col("date_key") == 0) & empty
    known = (F.col("date_key") > 0) & complete & F.coalesce(ranges, F.lit(False)) & F.coalesce(
        F.col("date_key") == number, F.lit(False)
    )
    return row_checks(dim_date, {"dim_date unknown or complete": ~(unknown | known)})


def ledger_rows(batches: DataFrame) -> DataFrame:
    counts = ["input_row_count", "loaded_row_count", "rejected_row_count"]
    used = F.col("loaded_row_count") + F.col("rejected_row_count")
    return row_checks(batches, {
        "etl_batch status":
            ~F.col("batch_status").isin("RUNNING", "SUCCEEDED", "PARTIAL", "FAILED"),
        "etl_batch completed": F.col("completed_at") < F.col("started_at"),
        "etl_batch counts": _any([F.col(c) < 0 for c in counts])
        | (used > F.col("input_row_count")),
    })


def not_blank(sources: Tables) -> DataFrame:
    """Source text that must not be blank."""
    # Source tables and their text columns under the rule.
    texts = {"customers": ["email", "phone"], "drivers": ["phone", "number_plate"],
             "orders": ["delivery_address"]}
    return combine([
        row_checks(sources[t], {f"{t}.{c} not blank": F.trim(c) == "" for c in texts[t]})
        for t in _present(sources, texts)
    ])


def lengths(tables: Tables) -> DataFrame:
    checks = []
    for t, df in tables.items():
        limits = {f"{t}.{c} length": F.length(c) > TEXT_LIMITS[c]
                  for c in df.columns if c in TEXT_LIMITS}
        if "hash_diff" in df.columns:
            limits[f"{t}.hash_diff length"] = F.length("hash_diff") != HASH_LENGTH
        checks.append(row_checks(df, limits))
    return combine(checks)
