"""Column types of the staging and warehouse tables."""

from __future__ import annotations

from tidemark.plans.facts import DIMENSIONS, FACTS, Dimension, Fact

# Column types of the contract.
TYPES = {
    "customer_id": "bigint", "restaurant_id": "bigint", "driver_id": "bigint",
    "menu_item_id": "string", "order_id": "bigint", "order_item_id": "bigint",
    "payment_id": "bigint", "delivery_id": "bigint", "quantity": "int", "available": "boolean",
    "tags": "array<string>", "base_price": "decimal(12,2)", "subtotal": "decimal(12,2)",
    "discount": "decimal(12,2)", "delivery_fee": "decimal(12,2)",
    "total_amount": "decimal(12,2)", "unit_price": "decimal(12,2)",
    "total_price": "decimal(12,2)", "amount": "decimal(12,2)", "distance_km": "decimal(8,2)",
    "is_current": "boolean", "payment_method_key": "int",
}
MOMENTS = {"valid_from", "valid_to"}


def column_type(name: str) -> str:
    if name in TYPES:
        return TYPES[name]
    if name.endswith("_date_key"):
        return "int"
    if name.endswith("_key"):
        return "bigint"
    return "timestamp_ntz" if name.endswith("_at") or name in MOMENTS else "string"


def ddl(columns) -> str:
    return ", ".join(f"{c} {column_type(c)}" for c in columns)


def staged_columns(name: str) -> list[str]:
    """Staging contract of an entity; tags travel as JSON text."""
    entity = (DIMENSIONS.get(name) or FACTS[name]).entity
    return ["tags_json" if c == "tags" else c for c in entity.columns]


def staging_schema(name: str) -> str:
    return "batch_id string, " + ddl(staged_columns(name))


def dimension_columns(dimension: Dimension) -> list[str]:
    attributes = [c for c in dimension.entity.columns
                  if c not in ("valid_from", "hash_diff", "source_updated_at")]
    return [dimension.key, *attributes, "valid_from", "valid_to", "is_current", "hash_diff",
            "source_updated_at", "batch_id", "loaded_at"]


def dimension_schema(dimension: Dimension) -> str:
    return ddl(dimension_columns(dimension)) + ", bucket int"


def fact_columns(fact: Fact) -> list[str]:
    return [fact.key, *fact.columns(), "batch_id", "loaded_at"]


def fact_schema(fact: Fact) -> str:
    return ddl(fact_columns(fact)) + ", event_month int, bucket int"


def index_columns(fact: Fact) -> list[str]:
    """What finds a stored fact row again and tells whether a batch replaces it."""
    return [fact.identifier, "source_updated_at", *fact.key_columns(), fact.key]


def index_schema(fact: Fact) -> str:
    return ddl(index_columns(fact)) + ", event_month int, revision bigint, bucket int"
