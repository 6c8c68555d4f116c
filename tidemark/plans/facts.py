"""Star-schema wiring: which keys each fact resolves and when its event happened."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame

from tidemark.functions import columns as C
from tidemark.operators.temporal import CodeLookup, VersionLookup, resolve_keys
from tidemark.plans import entities as E


@dataclass(frozen=True)
class Dimension:
    """A versioned dimension. ``unique`` gives a value only one current member may hold."""

    entity: E.Entity
    table: str
    key: str
    unique: Callable[[], Column] | None = None

    @property
    def identifier(self) -> str:
        return self.entity.key


@dataclass(frozen=True)
class Fact:
    """A fact: dimensions by event time, date columns, and the code lookups."""

    entity: E.Entity
    table: str
    key: str
    event_time: str
    dimensions: tuple[str, ...]
    dates: tuple[str, ...]
    methods: bool = False

    @property
    def identifier(self) -> str:
        return self.entity.key

    @property
    def partition_source(self) -> str:
        return self.dates[0]

    def key_columns(self) -> list[str]:
        keys = [DIMENSIONS[name].key for name in self.dimensions]
        return keys + (["payment_method_key"] if self.methods else []) + list(self.dates)

    def columns(self) -> list[str]:
        """Warehouse contract without the fact's own surrogate key."""
        looked_up = {DIMENSIONS[name].identifier for name in self.dimensions}
        looked_up |= {"payment_method"} if self.methods else set()
        plain = [c for c in self.entity.columns if c not in looked_up and c not in self.dates]
        return [plain[0], *self.key_columns(), *plain[1:]]


DIMENSIONS = {
    "customer": Dimension(E.CUSTOMER, "dim_customer", "customer_key", unique=lambda: C.email_text("email")),
    "restaurant": Dimension(E.RESTAURANT, "dim_restaurant", "restaurant_key"),
    "driver": Dimension(E.DRIVER, "dim_driver", "driver_key", unique=lambda: C.code_text("number_plate")),
    "menu_item": Dimension(E.MENU_ITEM, "dim_menu_item", "menu_item_key"),
}

FACTS = {
    "order": Fact(
        E.ORDER, "fact_order", "order_key", "ordered_at", ("customer", "restaurant"),
        ("order_date_key",),
    ),
    "order_item": Fact(
        E.ORDER_ITEM, "fact_order_item", "order_item_key", "ordered_at",
        ("customer", "restaurant", "menu_item"), ("order_date_key",),
    ),
    "payment": Fact(
        E.PAYMENT, "fact_payment", "payment_key", "payment_created_at",
        ("customer", "restaurant"), ("payment_created_date_key", "paid_date_key"), methods=True,
    ),
    "delivery": Fact(
        E.DELIVERY, "fact_delivery_attempt", "delivery_attempt_key", "assigned_at",
        ("customer", "restaurant", "driver"), ("assigned_date_key",),
    ),
}


def version_lookups(fact: Fact, dimensions: Mapping[str, DataFrame]) -> list[VersionLookup]:
    return [
        VersionLookup(dimensions[n], DIMENSIONS[n].identifier, DIMENSIONS[n].key)
        for n in fact.dimensions
    ]


def code_lookups(fact: Fact, dates: DataFrame, methods: DataFrame | None) -> list[CodeLookup]:
    """The date dimension once per role, the payment method by its code."""
    lookups = [CodeLookup(dates, d, "date_key", "date_key", d, bounded=True) for d in fact.dates]
    if fact.methods:
        lookups.append(CodeLookup(
            methods, "payment_method", "payment_method_code", "payment_method_key",
            "payment_method_key", bounded=True,
        ))
    return lookups


def resolve_fact(
    staged: DataFrame, fact: Fact, dimensions: Mapping[str, DataFrame], dates: DataFrame,
    methods: DataFrame | None = None,
) -> DataFrame:
    """Staged rows with every surrogate key, in the warehouse contract."""
    resolved = resolve_keys(
        staged, fact.event_time, version_lookups(fact, dimensions),
        code_lookups(fact, dates, methods),
    )
    carried = ["batch_id"] if "batch_id" in staged.columns else []
    return resolved.select(*fact.columns(), *carried)
