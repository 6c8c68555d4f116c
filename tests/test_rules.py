import json

import pytest
from pyspark.sql import functions as F

from tidemark.operators.dedup import latest_per_key
from tidemark.operators.flatten import menu_option_choices, menu_options
from tidemark.operators.rules import REASON, rejected_rows, row_counts, valid_rows
from tidemark.plans import entities as E
from tidemark.sources.documents import MENU_DOCUMENT

T0 = "2026-01-01 00:00:00"
T1 = "2026-01-02 00:00:00"
T2 = "2026-01-03 00:00:00"

CUSTOMERS = ("customer_id string; full_name string; email string; phone string; city string; "
             "created_at string; updated_at string")
DRIVERS = ("driver_id string; driver_name string; phone string; number_plate string; "
           "driver_status string; created_at string; updated_at string")
RESTAURANTS = ("restaurant_id string; restaurant_name string; category string; city string; "
               "address string; status string; created_at string; updated_at string")
ORDERS = ("order_id string; customer_id string; restaurant_id string; delivery_address string; "
          "order_status string; subtotal string; discount string; delivery_fee string; "
          "total_amount string; ordered_at string; created_at string; updated_at string")
ITEMS = ("order_item_id string; order_id string; menu_item_id string; menu_item_name string; "
         "quantity string; unit_price string; total_price string; created_at string; "
         "updated_at string")
PAYMENTS = ("payment_id string; order_id string; payment_method string; payment_status string; "
            "amount string; transaction_ref string; paid_at string; created_at string; "
            "updated_at string")
DELIVERIES = ("delivery_id string; order_id string; driver_id string; delivery_status string; "
              "distance_km string; assigned_at string; picked_up_at string; delivered_at string; "
              "updated_at string")


def changed(schema, good, **changes):
    names = [p.strip().split(" ")[0] for p in schema.split(";")]
    row = dict(zip(names, good, strict=True)) | changes
    return tuple(row[n] for n in names)


def reasons(checked):
    return [r[REASON] for r in checked.collect()]


GOOD_ORDER = ("1", "2", "3", " 5 Road ", " delivered", "100.00", "10.00", "5.00", "95.00", T0, T0, T1)


@pytest.mark.parametrize("change,reason", [
    ({}, None),
    ({"total_amount": "1.00"}, None),
    ({"order_id": "x"}, "INVALID_ORDER_ID"),
    ({"order_id": "0"}, "INVALID_ORDER_ID"),
    ({"customer_id": "-1", "restaurant_id": "0"}, "INVALID_CUSTOMER_ID"),
    ({"restaurant_id": None}, "INVALID_RESTAURANT_ID"),
    ({"delivery_address": "  "}, "MISSING_DELIVERY_ADDRESS"),
    ({"order_status": "LOST"}, "INVALID_ORDER_STATUS"),
    ({"order_status": None}, "INVALID_ORDER_STATUS"),
    ({"subtotal": "-1"}, "INVALID_SUBTOTAL"),
    ({"discount": "abc"}, "INVALID_DISCOUNT"),
    ({"delivery_fee": None}, "INVALID_DELIVERY_FEE"),
    ({"discount": "500"}, "INVALID_TOTAL_AMOUNT"),
    ({"ordered_at": "bogus"}, "INVALID_ORDERED_AT"),
    ({"created_at": None}, "INVALID_CREATED_AT"),
    ({"updated_at": ""}, "INVALID_UPDATED_AT"),
    ({"updated_at": "2025-12-31 00:00:00"}, "UPDATED_BEFORE_CREATED"),
])
def test_orders(frame, change, reason):
    checked = E.check_orders(frame(ORDERS, changed(ORDERS, GOOD_ORDER, **change)))
    assert reasons(checked) == [reason]


def test_unknown_status_passes_only_when_asked(frame):
    rows = frame(ORDERS, changed(ORDERS, GOOD_ORDER, order_status=None))
    assert reasons(E.check_orders(rows, null_is_violation=False)) == [None]


@pytest.mark.parametrize("change,reason", [
    ({}, None),
    ({"customer_id": "0"}, "INVALID_CUSTOMER_ID"), ({"full_name": " "}, "MISSING_FULL_NAME"),
    ({"email": None}, "MISSING_EMAIL"), ({"phone": "  "}, "MISSING_PHONE"),
    ({"city": ""}, "MISSING_CITY"), ({"created_at": "x"}, "INVALID_CREATED_AT"),
    ({"updated_at": None}, "INVALID_UPDATED_AT"),
    ({"updated_at": "2020-01-01"}, "UPDATED_BEFORE_CREATED"),
])
def test_customers(frame, change, reason):
    good = ("1", "Ann", "A@x", "1", "bangkok", T0, T1)
    assert reasons(E.check_customers(frame(CUSTOMERS, changed(CUSTOMERS, good, **change)))) == [reason]


@pytest.mark.parametrize("change,reason", [
    ({}, None), ({"driver_id": None}, "INVALID_DRIVER_ID"),
    ({"driver_name": ""}, "MISSING_DRIVER_NAME"), ({"phone": " "}, "MISSING_PHONE"),
    ({"number_plate": "  "}, "MISSING_NUMBER_PLATE"),
    ({"driver_status": "retired"}, "INVALID_DRIVER_STATUS"),
    ({"driver_status": None}, "INVALID_DRIVER_STATUS"),
    ({"updated_at": "2020-01-01"}, "UPDATED_BEFORE_CREATED"),
])
def test_drivers(frame, change, reason):
    good = ("1", "Dan", "1", "bkk-1", " active ", T0, T1)
    assert reasons(E.check_drivers(frame(DRIVERS, changed(DRIVERS, good, **change)))) == [reason]


@pytest.mark.parametrize("change,reason", [
    ({}, None), ({"address": None}, None), ({"restaurant_id": "-3"}, "INVALID_RESTAURANT_ID"),
    ({"restaurant_name": " "}, "MISSING_RESTAURANT_NAME"), ({"category": None}, "MISSING_CATEGORY"),
    ({"city": " "}, "MISSING_CITY"), ({"status": "x"}, "INVALID_RESTAURANT_STATUS"),
])
def test_restaurants(frame, change, reason):
    good = ("1", "R", "thai", "bkk", "a", "active", T0, T1)
    rows = frame(RESTAURANTS, changed(RESTAURANTS, good, **change))
    assert reasons(E.check_restaurants(rows)) == [reason]


def document(**changes):
    good = {"_id": " MENU-1 ", "restaurantId": 1, "name": "Rice", "category": "main",
            "basePrice": "10", "base_price": None, "available": "true", "tags": ["b", "a"],
            "options": None, "description": None,
            "createdAt": "2026-01-01T00:00:00Z", "updatedAt": "2026-01-02T00:00:00Z"}
    return good | changes


@pytest.mark.parametrize("change,reason", [
    ({}, None), ({"basePrice": None, "base_price": "7"}, None), ({"_id": " "}, "INVALID_MENU_ITEM_ID"),
    ({"restaurantId": 0}, "INVALID_RESTAURANT_ID"), ({"restaurantId": 99}, "RESTAURANT_NOT_FOUND"),
    ({"name": None}, "MISSING_MENU_ITEM_NAME"), ({"category": " "}, "MISSING_CATEGORY"),
    ({"basePrice": "free"}, "INVALID_BASE_PRICE"), ({"available": "maybe"}, "INVALID_AVAILABLE_FLAG"),
    ({"createdAt": None}, "INVALID_CREATED_AT"), ({"updatedAt": "soon"}, "INVALID_UPDATED_AT"),
    ({"updatedAt": "2020-01-01T00:00:00Z"}, "UPDATED_BEFORE_CREATED"),
])
def test_menu_items(spark, frame, change, reason):
    docs = spark.createDataFrame([document(**change)], MENU_DOCUMENT)
    known = frame("restaurant_id bigint", (1,), (1,), (2,))
    assert reasons(E.check_menu_items(docs, known)) == [reason]


@pytest.mark.parametrize("change,reason", [
    ({}, None), ({"total_price": "1"}, None), ({"order_item_id": "0"}, "INVALID_ORDER_ITEM_ID"),
    ({"order_id": "77"}, "ORDER_NOT_FOUND"), ({"menu_item_id": " "}, "INVALID_MENU_ITEM_ID"),
    ({"menu_item_id": "MENU-9"}, "MENU_ITEM_NOT_FOUND"),
    ({"menu_item_id": "MENU-2"}, "MENU_RESTAURANT_MISMATCH"),
    ({"menu_item_id": "MENU-3"}, "MENU_RESTAURANT_MISMATCH"),
    ({"menu_item_name": ""}, "MISSING_MENU_ITEM_NAME"), ({"quantity": "0"}, "INVALID_QUANTITY"),
    ({"quantity": "two"}, "INVALID_QUANTITY"), ({"unit_price": "-1"}, "INVALID_UNIT_PRICE"),
    ({"created_at": "x"}, "INVALID_CREATED_AT"), ({"updated_at": None}, "INVALID_UPDATED_AT"),
    ({"updated_at": "2020-01-01"}, "UPDATED_BEFORE_CREATED"),
])
def test_order_items(spark, frame, change, reason):
    good = ("11", "1", "MENU-1", " Rice ", "2", "10.00", "20.00", T0, T1)
    orders = frame(ORDERS, changed(ORDERS, GOOD_ORDER, restaurant_id="1"))
    menu = spark.createDataFrame(
        [document(), document(_id="MENU-2", restaurantId=2), document(_id="MENU-3", restaurantId=None)],
        MENU_DOCUMENT)
    rows = frame(ITEMS, changed(ITEMS, good, **change))
    assert reasons(E.check_order_items(rows, orders, menu)) == [reason]


@pytest.mark.parametrize("change,reason", [
    ({}, None), ({"payment_id": "x"}, "INVALID_PAYMENT_ID"), ({"order_id": "5"}, "ORDER_NOT_FOUND"),
    ({"payment_method": "gold"}, "INVALID_PAYMENT_METHOD"),
    ({"payment_method": None}, "INVALID_PAYMENT_METHOD"),
    ({"payment_status": "held"}, "INVALID_PAYMENT_STATUS"),
    ({"amount": "-95"}, "INVALID_PAYMENT_AMOUNT"), ({"amount": "95.01"}, "PAYMENT_AMOUNT_MISMATCH"),
    ({"order_id": "2"}, "INVALID_ORDER_AMOUNT"),
    ({"transaction_ref": " "}, "MISSING_TRANSACTION_REFERENCE"),
    ({"transaction_ref": None, "payment_method": "cash"}, None),
    ({"created_at": None}, "INVALID_PAYMENT_CREATED_AT"), ({"updated_at": "x"}, "INVALID_UPDATED_AT"),
    ({"updated_at": "2020-01-01"}, "UPDATED_BEFORE_CREATED"),
    ({"payment_status": "pending"}, "PENDING_PAYMENT_HAS_PAID_AT"),
    ({"payment_status": "pending", "paid_at": None}, None),
    ({"paid_at": None}, "MISSING_PAID_AT"), ({"paid_at": "2025-12-31"}, "PAID_BEFORE_CREATED"),
])
def test_payments(frame, change, reason):
    good = ("1", "1", " Card", "paid", "95.00", "TX", T1, T0, T1)
    orders = frame(ORDERS, GOOD_ORDER, changed(ORDERS, GOOD_ORDER, order_id="2", subtotal="x"))
    rows = frame(PAYMENTS, changed(PAYMENTS, good, **change))
    assert reasons(E.check_payments(rows, orders)) == [reason]


@pytest.mark.parametrize("change,reason", [
    ({}, None), ({"delivery_id": None}, "INVALID_DELIVERY_ID"), ({"order_id": "9"}, "ORDER_NOT_FOUND"),
    ({"driver_id": "0"}, "INVALID_DRIVER_ID"), ({"delivery_status": "flying"}, "INVALID_DELIVERY_STATUS"),
    ({"distance_km": "0"}, "INVALID_DISTANCE"), ({"distance_km": "200.01"}, "INVALID_DISTANCE"),
    ({"distance_km": "200"}, None), ({"assigned_at": None}, "INVALID_ASSIGNED_AT"),
    ({"updated_at": "?"}, "INVALID_UPDATED_AT"),
    ({"picked_up_at": "2025-12-31"}, "PICKED_UP_BEFORE_ASSIGNED"),
    ({"picked_up_at": None}, "DELIVERED_WITHOUT_PICKUP"),
    ({"delivered_at": T0}, "DELIVERED_BEFORE_PICKUP"), ({"delivered_at": None}, "MISSING_DELIVERED_AT"),
    ({"delivered_at": None, "delivery_status": "assigned"}, None),
])
def test_deliveries(frame, change, reason):
    good = ("1", "1", "3", "Delivered ", "4.50", T0, T1, T2, T2)
    orders = frame(ORDERS, GOOD_ORDER)
    rows = frame(DELIVERIES, changed(DELIVERIES, good, **change))
    assert reasons(E.check_deliveries(rows, orders)) == [reason]


def test_repeated_parent_orders_do_not_multiply_lines(frame):
    good = ("1", "1", "3", "Delivered ", "4.50", T0, T1, T2, T2)
    orders = frame(ORDERS, GOOD_ORDER, changed(ORDERS, GOOD_ORDER, customer_id="8", updated_at=T2),
                   changed(ORDERS, GOOD_ORDER, order_id=None))
    checked = E.check_deliveries(frame(DELIVERIES, good), orders).collect()
    assert [r.customer_id for r in checked] == [8]


def test_valid_rejected_and_duplicates_add_up(frame):
    orders = frame(
        ORDERS, GOOD_ORDER, changed(ORDERS, GOOD_ORDER, updated_at=T2, delivery_address="new"),
        changed(ORDERS, GOOD_ORDER, updated_at="2026-02-01 00:00:00", order_status="LOST"),
        changed(ORDERS, GOOD_ORDER, order_id="x"))
    result = E.clean_orders(orders)
    valid = result.valid.collect()
    assert [(r.order_id, r.delivery_address) for r in valid] == [(1, "new")]
    assert valid[0].total_amount == valid[0].subtotal - valid[0].discount + valid[0].delivery_fee
    assert result.rejected.count() == 2
    assert tuple(row_counts(result.checked).first()) == (4, 2, 2)
    assert valid_rows(result.checked).count() + rejected_rows(result.checked).count() == 4


def test_latest_is_deterministic_on_ties(frame):
    df = frame("k int; t string; v string", (1, "b", "y"), (1, "b", "x"), (1, "a", "w"), (2, None, "z"))
    for rows in (df, df.orderBy(F.col("v").desc()), df.repartition(3)):
        kept = {r.k: r.v for r in latest_per_key(rows, ["k"], "t", ["v"]).collect()}
        assert kept == {1: "x", 2: "z"}


def test_hot_key_is_limited_before_the_shuffle(spark):
    df = spark.range(10_000).selectExpr("id div 100000 AS k", "id AS t")
    plan = latest_per_key(df, ["k"], "t")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    assert latest_per_key(df, ["k"], "t").first().t == 9_999


def test_options_and_choices(spark):
    options = [
        {"name": "Size", "required": True,
         "choices": [{"name": "Regular", "extraPrice": 0}, {"name": "Large", "extraPrice": 40}]},
        {"name": "Top", "required": False, "choices": []},
    ]
    text = json.dumps([{"_id": "M1", "options": options}, {"_id": "M2", "options": None}])
    docs = spark.createDataFrame([(text,)], "t string").selectExpr(
        f"inline(from_json(t, 'array<struct<{_struct()}>>'))")
    assert [tuple(r) for r in menu_options(docs).orderBy("menu_option_id").collect()] == [
        ("M1-1", "M1", "Size", True), ("M1-2", "M1", "Top", False)]
    choices = menu_option_choices(docs).orderBy("choice_id").collect()
    assert [(r.choice_id, r.menu_option_id, r.choice_name, float(r.extra_price)) for r in choices] == [
        ("M1-1-1", "M1-1", "Regular", 0.0), ("M1-1-2", "M1-1", "Large", 40.0)]


def _struct():
    return ("_id: string, options: array<struct<name: string, required: boolean, "
            "choices: array<struct<name: string, extraPrice: decimal(12,2)>>>>")
