"""The same results in plain SQL for DuckDB, written independently of the operators.

``PARTS`` are named sub-queries; ``{name}`` refers to another part, a role of the
bridge, or a base table. ``compose`` puts what a statement needs into WITH.
"""

from __future__ import annotations

import re

from tidemark.plans.bridge import ROLES, referenced

PARTS: dict[str, str] = {}
ORACLES: dict[str, str] = {}


def duck_text(text: str) -> str:
    text = text.replace("TS'", "TIMESTAMP '").replace("ARR(", "list_value(")
    text = text.replace("named_struct(", "struct_pack(")
    return re.sub(r"'(name|required|choices|extraPrice)', ", r"\1 := ", text)


def _collect(name: str, found: dict[str, str]) -> None:
    text = PARTS.get(name) or ROLES.get(name)
    if text is None or name in found:
        return
    for other in referenced(text):
        _collect(other, found)
    found[name] = duck_text(text)


def compose(statement: str) -> str:
    found: dict[str, str] = {}
    for name in referenced(statement):
        _collect(name, found)
    plain = lambda text: re.sub(r"\{(\w+)\}", r"\1", text)
    parts = ",\n".join(f"{name} AS ({plain(text)})" for name, text in found.items())
    return (f"WITH {parts}\n" if parts else "") + plain(duck_text(statement))


def title(value: str) -> str:
    return (f"array_to_string(list_transform(string_split(lower(trim({value})), ' '), "
            "lambda w: upper(w[1]) || w[2:]), ' ')")


def optional(value: str) -> str:
    return f"nullif(trim({value}), '')"


def utc(value: str) -> str:
    plain = f"TRY_CAST(substr({value}, 1, 19) AS TIMESTAMP)"
    return f"({plain} - CASE WHEN {value} LIKE '%+07:00' THEN INTERVAL 7 HOUR ELSE INTERVAL 0 HOUR END)"


def day_key(value: str) -> str:
    local = f"({value} + INTERVAL 7 HOUR)"
    return f"CAST(year({local}) * 10000 + month({local}) * 100 + day({local}) AS INTEGER)"


def money(value: str) -> str:
    return f"TRY_CAST({value} AS DECIMAL(12,2))"


def big(value: str) -> str:
    return f"TRY_CAST({value} AS BIGINT)"


def reasons(*pairs: tuple[str, str]) -> str:
    return "CASE " + " ".join(f"WHEN {p} THEN '{r}'" for r, p in pairs) + " END AS rejection_reason"


def blank(c: str) -> str:
    return f"({c} IS NULL OR {c} = '')"


def not_positive(c: str) -> str:
    return f"({c} IS NULL OR {c} <= 0)"


def negative(c: str) -> str:
    return f"({c} IS NULL OR {c} < 0)"


def outside(c: str, *values: str) -> str:
    listed = ", ".join(f"'{v}'" for v in values)
    return f"({c} IS NULL OR {c} NOT IN ({listed}))"


def times(created: str, updated: str) -> list[tuple[str, str]]:
    return [("INVALID_CREATED_AT", f"{created} IS NULL"),
            ("INVALID_UPDATED_AT", f"{updated} IS NULL"),
            ("UPDATED_BEFORE_CREATED", f"{updated} < {created}")]


def latest(source: str, key: str, carried: list[str], newest: str = "source_updated_at",
           where: str = "rejection_reason IS NULL") -> str:
    ties = ", ".join(f"{c} ASC NULLS FIRST" for c in carried if c not in (key, newest))
    return (f"SELECT {', '.join(carried)} FROM (SELECT *, row_number() OVER (PARTITION BY {key} "
            f"ORDER BY {newest} DESC NULLS LAST, {ties}) AS rank_no FROM {source} "
            f"WHERE {where}) WHERE rank_no = 1")


# --- judged and cleaned entities -------------------------------------------

def _customers(source: str) -> str:
    return f"""
SELECT *, {reasons(
    ("INVALID_CUSTOMER_ID", not_positive("customer_id")), ("MISSING_FULL_NAME", blank("full_name")),
    ("MISSING_EMAIL", blank("email")), ("MISSING_PHONE", blank("phone")),
    ("MISSING_CITY", blank("city")), *times("valid_from", "source_updated_at"))}
FROM (SELECT customer_id, trim(full_name) AS full_name, lower(trim(email)) AS email,
  {optional("phone")} AS phone, {title("city")} AS city, created_at AS valid_from,
  updated_at AS source_updated_at FROM {{{source}}})"""


_CUSTOMER = ["customer_id", "full_name", "email", "phone", "city", "valid_from",
             "source_updated_at"]
for _suffix in ("", "_next"):
    PARTS[f"chk_customer{_suffix}"] = _customers(f"src_customers{_suffix}")
    PARTS[f"cln_customer{_suffix}"] = f"""
SELECT *, sha256(concat_ws('||', full_name, email, coalesce(phone, '<NULL>'), city)) AS hash_diff
FROM ({latest(f"{{chk_customer{_suffix}}}", "customer_id", _CUSTOMER)})"""

PARTS["chk_restaurant"] = f"""
SELECT *, {reasons(
    ("INVALID_RESTAURANT_ID", not_positive("restaurant_id")),
    ("MISSING_RESTAURANT_NAME", blank("restaurant_name")), ("MISSING_CATEGORY", blank("category")),
    ("MISSING_CITY", blank("city")),
    ("INVALID_RESTAURANT_STATUS", outside("status", "ACTIVE", "INACTIVE")),
    *times("valid_from", "source_updated_at"))}
FROM (SELECT restaurant_id, trim(restaurant_name) AS restaurant_name,
  {title("category")} AS category, {title("city")} AS city, {optional("address")} AS address,
  upper(trim(status)) AS status, created_at AS valid_from, updated_at AS source_updated_at
  FROM {{src_restaurants}})"""
PARTS["cln_restaurant"] = f"""
SELECT *, sha256(concat_ws('||', restaurant_name, category, city, coalesce(address, '<NULL>'),
  status)) AS hash_diff
FROM ({latest("{chk_restaurant}", "restaurant_id", ["restaurant_id", "restaurant_name", "category",
  "city", "address", "status", "valid_from", "source_updated_at"])})"""

PARTS["chk_driver"] = f"""
SELECT *, {reasons(
    ("INVALID_DRIVER_ID", not_positive("driver_id")), ("MISSING_DRIVER_NAME", blank("driver_name")),
    ("MISSING_PHONE", blank("phone")), ("MISSING_NUMBER_PLATE", blank("number_plate")),
    ("INVALID_DRIVER_STATUS", outside("driver_status", "ACTIVE", "INACTIVE")),
    *times("valid_from", "source_updated_at"))}
FROM (SELECT driver_id, trim(driver_name) AS driver_name, trim(phone) AS phone,
  upper({optional("number_plate")}) AS number_plate, upper(trim(driver_status)) AS driver_status,
  created_at AS valid_from, updated_at AS source_updated_at FROM {{src_drivers}})"""
PARTS["cln_driver"] = f"""
SELECT *, sha256(concat_ws('||', driver_name, phone, number_plate, driver_status)) AS hash_diff
FROM ({latest("{chk_driver}", "driver_id", ["driver_id", "driver_name", "phone", "number_plate",
  "driver_status", "valid_from", "source_updated_at"])})"""

PARTS["chk_menu_item"] = f"""
SELECT *, {reasons(
    ("INVALID_MENU_ITEM_ID", blank("menu_item_id")),
    ("INVALID_RESTAURANT_ID", not_positive("restaurant_id")),
    ("RESTAURANT_NOT_FOUND", "known_restaurant_id IS NULL"),
    ("MISSING_MENU_ITEM_NAME", blank("menu_item_name")), ("MISSING_CATEGORY", blank("category")),
    ("INVALID_BASE_PRICE", negative("base_price")), ("INVALID_AVAILABLE_FLAG", "available IS NULL"),
    *times("valid_from", "source_updated_at"))}
FROM (SELECT trim(_id) AS menu_item_id, restaurantId AS restaurant_id, trim(name) AS menu_item_name,
  {title("category")} AS category,
  coalesce({money("basePrice")}, {money('"base_price"')}) AS base_price,
  TRY_CAST(available AS BOOLEAN) AS available,
  list_sort(coalesce(tags, [])) AS tags,
  {utc("createdAt")} AS valid_from, {utc("updatedAt")} AS source_updated_at FROM {{src_menu_items}})
LEFT JOIN (SELECT DISTINCT restaurant_id AS known_restaurant_id FROM {{src_restaurants}})
  ON restaurant_id = known_restaurant_id"""
PARTS["cln_menu_item"] = f"""
SELECT *, sha256(concat_ws('||', CAST(restaurant_id AS VARCHAR), menu_item_name, category,
  CAST(base_price AS VARCHAR), CAST(available AS VARCHAR), array_to_string(tags, ','))) AS hash_diff
FROM ({latest("{chk_menu_item}", "menu_item_id", ["menu_item_id", "restaurant_id",
  "menu_item_name", "category", "base_price", "available", "tags", "valid_from",
  "source_updated_at"])})"""

_ORDER = ["order_id", "customer_id", "restaurant_id", "delivery_address", "order_status",
          "subtotal", "discount", "delivery_fee", "total_amount", "ordered_at",
          "source_updated_at"]
PARTS["chk_order"] = f"""
SELECT *, {reasons(
    ("INVALID_ORDER_ID", not_positive("order_id")),
    ("INVALID_CUSTOMER_ID", not_positive("customer_id")),
    ("INVALID_RESTAURANT_ID", not_positive("restaurant_id")),
    ("MISSING_DELIVERY_ADDRESS", blank("delivery_address")),
    ("INVALID_ORDER_STATUS", outside("order_status", "DELIVERED", "CANCELLED", "PREPARING")),
    ("INVALID_SUBTOTAL", negative("subtotal")), ("INVALID_DISCOUNT", negative("discount")),
    ("INVALID_DELIVERY_FEE", negative("delivery_fee")),
    ("INVALID_TOTAL_AMOUNT", negative("total_amount")),
    ("INVALID_ORDERED_AT", "ordered_at IS NULL"), *times("created_at", "source_updated_at"))}
FROM (SELECT *, CAST(subtotal - discount + delivery_fee AS DECIMAL(12,2)) AS total_amount FROM (
  SELECT {big("order_id")} AS order_id, customer_id, restaurant_id,
  trim(delivery_address) AS delivery_address, upper(trim(order_status)) AS order_status,
  {money("subtotal")} AS subtotal, discount, delivery_fee, total_amount AS source_total_amount,
  ordered_at, created_at, updated_at AS source_updated_at FROM {{src_orders}}))"""
PARTS["cln_order"] = f"""
SELECT *, {day_key("ordered_at")} AS order_date_key
FROM ({latest("{chk_order}", "order_id", _ORDER)})"""

PARTS["parent_order"] = latest(
    f"""(SELECT {big("order_id")} AS lookup_order_id, customer_id, restaurant_id,
    CAST({money("subtotal")} - discount + delivery_fee AS DECIMAL(12,2)) AS expected_payment_amount,
    ordered_at, updated_at FROM {{src_orders}})""", "lookup_order_id",
    ["lookup_order_id", "customer_id", "restaurant_id", "expected_payment_amount", "ordered_at"],
    "updated_at", "lookup_order_id IS NOT NULL")
PARTS["menu_home"] = latest(
    f"""(SELECT trim(_id) AS lookup_menu_item_id, restaurantId AS menu_restaurant_id,
    {utc("updatedAt")} AS updated FROM {{src_menu_items}})""", "lookup_menu_item_id",
    ["lookup_menu_item_id", "menu_restaurant_id"], "updated", "lookup_menu_item_id IS NOT NULL")

_ITEM = ["order_item_id", "order_id", "customer_id", "restaurant_id", "menu_item_id", "quantity",
         "unit_price", "total_price", "ordered_at", "source_updated_at"]
PARTS["chk_order_item"] = f"""
SELECT *, {reasons(
    ("INVALID_ORDER_ITEM_ID", not_positive("order_item_id")),
    ("ORDER_NOT_FOUND", "lookup_order_id IS NULL"),
    ("INVALID_MENU_ITEM_ID", blank("menu_item_id")),
    ("MENU_ITEM_NOT_FOUND", "lookup_menu_item_id IS NULL"),
    ("MENU_RESTAURANT_MISMATCH", "restaurant_id IS DISTINCT FROM menu_restaurant_id"),
    ("MISSING_MENU_ITEM_NAME", blank("menu_item_name")),
    ("INVALID_QUANTITY", not_positive("quantity")), ("INVALID_UNIT_PRICE", negative("unit_price")),
    ("INVALID_TOTAL_PRICE", negative("total_price")), ("INVALID_ORDERED_AT", "ordered_at IS NULL"),
    *times("created_at", "source_updated_at"))}
FROM (SELECT *, CAST(quantity * unit_price AS DECIMAL(12,2)) AS total_price FROM (
  SELECT order_item_id, order_id, trim(menu_item_id) AS menu_item_id,
  trim(menu_item_name) AS menu_item_name, TRY_CAST(quantity AS INTEGER) AS quantity, unit_price,
  created_at, updated_at AS source_updated_at FROM {{src_order_items}}))
LEFT JOIN {{parent_order}} ON order_id = lookup_order_id
LEFT JOIN {{menu_home}} ON menu_item_id = lookup_menu_item_id"""
PARTS["cln_order_item"] = f"""
SELECT *, {day_key("ordered_at")} AS order_date_key
FROM ({latest("{chk_order_item}", "order_item_id", _ITEM)})"""

_PAYMENT = ["payment_id", "order_id", "customer_id", "restaurant_id", "payment_method",
            "payment_status", "amount", "transaction_ref", "payment_created_at", "paid_at",
            "source_updated_at"]
PARTS["pre_payment"] = f"""
SELECT * FROM (SELECT payment_id, order_id, upper(trim(payment_method)) AS payment_method,
  upper(trim(payment_status)) AS payment_status, {money("amount")} AS amount,
  {optional("transaction_ref")} AS transaction_ref, created_at AS payment_created_at, paid_at,
  updated_at AS source_updated_at FROM {{src_payments}})
LEFT JOIN (SELECT lookup_order_id, customer_id, restaurant_id, expected_payment_amount
  FROM {{parent_order}}) ON order_id = lookup_order_id"""


def _payment_reasons(method: str, status: str) -> str:
    return reasons(
        ("INVALID_PAYMENT_ID", not_positive("payment_id")),
        ("ORDER_NOT_FOUND", "lookup_order_id IS NULL"), ("INVALID_PAYMENT_METHOD", method),
        ("INVALID_PAYMENT_STATUS", status), ("INVALID_PAYMENT_AMOUNT", negative("amount")),
        ("INVALID_ORDER_AMOUNT", "expected_payment_amount IS NULL"),
        ("PAYMENT_AMOUNT_MISMATCH", "amount <> expected_payment_amount"),
        ("MISSING_TRANSACTION_REFERENCE", "payment_method <> 'CASH' AND transaction_ref IS NULL"),
        ("INVALID_PAYMENT_CREATED_AT", "payment_created_at IS NULL"),
        ("INVALID_UPDATED_AT", "source_updated_at IS NULL"),
        ("UPDATED_BEFORE_CREATED", "source_updated_at < payment_created_at"),
        ("PENDING_PAYMENT_HAS_PAID_AT", "payment_status = 'PENDING' AND paid_at IS NOT NULL"),
        ("MISSING_PAID_AT", "payment_status IN ('PAID', 'REFUNDED') AND paid_at IS NULL"),
        ("PAID_BEFORE_CREATED", "paid_at < payment_created_at"))


_METHODS, _STATES = ("CARD", "PROMPTPAY", "CASH", "WALLET"), ("PAID", "PENDING", "REFUNDED")
PARTS["chk_payment"] = "SELECT *, " + _payment_reasons(
    outside("payment_method", *_METHODS), outside("payment_status", *_STATES)
) + " FROM {pre_payment}"
PARTS["cln_payment"] = f"""
SELECT *, {day_key("payment_created_at")} AS payment_created_date_key,
  coalesce({day_key("paid_at")}, 0) AS paid_date_key
FROM ({latest("{chk_payment}", "payment_id", _PAYMENT)})"""

_DELIVERY = ["delivery_id", "order_id", "customer_id", "restaurant_id", "driver_id",
             "delivery_status", "distance_km", "assigned_at", "picked_up_at", "delivered_at",
             "source_updated_at"]
PARTS["chk_delivery"] = f"""
SELECT *, {reasons(
    ("INVALID_DELIVERY_ID", not_positive("delivery_id")),
    ("ORDER_NOT_FOUND", "order_id IS NULL OR customer_id IS NULL OR restaurant_id IS NULL"),
    ("INVALID_DRIVER_ID", not_positive("driver_id")),
    ("INVALID_DELIVERY_STATUS", outside("delivery_status", "ASSIGNED", "DELIVERED")),
    ("INVALID_DISTANCE", "distance_km IS NULL OR distance_km <= 0 OR distance_km > 200"),
    ("INVALID_ASSIGNED_AT", "assigned_at IS NULL"), ("INVALID_UPDATED_AT", "source_updated_at IS NULL"),
    ("PICKED_UP_BEFORE_ASSIGNED", "picked_up_at < assigned_at"),
    ("DELIVERED_WITHOUT_PICKUP", "delivered_at IS NOT NULL AND picked_up_at IS NULL"),
    ("DELIVERED_BEFORE_PICKUP", "delivered_at < picked_up_at"),
    ("MISSING_DELIVERED_AT", "delivery_status = 'DELIVERED' AND delivered_at IS NULL"))}
FROM (SELECT delivery_id, order_id, driver_id, upper(trim(delivery_status)) AS delivery_status,
  TRY_CAST(distance_km AS DECIMAL(8,2)) AS distance_km, assigned_at, picked_up_at, delivered_at,
  updated_at AS source_updated_at FROM {{src_deliveries}})
LEFT JOIN (SELECT lookup_order_id, customer_id, restaurant_id FROM {{parent_order}})
  ON order_id = lookup_order_id"""
PARTS["cln_delivery"] = f"""
SELECT *, {day_key("assigned_at")} AS assigned_date_key
FROM ({latest("{chk_delivery}", "delivery_id", _DELIVERY)})"""

_KEYS = {"customer": ("customers", "customer_id"), "restaurant": ("restaurants", "restaurant_id"),
         "driver": ("drivers", "driver_id"), "menu_item": ("menu_items", "menu_item_id"),
         "order": ("orders", "order_id"), "order_item": ("order_items", "order_item_id"),
         "payment": ("payments", "payment_id"), "delivery": ("deliveries", "delivery_id")}
for _name, (_source, _key) in _KEYS.items():
    ORACLES[f"reject_reasons_{_name}"] = (
        f"SELECT {_key}, source_updated_at, rejection_reason FROM {{chk_{_name}}}")
    ORACLES[f"clean_{_source}"] = f"SELECT * FROM {{cln_{_name}}}"
ORACLES["clean_menu_items"] = (
    "SELECT * REPLACE (array_to_string(tags, ',') AS tags) FROM {cln_menu_item}")
_listed = lambda values: ", ".join(f"'{v}'" for v in values)
ORACLES["reject_reasons_null_passes"] = (
    "SELECT payment_id, source_updated_at, " + _payment_reasons(
        f"payment_method NOT IN ({_listed(_METHODS)})",
        f"payment_status NOT IN ({_listed(_STATES)})") + " FROM {pre_payment}")
ORACLES["quarantine_counts"] = " UNION ALL ".join(
    f"SELECT '{n}' AS entity, rejection_reason, count(*) AS rejected_rows FROM {{chk_{n}}} "
    "WHERE rejection_reason IS NOT NULL GROUP BY rejection_reason" for n in _KEYS)
ORACLES["batch_counts"] = " UNION ALL ".join(
    f"SELECT '{n}' AS entity, count(*) AS input_rows, count(*) - count(rejection_reason) AS "
    f"valid_rows, count(rejection_reason) AS rejected_rows FROM {{chk_{n}}}"
    for n in _KEYS)

# --- sources ---------------------------------------------------------------

ORACLES["watermark_probe"] = "SELECT max(ts) AS watermark_to FROM {events}"
_EVENT = "SELECT event_id, ts, user_id, event_type, value FROM {events} WHERE ts > TIMESTAMP "
ORACLES["incremental_window"] = (
    _EVENT + "'2024-01-08 00:00:00' AND ts <= TIMESTAMP '2024-01-20 12:00:00'")
ORACLES["incremental_lookback"] = (
    _EVENT + "'2024-01-05 00:00:00' AND ts <= TIMESTAMP '2024-01-20 12:00:00'")
ORACLES["doc_scan"] = """
SELECT _id, restaurantId, name, category, "basePrice", "base_price", available,
  array_to_string(tags, ',') AS tags_text, coalesce(len(options), 0) AS n_options, createdAt,
  updatedAt FROM {src_menu_items}"""
ORACLES["doc_watermark"] = f"SELECT max({utc('updatedAt')}) AS watermark_to FROM {{src_menu_items}}"
ORACLES["doc_incremental"] = f"""
SELECT _id, restaurantId, name, updatedAt FROM {{src_menu_items}}
WHERE {utc('updatedAt')} > TIMESTAMP '2024-03-01 00:00:00'
  AND {utc('updatedAt')} <= TIMESTAMP '2024-08-15 10:30:00'"""
ORACLES["stage_projection"] = "SELECT 'batch-7' AS batch_id, * FROM {cln_order}"
ORACLES["staging_purge"] = """
SELECT 'batch-2' AS batch_id, payment_id, order_id, amount FROM {cln_payment}
WHERE payment_status <> 'PENDING'"""

# --- projections -----------------------------------------------------------

ORACLES["safe_casts"] = """
SELECT l_orderkey, l_linenumber, l_partkey,
  CASE WHEN l_returnflag <> 'R' THEN l_orderkey END AS as_long,
  CASE WHEN l_linestatus <> 'F' THEN l_linenumber END AS as_int,
  CASE WHEN l_tax <> 0 THEN CAST(l_extendedprice AS DECIMAL(12,2)) END AS as_money,
  CASE WHEN l_discount <> 0 THEN CAST(l_quantity AS DECIMAL(8,2)) END AS as_distance,
  CASE l_returnflag WHEN 'A' THEN true WHEN 'R' THEN false END AS as_boolean
FROM {lineitem}"""
ORACLES["safe_timestamps"] = f"""
SELECT _id, {utc('createdAt')} AS created_utc, {utc('updatedAt')} AS updated_utc
FROM {{src_menu_items}}"""
ORACLES["text_normalize"] = f"""
SELECT customer_id, updated_at, trim(full_name) AS trimmed, upper(trim(city)) AS code,
  lower(trim(email)) AS email, {title('city')} AS title, {optional('phone')} AS optional
FROM {{src_customers}}"""
ORACLES["schema_drift"] = f"""
SELECT _id, coalesce({money('"basePrice"')}, {money('"base_price"')}) AS price,
  {money('"base_price"')} AS legacy_price, CAST(NULL AS DECIMAL(12,2)) AS no_price
FROM {{src_menu_items}}"""
ORACLES["array_normalize"] = """
SELECT _id, array_to_string(tags, ',') AS tags_text, len(tags) AS n_tags,
  array_to_string(list_transform(tags, lambda x: coalesce(x, '?')), ',') AS tags_with_nulls
FROM (SELECT _id, list_sort(coalesce(tags, [])) AS tags FROM {src_menu_items})"""
ORACLES["json_roundtrip"] = """
SELECT id, tags_json, array_to_string(tags, '|') AS tags_text, len(tags) AS n_tags FROM (
  SELECT trim(_id) AS id, CAST(to_json(list_sort(coalesce(tags, []))) AS VARCHAR) AS tags_json,
    list_sort(coalesce(tags, [])) AS tags FROM {src_menu_items}
  UNION ALL
  SELECT 'event-' || event_id, '[' || regexp_extract(props, '[0-9]+') || ']',
    [regexp_extract(props, '[0-9]+')] FROM {events})"""
ORACLES["order_totals"] = """
SELECT order_id, customer_id, order_status, source_updated_at, source_total_amount, total_amount,
  source_total_amount <> total_amount AS total_was_corrected FROM {chk_order}"""
ORACLES["line_totals"] = """
SELECT order_item_id, created_at, menu_item_id, quantity, unit_price, line_total,
  total_price <> line_total AS was_corrected
FROM (SELECT *, CAST(quantity * unit_price AS DECIMAL(12,2)) AS line_total FROM (
  SELECT order_item_id, created_at, menu_item_id, TRY_CAST(quantity AS INTEGER) AS quantity,
    unit_price, total_price FROM {src_order_items}))"""
ORACLES["business_date_key"] = f"""
SELECT kind, id, {day_key('moment')} AS date_key, coalesce({day_key('moment')}, 0) AS
  date_key_or_unknown
FROM (SELECT 'event' AS kind, event_id AS id, CASE WHEN event_type <> 'error' THEN ts END AS moment
  FROM {{events}} UNION ALL SELECT 'order', k, placed FROM {{order_base}})"""
ORACLES["change_hash"] = """
SELECT 'restaurant' AS kind, restaurant_id AS id, hash_diff FROM {cln_restaurant}
UNION ALL SELECT 'customer', customer_id, hash_diff FROM {cln_customer}"""
PARTS["options"] = """
SELECT item || '-' || pos AS menu_option_id, item AS menu_item_id, trim(o.name) AS option_name,
  o.required AS required, o.choices AS choices
FROM (SELECT trim(_id) AS item, unnest(options) AS o, unnest(range(1, len(options) + 1)) AS pos
  FROM {src_menu_items})"""
ORACLES["flatten_options"] = (
    "SELECT menu_option_id, menu_item_id, option_name, required FROM {options}")
ORACLES["flatten_choices"] = """
SELECT menu_option_id || '-' || pos AS choice_id, menu_option_id, trim(c.name) AS choice_name,
  c.extraPrice AS extra_price
FROM (SELECT menu_option_id, unnest(choices) AS c, unnest(range(1, len(choices) + 1)) AS pos
  FROM {options})"""
ORACLES["dedup_latest"] = latest(
    "{lineitem}", "l_orderkey, l_linenumber",
    ["l_orderkey", "l_linenumber", "l_shipdate", "l_partkey", "l_suppkey", "l_quantity"],
    "l_shipdate", "true").replace(
        "l_orderkey ASC NULLS FIRST, l_linenumber ASC NULLS FIRST, ", "").replace(
        "l_quantity ASC NULLS FIRST", "l_quantity ASC NULLS FIRST, l_extendedprice ASC NULLS FIRST")

# --- lookups and point in time ---------------------------------------------

ORACLES["lookup_exists"] = """
SELECT menu_item_id, restaurant_id, known_restaurant_id,
  known_restaurant_id IS NOT NULL AS restaurant_known FROM {chk_menu_item}"""
ORACLES["lookup_enrich"] = "SELECT delivery_id, order_id, customer_id, restaurant_id FROM {chk_delivery}"
ORACLES["lookup_two_sources"] = """
SELECT order_item_id, source_updated_at, lookup_order_id, customer_id, restaurant_id, ordered_at,
  lookup_menu_item_id, menu_restaurant_id FROM {chk_order_item}"""


def as_of(alias: str, dimension: str, key: str, event: str, moment: str) -> str:
    return (f"LEFT JOIN {{{dimension}}} {alias} ON {alias}.{key} = {event}.{key} "
            f"AND {event}.{moment} >= {alias}.valid_from "
            f"AND ({alias}.valid_to IS NULL OR {event}.{moment} < {alias}.valid_to)")


PARTS["placed_order"] = (
    "SELECT k AS order_id, cust AS customer_id, placed AS ordered_at FROM {order_base}")
ORACLES["asof_join"] = ORACLES["asof_join_sorted"] = (
    "SELECT e.*, coalesce(c.customer_key, 0) AS customer_key FROM {placed_order} e "
    + as_of("c", "hist_customer", "customer_id", "e", "ordered_at"))
ORACLES["asof_join_busy"] = """
SELECT e.event_id, e.user_id, e.ts, coalesce(v.event_id, 0) AS user_key FROM {events} e
LEFT JOIN (SELECT user_id, event_id, ts AS valid_from,
    lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS valid_to
  FROM {events} WHERE event_type = 'purchase') v
ON v.user_id = e.user_id AND e.ts >= v.valid_from AND (v.valid_to IS NULL OR e.ts < v.valid_to)"""

PARTS["calendar"] = """
SELECT CAST(strftime(day, '%Y%m%d') AS INTEGER) AS date_key, CAST(day AS DATE) AS full_date,
  CAST(day(day) AS INTEGER) AS day_of_month, CAST(isodow(day) AS INTEGER) AS day_of_week,
  strftime(day, '%a') AS day_name, CAST(weekofyear(day) AS INTEGER) AS week_of_year,
  CAST(month(day) AS INTEGER) AS month_number, strftime(day, '%b') AS month_name,
  CAST(quarter(day) AS INTEGER) AS quarter_number, CAST(year(day) AS INTEGER) AS year_number,
  isodow(day) >= 6 AS is_weekend
FROM (SELECT unnest(generate_series(TIMESTAMP '2020-01-01', TIMESTAMP '2035-12-31', INTERVAL 1 DAY)) AS day)
UNION ALL SELECT 0, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL"""
PARTS["methods"] = """
SELECT * FROM (VALUES (0, 'UNKNOWN', 'Unknown', true), (1, 'CARD', 'Card', true),
  (2, 'PROMPTPAY', 'PromptPay', true), (3, 'CASH', 'Cash', true), (4, 'WALLET', 'Wallet', true))
  AS m(payment_method_key, payment_method_code, payment_method_name, is_active)"""


def resolved(name: str, moment: str, dimensions: list[str], dates: list[str], plain: str,
             methods: bool = False) -> str:
    keys = ", ".join(f"coalesce({d}.{d}_key, 0) AS {d}_key" for d in dimensions)
    days = ", ".join(f"coalesce(d{i}.date_key, 0) AS {d}" for i, d in enumerate(dates))
    joins = " ".join(as_of(d, f"hist_{d}", f"{d}_id", "e", moment) for d in dimensions)
    joins += " " + " ".join(
        f"LEFT JOIN {{calendar}} d{i} ON d{i}.date_key = e.{d}" for i, d in enumerate(dates))
    if methods:
        keys += ", coalesce(m.payment_method_key, 0) AS payment_method_key"
        joins += " LEFT JOIN {methods} m ON m.payment_method_code = e.payment_method"
    columns = ", ".join(f"e.{c.strip()}" for c in plain.split(","))
    return f"SELECT {columns}, {keys}, {days} FROM {{cln_{name}}} e {joins}"


PARTS["fact_item"] = resolved(
    "order_item", "ordered_at", ["customer", "restaurant", "menu_item"], ["order_date_key"],
    "order_item_id, order_id, quantity, unit_price, total_price, ordered_at, source_updated_at")
ORACLES["resolve_keys_order_item"] = "SELECT * FROM {fact_item}"
ORACLES["resolve_keys_order"] = resolved(
    "order", "ordered_at", ["customer", "restaurant"], ["order_date_key"],
    "order_id, delivery_address, order_status, subtotal, discount, delivery_fee, total_amount, "
    "ordered_at, source_updated_at")
ORACLES["resolve_keys_payment"] = resolved(
    "payment", "payment_created_at", ["customer", "restaurant"],
    ["payment_created_date_key", "paid_date_key"],
    "payment_id, order_id, payment_status, amount, transaction_ref, payment_created_at, paid_at, "
    "source_updated_at", methods=True)
ORACLES["resolve_keys_delivery"] = resolved(
    "delivery", "assigned_at", ["customer", "restaurant", "driver"], ["assigned_date_key"],
    "delivery_id, order_id, delivery_status, distance_km, assigned_at, picked_up_at, delivered_at, "
    "source_updated_at")
ORACLES["hourly_item_sales"] = """
SELECT CAST(hour(ordered_at + INTERVAL 7 HOUR) AS INTEGER) AS local_hour, f.menu_item_key,
  coalesce(max(m.menu_item_id), 'UNKNOWN') AS menu_item_id,
  coalesce(max(m.menu_item_name), 'Unknown') AS menu_item_name, count(*) AS order_lines,
  CAST(sum(quantity) AS BIGINT) AS quantity, CAST(sum(total_price) AS DECIMAL(18,2)) AS revenue
FROM {fact_item} f LEFT JOIN {hist_menu_item} m ON m.menu_item_key = f.menu_item_key
GROUP BY 1, 2"""
ORACLES["ambiguous_versions"] = """
SELECT order_id, 'customer_key' AS dimension FROM {placed_order} e JOIN {bad_dim_customer} c
ON c.customer_id = e.customer_id AND e.ordered_at >= c.valid_from
  AND (c.valid_to IS NULL OR e.ordered_at < c.valid_to)
GROUP BY order_id HAVING count(*) > 1"""
ORACLES["version_overlaps"] = """
SELECT customer_id, valid_from AS overlap_from,
  nullif(least(ends, previous_end), TIMESTAMP '9999-12-31') AS overlap_to
FROM (SELECT *, max(ends) OVER (PARTITION BY customer_id ORDER BY valid_from, ends
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous_end
  FROM (SELECT customer_id, valid_from, coalesce(valid_to, TIMESTAMP '9999-12-31') AS ends
    FROM {bad_dim_customer}) WHERE ends > valid_from)
WHERE valid_from < previous_end"""
ORACLES["uniqueness_conflicts"] = """
SELECT number_plate AS value, 'batch' AS conflict FROM {cln_driver}
GROUP BY number_plate HAVING count(DISTINCT driver_id) > 1
UNION ALL
SELECT DISTINCT s.number_plate, 'current' FROM {cln_driver} s JOIN {hist_driver} h
ON h.is_current AND 'BKK-' || lpad(CAST(h.driver_id AS VARCHAR), 5, '0') = s.number_plate
  AND h.driver_id <> s.driver_id"""

# --- dimensions ------------------------------------------------------------

PARTS["start_dim"] = """
SELECT customer_id, phone, city, valid_from, CAST(NULL AS TIMESTAMP) AS valid_to,
  true AS is_current, hash_diff, source_updated_at, 'batch-1' AS batch_id
FROM {cln_customer} WHERE city <> 'Nation_4'"""
PARTS["closed_dim"] = """
SELECT t.customer_id, t.phone, t.city, t.valid_from, s.source_updated_at AS valid_to,
  false AS is_current, t.hash_diff, t.source_updated_at, t.batch_id
FROM {start_dim} t JOIN {cln_customer_next} s ON s.customer_id = t.customer_id
WHERE t.is_current AND t.hash_diff <> s.hash_diff AND s.source_updated_at > t.source_updated_at
  AND s.source_updated_at > t.valid_from"""
PARTS["inserted_dim"] = """
SELECT s.customer_id, s.phone, s.city,
  CASE WHEN s.customer_id IN (SELECT customer_id FROM {start_dim}) THEN s.source_updated_at
       ELSE s.valid_from END AS valid_from,
  CAST(NULL AS TIMESTAMP) AS valid_to, true AS is_current, s.hash_diff, s.source_updated_at,
  'batch-2' AS batch_id
FROM {cln_customer_next} s
WHERE s.customer_id NOT IN (SELECT customer_id FROM {start_dim})
  OR s.customer_id IN (SELECT customer_id FROM {closed_dim})"""
ORACLES["scd2_closes"] = "SELECT * FROM {closed_dim}"
ORACLES["scd2_inserts"] = "SELECT * FROM {inserted_dim}"
ORACLES["scd2_apply"] = ORACLES["scd2_replay"] = """
SELECT * FROM {start_dim} WHERE customer_id NOT IN (SELECT customer_id FROM {closed_dim})
UNION ALL SELECT * FROM {closed_dim} UNION ALL SELECT * FROM {inserted_dim}"""
ORACLES["surrogate_keys"] = """
SELECT order_id, customer_id, 1000 + row_number() OVER (
  ORDER BY substr(md5(CAST(order_id AS VARCHAR)), 1, 3), order_id) AS order_key FROM {cln_order}"""


def _seed(name: str) -> str:
    shown = f"""SELECT '{name}' AS dimension, {{0}} AS is_unknown, count(*) AS members,
  max({name}_key) AS top_key, min(valid_from) AS first_from, min(hash_diff) AS low_hash FROM """
    return (shown.format("false") + f"{{hist_{name}}} UNION ALL SELECT '{name}', true, 1, 0, "
            "TIMESTAMP '1900-01-01', repeat('0', 64)")


ORACLES["seed_idempotent"] = " UNION ALL ".join(
    _seed(n) for n in ("customer", "restaurant", "driver", "menu_item"))
ORACLES["unknown_members"] = """
SELECT * FROM {hist_customer}
UNION ALL SELECT 0, 0, 'Unknown', 'unknown@invalid', 'UNKNOWN', 'Unknown', TIMESTAMP '1900-01-01',
  NULL, true, repeat('0', 64), TIMESTAMP '1900-01-01', '00000000-0000-0000-0000-000000000001'"""
ORACLES["dim_payment_method"] = """
SELECT m.*, p.payments, p.amount FROM {methods} m LEFT JOIN (
  SELECT payment_method, count(*) AS payments, CAST(sum(amount) AS DECIMAL(18,2)) AS amount
  FROM {cln_payment} GROUP BY payment_method) p ON p.payment_method = m.payment_method_code"""
ORACLES["dim_date"] = f"""
SELECT c.*, o.orders FROM {{calendar}} c LEFT JOIN (
  SELECT {day_key('placed')} AS placed_key, count(*) AS orders FROM {{order_base}} GROUP BY 1) o
ON o.placed_key = c.date_key"""

# --- facts -----------------------------------------------------------------

PARTS["overwritten"] = """
SELECT n.order_id, o.order_key FROM {new_fact_order} n JOIN {old_fact_order} o USING (order_id)
WHERE n.source_updated_at >= o.source_updated_at AND (n.source_updated_at > o.source_updated_at
  OR n.customer_key <> o.customer_key OR n.restaurant_key <> o.restaurant_key
  OR n.order_date_key <> o.order_date_key)"""
ORACLES["fact_updates"] = (
    "SELECT n.*, w.order_key FROM {new_fact_order} n JOIN {overwritten} w USING (order_id)")
ORACLES["fact_inserts"] = """
SELECT * FROM {new_fact_order} n
WHERE NOT EXISTS (SELECT 1 FROM {old_fact_order} o WHERE o.order_id = n.order_id)"""
ORACLES["fact_upsert"] = """
SELECT * FROM {old_fact_order} WHERE order_id NOT IN (SELECT order_id FROM {overwritten})
UNION ALL BY NAME
SELECT n.*, w.order_key FROM {new_fact_order} n JOIN {overwritten} w USING (order_id)
UNION ALL BY NAME
SELECT *, CAST(NULL AS BIGINT) AS order_key FROM {new_fact_order} n
WHERE NOT EXISTS (SELECT 1 FROM {old_fact_order} o WHERE o.order_id = n.order_id)"""
ORACLES["fact_key_repair"] = """
SELECT order_id, w.order_key, o.customer_key AS old_customer_key, n.customer_key,
  n.source_updated_at
FROM {new_fact_order} n JOIN {overwritten} w USING (order_id) JOIN {old_fact_order} o USING (order_id)
WHERE n.source_updated_at = o.source_updated_at"""

# --- ledger and jobs -------------------------------------------------------

PARTS["batches"] = """
SELECT * FROM {ledger_revisions} r WHERE revision = (
  SELECT max(revision) FROM {ledger_revisions} x WHERE x.batch_id = r.batch_id)"""
ORACLES["ledger_status"] = """
SELECT batch_id, pipeline_name, batch_status, started_at, completed_at, loaded_row_count,
  rejected_row_count, error_message,
  CASE WHEN rejected_row_count > 0 THEN 'PARTIAL' ELSE 'SUCCEEDED' END AS status_if_completed
FROM {batches}"""
ORACLES["last_watermark"] = """
SELECT pipeline_name, mysql_watermark_to AS watermark FROM (
  SELECT *, row_number() OVER (PARTITION BY pipeline_name
    ORDER BY completed_at DESC, started_at DESC) AS place FROM {batches}
  WHERE batch_status IN ('SUCCEEDED', 'PARTIAL') AND mysql_watermark_to IS NOT NULL)
WHERE place = 1"""
ORACLES["recent_batches_ok"] = """
SELECT 'latest_etl_batches_succeeded' AS check_name,
  CAST(coalesce(sum(CASE WHEN batch_status IN ('SUCCEEDED', 'PARTIAL') THEN 0 ELSE 1 END), 0)
    + greatest(8 - count(*), 0) AS BIGINT) AS violations
FROM (SELECT batch_status FROM {batches} ORDER BY started_at DESC, batch_id DESC LIMIT 8)"""

PARTS["win_customer"] = """
SELECT * FROM {chk_customer} WHERE source_updated_at > TIMESTAMP '1900-01-01'"""
PARTS["one_customer"] = f"""
SELECT *, sha256(concat_ws('||', full_name, email, coalesce(phone, '<NULL>'), city)) AS hash_diff
FROM ({latest("{win_customer}", "customer_id", _CUSTOMER)})"""
PARTS["win_customer_next"] = """
SELECT * FROM {chk_customer_next}
WHERE source_updated_at > (SELECT max(updated_at) FROM {src_customers})"""
PARTS["two_customer"] = f"""
SELECT *, sha256(concat_ws('||', full_name, email, coalesce(phone, '<NULL>'), city)) AS hash_diff
FROM ({latest("{win_customer_next}", "customer_id", _CUSTOMER)})"""
PARTS["job_closed"] = """
SELECT t.customer_id, s.source_updated_at AS ended FROM {one_customer} t
JOIN {two_customer} s ON s.customer_id = t.customer_id
WHERE t.hash_diff <> s.hash_diff AND s.source_updated_at > t.source_updated_at
  AND s.source_updated_at > t.valid_from"""
ORACLES["run_dimension"] = """
SELECT t.customer_id, t.phone, t.city, t.valid_from, c.ended AS valid_to,
  c.ended IS NULL AS is_current, t.hash_diff, t.source_updated_at
FROM {one_customer} t LEFT JOIN {job_closed} c ON c.customer_id = t.customer_id
UNION ALL
SELECT s.customer_id, s.phone, s.city,
  CASE WHEN t.customer_id IS NULL THEN s.valid_from ELSE s.source_updated_at END,
  NULL, true, s.hash_diff, s.source_updated_at
FROM {two_customer} s LEFT JOIN {one_customer} t ON t.customer_id = s.customer_id
LEFT JOIN {job_closed} c ON c.customer_id = s.customer_id
WHERE t.customer_id IS NULL OR c.customer_id IS NOT NULL"""
PARTS["one_restaurant"] = "SELECT * FROM {cln_restaurant}"
ORACLES["run_fact"] = """
SELECT o.order_id, c.customer_id, r.restaurant_id, coalesce(d.date_key, 0) AS order_date_key,
  o.order_status, o.total_amount, o.ordered_at, o.source_updated_at
FROM {cln_order} o
LEFT JOIN {one_customer} c ON c.customer_id = o.customer_id AND o.ordered_at >= c.valid_from
LEFT JOIN {one_restaurant} r ON r.restaurant_id = o.restaurant_id AND o.ordered_at >= r.valid_from
LEFT JOIN {calendar} d ON d.date_key = o.order_date_key"""

# --- checks ----------------------------------------------------------------

_WAREHOUSE = {"dim_customer": "bad_dim_customer", "dim_driver": "bad_dim_driver",
              "dim_restaurant": "hist_restaurant", "dim_menu_item": "hist_menu_item",
              "fact_order": "bad_fact_order", "fact_order_item": "bad_fact_order_item",
              "fact_payment": "bad_fact_payment", "fact_delivery_attempt": "bad_fact_delivery"}
_IDS = {"dim_customer": "customer", "dim_restaurant": "restaurant", "dim_driver": "driver",
        "dim_menu_item": "menu_item"}


def count_where(name: str, table: str, condition: str) -> str:
    return (f"SELECT '{name}' AS check_name, count(*) AS violations FROM {{{table}}} "
            f"WHERE {condition}")


def count_groups(name: str, table: str, keys: str, having: str = "count(*) > 1",
                 where: str = "true") -> str:
    return (f"SELECT '{name}' AS check_name, count(*) AS violations FROM (SELECT {keys} FROM "
            f"{{{table}}} WHERE {where} GROUP BY {keys} HAVING {having})")


def all_of(statements) -> str:
    return " UNION ALL ".join(statements)


ORACLES["dq_one_current"] = all_of(
    count_groups(f"{e}_has_at_most_one_current_version", _WAREHOUSE[t], f"{e}_id",
                 where="is_current") for t, e in _IDS.items())
ORACLES["dq_unique_current"] = all_of([
    count_groups("current_customer_email_is_unique", "bad_dim_customer", "lower(trim(email))",
                 "count(DISTINCT customer_id) > 1", "is_current"),
    count_groups("current_driver_number_plate_is_unique", "bad_dim_driver",
                 "upper(trim(number_plate))", "count(DISTINCT driver_id) > 1", "is_current")])
_empty = lambda c: f"({c} IS NULL OR length(trim({c})) = 0)"
ORACLES["dq_required"] = all_of([
    count_where("customer_contacts_are_present", "bad_dim_customer",
                f"{_empty('email')} OR {_empty('phone')}"),
    count_where("driver_identity_fields_are_present", "bad_dim_driver",
                f"{_empty('phone')} OR {_empty('number_plate')}"),
    count_where("fact_order_delivery_address_is_present", "bad_fact_order",
                _empty("delivery_address"))])
ORACLES["dq_current_open"] = all_of(
    count_where(f"current_{e}_has_null_valid_to", _WAREHOUSE[t],
                "is_current AND valid_to IS NOT NULL") for t, e in _IDS.items())
_FACT_KEYS = {
    "fact_order": ("fact_order_foreign_keys_are_not_null", "customer_key restaurant_key order_date_key"),
    "fact_order_item": ("fact_order_item_foreign_keys_are_not_null",
                        "customer_key restaurant_key menu_item_key order_date_key"),
    "fact_payment": ("fact_payment_foreign_keys_are_not_null",
                     "customer_key restaurant_key payment_method_key payment_created_date_key paid_date_key"),
    "fact_delivery_attempt": ("fact_delivery_foreign_keys_are_not_null",
                              "customer_key restaurant_key driver_key assigned_date_key"),
}
ORACLES["dq_fact_keys"] = all_of(
    count_where(name, _WAREHOUSE[t], " OR ".join(f"{c} IS NULL" for c in f"{keys} batch_id".split()))
    for t, (name, keys) in _FACT_KEYS.items())
ORACLES["staging_empty"] = (
    "SELECT 'staging_tables_are_empty' AS check_name, CAST("
    + " + ".join(f"(SELECT count(*) FROM {{cln_{n}}})" for n in _KEYS) + " AS BIGINT) AS violations")

_COLUMNS = {
    "dim_customer": "customer_key customer_id full_name email phone city valid_from is_current "
                    "hash_diff source_updated_at batch_id",
    "dim_driver": "driver_key driver_id driver_name phone number_plate driver_status valid_from "
                  "is_current hash_diff source_updated_at batch_id",
    "dim_restaurant": "restaurant_key restaurant_id restaurant_name category city status valid_from "
                      "is_current hash_diff source_updated_at batch_id",
    "dim_menu_item": "menu_item_key menu_item_id restaurant_id menu_item_name category base_price "
                     "available valid_from is_current hash_diff source_updated_at batch_id",
    "fact_order": "order_key order_id customer_key restaurant_key delivery_address order_date_key "
                  "order_status subtotal discount delivery_fee total_amount ordered_at "
                  "source_updated_at batch_id",
    "fact_order_item": "order_item_id order_id customer_key restaurant_key menu_item_key "
                       "order_date_key quantity unit_price total_price batch_id",
    "fact_payment": "payment_id customer_key restaurant_key payment_method_key "
                    "payment_created_date_key paid_date_key payment_status amount "
                    "payment_created_at batch_id",
    "fact_delivery_attempt": "delivery_id customer_key restaurant_key driver_key "
                             "assigned_date_key delivery_status distance_km assigned_at batch_id",
}
ORACLES["ck_not_null"] = all_of(
    count_where(f"{t}.{c}", _WAREHOUSE[t], f"{c} IS NULL")
    for t, columns in _COLUMNS.items() for c in columns.split())
ORACLES["ck_unique"] = all_of(
    [count_groups(f"{t} primary key", _WAREHOUSE[t], f"{e}_key", where=f"{e}_key IS NOT NULL")
     for t, e in [*_IDS.items(), ("fact_order", "order")]]
    + [count_groups(f"{t} version", _WAREHOUSE[t], f"{e}_id, valid_from")
       for t, e in _IDS.items()]
    + [count_groups("etl_batch batch_id", "batches", "batch_id")]
    + [count_groups(f"{t} source id", _WAREHOUSE[t], k) for t, k in (
        ("fact_order", "order_id"), ("fact_order_item", "order_item_id"),
        ("fact_payment", "payment_id"), ("fact_delivery_attempt", "delivery_id"))])


def orphan(table: str, column: str, parent: str, parent_key: str) -> str:
    return count_where(
        f"{table}.{column}", _WAREHOUSE[table],
        f"{column} IS NOT NULL AND {column} NOT IN (SELECT {parent_key} FROM {{{parent}}} "
        f"WHERE {parent_key} IS NOT NULL)")


_PARENT = {"customer_key": ("bad_dim_customer", "customer_key"),
           "restaurant_key": ("hist_restaurant", "restaurant_key"),
           "driver_key": ("bad_dim_driver", "driver_key"),
           "menu_item_key": ("hist_menu_item", "menu_item_key"),
           "payment_method_key": ("methods", "payment_method_key"),
           "batch_id": ("batches", "batch_id")}
ORACLES["ck_foreign_key"] = all_of(
    [orphan(t, c, *_PARENT.get(c, ("calendar", "date_key")))
     for t, (_, keys) in _FACT_KEYS.items() for c in f"{keys} batch_id".split()]
    + [orphan(t, "batch_id", "batches", "batch_id") for t in _IDS])
ORACLES["ck_source_foreign_key"] = all_of(
    count_where(f"{t}.{c}", f"src_{t}",
                f"{c} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {{src_{parent}}} parent "
                f"WHERE CAST(parent.{c} AS VARCHAR) = CAST({{src_{t}}}.{c} AS VARCHAR))")
    for t, c, parent in (
        ("orders", "customer_id", "customers"), ("orders", "restaurant_id", "restaurants"),
        ("order_items", "order_id", "orders"), ("payments", "order_id", "orders"),
        ("deliveries", "order_id", "orders"), ("deliveries", "driver_id", "drivers")))
ORACLES["ck_identifier"] = all_of(
    [count_where(f"{t} identifier", _WAREHOUSE[t], f"{_IDS[t]}_id % 7 = 3 AND {_IDS[t]}_id > 0")
     for t in ("dim_customer", "dim_restaurant", "dim_driver")]
    + [count_where("dim_menu_item identifier", "hist_menu_item", "menu_item_key % 11 = 4"),
       count_where("dim_menu_item restaurant", "hist_menu_item", "restaurant_id < 3")])
ORACLES["ck_valid_period"] = all_of(
    s for t in _IDS for s in (
        count_where(f"{t} valid period", _WAREHOUSE[t],
                    "NOT ((is_current AND valid_to IS NULL) OR (NOT is_current AND valid_to IS NOT "
                    "NULL AND valid_to > valid_from))"),
        count_where(f"{t} source time", _WAREHOUSE[t], "NOT (source_updated_at >= valid_from)"),
        count_where(f"{t} hash length", _WAREHOUSE[t], "length(hash_diff) <> 64")))
ORACLES["ck_amounts"] = all_of([
    count_where("fact_order signs", "bad_fact_order",
                "subtotal < 0 OR discount < 0 OR delivery_fee < 0 OR total_amount < 0"),
    count_where("fact_order total", "bad_fact_order",
                "total_amount <> subtotal - discount + delivery_fee"),
    count_where("fact_order_item signs", "bad_fact_order_item",
                "quantity <= 0 OR unit_price < 0 OR total_price < 0"),
    count_where("fact_order_item total", "bad_fact_order_item",
                "total_price <> quantity * unit_price"),
    count_where("fact_payment signs", "bad_fact_payment", "amount < 0"),
    count_where("dim_menu_item price", "hist_menu_item", "base_price < 0")])
ORACLES["ck_domains"] = all_of([
    count_where("fact_order status", "bad_fact_order",
                "order_status NOT IN ('DELIVERED', 'CANCELLED', 'PREPARING')"),
    count_where("fact_payment status", "bad_fact_payment",
                "payment_status NOT IN ('PAID', 'PENDING', 'REFUNDED')"),
    count_where("fact_payment timeline", "bad_fact_payment", "paid_at < payment_created_at"),
    count_where("fact_payment paid date", "bad_fact_payment",
                "NOT ((paid_at IS NULL AND paid_date_key = 0) OR (paid_at IS NOT NULL AND "
                "paid_date_key > 0))"),
    count_where("fact_delivery_attempt status", "bad_fact_delivery",
                "delivery_status NOT IN ('ASSIGNED', 'DELIVERED')"),
    count_where("fact_delivery_attempt distance", "bad_fact_delivery",
                "NOT (distance_km > 0 AND distance_km <= 200)"),
    count_where("fact_delivery_attempt timeline", "bad_fact_delivery",
                "NOT ((picked_up_at IS NULL OR picked_up_at >= assigned_at) AND (delivered_at IS "
                "NULL OR (picked_up_at IS NOT NULL AND delivered_at >= picked_up_at)))")])
ORACLES["ck_dim_date"] = f"""
SELECT 'dim_date unknown or complete' AS check_name, count(*) AS violations
FROM {{order_base}} JOIN {{calendar}} ON date_key = {day_key('placed')} WHERE k % 2 = 1"""
ORACLES["ck_ledger"] = all_of([
    count_where("etl_batch status", "batches",
                "batch_status NOT IN ('RUNNING', 'SUCCEEDED', 'PARTIAL', 'FAILED')"),
    count_where("etl_batch completed", "batches", "completed_at < started_at"),
    count_where("etl_batch counts", "batches",
                "NOT (input_row_count >= 0 AND loaded_row_count >= 0 AND rejected_row_count >= 0 "
                "AND loaded_row_count + rejected_row_count <= input_row_count)")])
ORACLES["ck_not_blank"] = all_of(
    count_where(f"{t}.{c} not blank", f"src_{t}", f"NOT (trim({c}) <> '')")
    for t, c in (("customers", "email"), ("customers", "phone"), ("drivers", "phone"),
                 ("drivers", "number_plate"), ("orders", "delivery_address")))
_LIMITS = {"full_name": 255, "email": 255, "phone": 100, "city": 100, "restaurant_name": 255,
           "category": 100, "address": 255, "status": 50, "driver_name": 255, "number_plate": 50,
           "driver_status": 50, "delivery_address": 500, "order_status": 50, "batch_id": 36,
           "menu_item_id": 50, "menu_item_name": 255, "payment_status": 50, "delivery_status": 50}
_TEXTS = {"dim_customer": "full_name email phone city batch_id",
          "dim_driver": "driver_name phone number_plate driver_status batch_id",
          "dim_restaurant": "restaurant_name category city address status batch_id",
          "dim_menu_item": "menu_item_id menu_item_name category batch_id",
          "fact_order": "delivery_address order_status batch_id", "fact_order_item": "batch_id",
          "fact_payment": "payment_status batch_id", "fact_delivery_attempt": "delivery_status batch_id"}
ORACLES["ck_lengths"] = all_of(
    [count_where(f"{t}.{c} length", _WAREHOUSE[t],
                 f"length({c}) * {12 if c == 'city' else 1} > {_LIMITS[c]}")
     for t, columns in _TEXTS.items() for c in columns.split()]
    + [count_where(f"{t}.hash_diff length", _WAREHOUSE[t], "length(hash_diff) <> 64")
       for t in _IDS])


# Decimal columns of each result. Both sides hand them over as doubles, which
# represent two-decimal amounts of this size alike.
_ORDER_MONEY = "subtotal discount delivery_fee total_amount"
DECIMALS = {
    "stage_projection": _ORDER_MONEY, "clean_orders": _ORDER_MONEY,
    "resolve_keys_order": _ORDER_MONEY, "fact_updates": _ORDER_MONEY,
    "fact_inserts": _ORDER_MONEY, "fact_upsert": _ORDER_MONEY, "staging_purge": "amount",
    "safe_casts": "as_money as_distance", "schema_drift": "price legacy_price no_price",
    "order_totals": "source_total_amount total_amount", "line_totals": "unit_price line_total",
    "flatten_choices": "extra_price", "clean_menu_items": "base_price",
    "clean_order_items": "unit_price total_price", "clean_payments": "amount",
    "clean_deliveries": "distance_km", "resolve_keys_order_item": "unit_price total_price",
    "resolve_keys_payment": "amount", "resolve_keys_delivery": "distance_km",
    "dim_payment_method": "amount", "run_fact": "total_amount", "hourly_item_sales": "revenue",
}


def as_doubles(name: str, statement: str) -> str:
    columns = DECIMALS.get(name, "").split()
    if not columns:
        return statement
    replaced = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in columns)
    return f"SELECT * REPLACE ({replaced}) FROM ({statement})"


def statements() -> dict[str, str]:
    return {name: compose(as_doubles(name, text)) for name, text in ORACLES.items()}
