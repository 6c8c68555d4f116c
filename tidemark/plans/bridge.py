"""The driver's tables in the roles of the source systems and of an older warehouse.

Each role is one SELECT in the SQL that Spark and other engines share, so the
same text feeds both sides of a comparison. Irregularities (odd case, blanks,
unknown references, impossible times, repeated deliveries) follow from the rows'
own keys and attributes; every role covers its whole base table.

Notation: ``{name}`` is a base table or another role, ``TS'...'`` a zone-less
timestamp literal, ``ARR(...)`` an array.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

ROLES: dict[str, str] = {}

ROLES["src_customers"] = """
WITH base AS (
  SELECT c.c_custkey AS k, c.c_mktsegment AS segment, n.n_name AS nation,
    lower(c.c_name) || '@example.com' AS mail, c.c_name AS label,
    TS'2020-03-01 00:00:00' + (c.c_custkey % 1500) * INTERVAL '1' DAY AS born
  FROM {customer} c JOIN {nation} n ON c.c_nationkey = n.n_nationkey
), shaped AS (
  SELECT segment, k AS customer_id,
    CASE WHEN k % 31 = 7 THEN '   ' WHEN k % 5 = 1 THEN '  ' || label || ' ' ELSE label END AS full_name,
    CASE WHEN k % 43 = 5 THEN '' WHEN k % 4 = 1 THEN ' ' || upper(mail) ELSE mail END AS email,
    CASE WHEN k % 37 = 3 THEN '  ' WHEN k % 41 = 8 THEN NULL
         ELSE '08' || lpad(CAST(k AS STRING), 8, '0') END AS phone,
    CASE WHEN k % 47 = 2 THEN NULL WHEN k % 3 = 0 THEN upper(' ' || nation)
         WHEN k % 3 = 1 THEN lower(nation || ' west  ') ELSE nation END AS city,
    CASE WHEN k % 61 = 30 THEN NULL ELSE born END AS created_at,
    CASE WHEN k % 53 = 9 THEN born - INTERVAL '1' DAY WHEN k % 59 = 11 THEN NULL
         ELSE born + (k % 700) * INTERVAL '1' HOUR END AS updated_at
  FROM base
)
SELECT customer_id, full_name, email, phone, city, created_at, updated_at FROM shaped
UNION ALL
SELECT customer_id, full_name, email, '09' || phone, city, created_at,
  updated_at + INTERVAL '1' DAY FROM shaped WHERE segment = 'BUILDING'
UNION ALL
SELECT customer_id, full_name || ' II', email, phone, city, created_at, updated_at
FROM shaped WHERE segment = 'FURNITURE'
"""

ROLES["src_customers_next"] = """
SELECT customer_id, full_name, email,
  CASE WHEN customer_id % 3 = 0 THEN '07' || phone ELSE phone END AS phone, city, created_at,
  CASE WHEN customer_id % 4 = 1 THEN updated_at - INTERVAL '1' HOUR
       WHEN customer_id % 4 = 2 THEN updated_at
       ELSE updated_at + INTERVAL '200' DAY END AS updated_at
FROM {src_customers}
"""

ROLES["src_restaurants"] = """
SELECT s_suppkey + 1 AS restaurant_id,
  CASE WHEN s_suppkey % 29 = 4 THEN ' ' ELSE s_name || ' ' END AS restaurant_name,
  CASE WHEN s_nationkey % 5 = 0 THEN ' thai' WHEN s_nationkey % 5 = 1 THEN 'JAPANESE food'
       WHEN s_nationkey = 7 THEN NULL ELSE 'Burger' END AS category,
  CASE WHEN s_nationkey = 11 THEN '  ' ELSE upper(n_name) END AS city,
  CASE WHEN s_nationkey % 4 = 2 THEN '' WHEN s_nationkey % 4 = 3 THEN NULL
       ELSE ' ' || CAST(s_suppkey AS STRING) || ' Main Road ' END AS address,
  CASE WHEN s_nationkey = 13 THEN 'closed' WHEN s_nationkey = 17 THEN NULL
       WHEN s_nationkey % 2 = 0 THEN ' active' ELSE 'Inactive ' END AS status,
  TS'2020-01-01 09:00:00' + (s_suppkey % 900) * INTERVAL '1' DAY AS created_at,
  CASE WHEN s_nationkey = 19 THEN TS'2019-12-31 00:00:00' WHEN s_nationkey = 23 THEN NULL
       ELSE TS'2023-01-01 09:00:00' + (s_suppkey % 300) * INTERVAL '1' DAY END AS updated_at
FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey
"""

ROLES["src_drivers"] = """
SELECT s_suppkey AS driver_id,
  CASE WHEN s_nationkey = 3 THEN '' ELSE ' ' || s_name END AS driver_name,
  CASE WHEN s_nationkey = 6 THEN NULL ELSE '06' || lpad(CAST(s_suppkey AS STRING), 8, '0') || ' ' END
    AS phone,
  CASE WHEN s_nationkey = 9 THEN '  '
       WHEN s_nationkey IN (5, 10, 15) THEN ' bkk-' || lpad(CAST(s_suppkey - s_suppkey % 4 AS STRING), 5, '0')
       ELSE 'BKK-' || lpad(CAST(s_suppkey AS STRING), 5, '0') END AS number_plate,
  CASE WHEN s_nationkey = 12 THEN 'retired' WHEN s_nationkey = 14 THEN NULL
       WHEN s_nationkey % 2 = 0 THEN 'active ' ELSE 'INACTIVE' END AS driver_status,
  TS'2020-02-01 00:00:00' + (s_suppkey % 800) * INTERVAL '1' DAY AS created_at,
  CASE WHEN s_nationkey = 16 THEN TS'2020-01-01 00:00:00'
       ELSE TS'2023-02-01 00:00:00' + s_nationkey * INTERVAL '1' DAY END AS updated_at
FROM {supplier}
"""

ROLES["src_menu_items"] = """
SELECT
  CASE WHEN p_partkey % 211 = 17 THEN '  '
       ELSE ' MENU-' || lpad(CAST(p_partkey AS STRING), 8, '0') END AS _id,
  CASE WHEN p_partkey % 97 = 5 THEN CAST(0 AS BIGINT)
       WHEN p_partkey % 101 = 8 THEN CAST(987654321 AS BIGINT)
       ELSE p_partkey % 10 + 1 END AS restaurantId,
  CASE WHEN p_partkey % 103 = 9 THEN NULL ELSE p_name || ' ' END AS name,
  'A ' || p_name AS description,
  CASE WHEN p_partkey % 107 = 4 THEN ' ' WHEN p_size % 2 = 0 THEN lower(p_type)
       ELSE ' ' || p_type || ' dish' END AS category,
  CASE WHEN p_size = 7 THEN NULL WHEN p_size = 13 THEN 'free' WHEN p_size = 21 THEN '-1.50'
       ELSE CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS STRING) END AS basePrice,
  CASE WHEN p_size IN (7, 13) AND p_partkey % 2 = 0
       THEN CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS STRING) END AS base_price,
  CASE WHEN p_size = 33 THEN 'maybe' WHEN p_size % 3 = 0 THEN 'false' ELSE 'true' END AS available,
  CASE WHEN p_size % 4 = 0 THEN NULL WHEN p_size % 4 = 1 THEN split(p_name, ' ')
       WHEN p_size % 4 = 2 THEN ARR('spicy', NULL, lower(p_type), 'new')
       ELSE ARR(p_brand, 'value') END AS tags,
  CASE WHEN p_size % 5 = 0 THEN NULL
       WHEN p_size % 5 = 1 THEN ARR(
         named_struct('name', ' Size', 'required', true, 'choices', ARR(
           named_struct('name', 'Regular', 'extraPrice', CAST(0 AS DECIMAL(12,2))),
           named_struct('name', 'Large ', 'extraPrice', CAST(p_size AS DECIMAL(12,2))))),
         named_struct('name', p_brand, 'required', false, 'choices', ARR(
           named_struct('name', p_type, 'extraPrice', CAST(p_retailprice AS DECIMAL(12,2))))))
       ELSE ARR(
         named_struct('name', 'Extra', 'required', p_size % 2 = 0, 'choices', ARR(
           named_struct('name', p_type, 'extraPrice', CAST(15 AS DECIMAL(12,2))))))
  END AS options,
  CASE WHEN p_size = 41 THEN 'yesterday'
       ELSE '2021-03-' || lpad(CAST(p_partkey % 28 + 1 AS STRING), 2, '0') || 'T08:00:00Z' END AS createdAt,
  CASE WHEN p_size = 43 THEN NULL WHEN p_size = 47 THEN '2019-05-05T00:00:00Z'
       WHEN p_size = 49 THEN 'soon'
       ELSE '2024-0' || CAST(p_partkey % 9 + 1 AS STRING) || '-'
            || lpad(CAST(p_size % 28 + 1 AS STRING), 2, '0')
            || CASE WHEN p_size % 2 = 0 THEN 'T10:30:00Z' ELSE 'T02:15:30+07:00' END
  END AS updatedAt
FROM {part}
"""

ROLES["order_base"] = """
SELECT o_orderkey AS k, o_custkey AS cust, o_orderstatus AS state, o_orderpriority AS priority,
  CAST(o_totalprice AS DECIMAL(12,2)) AS subtotal,
  CASE WHEN o_orderkey % 127 = 9 THEN CAST(999999.99 AS DECIMAL(12,2))
       WHEN o_orderpriority = '1-URGENT' THEN CAST(0 AS DECIMAL(12,2))
       ELSE CAST(25.50 AS DECIMAL(12,2)) END AS discount,
  CASE WHEN o_orderkey % 3 = 0 THEN CAST(0 AS DECIMAL(12,2))
       WHEN o_orderkey % 3 = 1 THEN CAST(10.25 AS DECIMAL(12,2))
       ELSE CAST(49 AS DECIMAL(12,2)) END AS fee,
  o_orderdate + INTERVAL '26' YEAR + (o_orderkey % 1440) * INTERVAL '1' MINUTE AS placed
FROM {orders}
"""

ROLES["src_orders"] = """
WITH shaped AS (
  SELECT priority,
    CASE WHEN k % 101 = 17 THEN 'n/a' ELSE CAST(k AS STRING) END AS order_id,
    cust AS customer_id,
    CASE WHEN k % 83 = 6 THEN CAST(NULL AS BIGINT) ELSE k % 10 + 1 END AS restaurant_id,
    CASE WHEN k % 89 = 4 THEN '   ' ELSE '  ' || CAST(k AS STRING) || ' River Road ' END AS delivery_address,
    CASE WHEN k % 97 = 13 THEN 'LOST' WHEN k % 103 = 50 THEN NULL
         WHEN state = 'F' THEN ' delivered' WHEN state = 'O' THEN 'Cancelled '
         ELSE 'PREPARING' END AS order_status,
    CASE WHEN k % 107 = 21 THEN 'abc' WHEN k % 109 = 3 THEN '-5.00'
         ELSE CAST(subtotal AS STRING) END AS subtotal,
    CASE WHEN k % 113 = 5 THEN NULL ELSE discount END AS discount,
    fee AS delivery_fee,
    CASE WHEN k % 67 = 8 THEN CAST(1 AS DECIMAL(12,2))
         ELSE CAST(subtotal - discount + fee AS DECIMAL(12,2)) END AS total_amount,
    CASE WHEN k % 131 = 7 THEN NULL ELSE placed END AS ordered_at,
    placed AS created_at,
    CASE WHEN k % 137 = 11 THEN placed - INTERVAL '1' MINUTE WHEN k % 139 = 77 THEN NULL
         ELSE placed + (k % 72) * INTERVAL '1' HOUR END AS updated_at
  FROM {order_base}
)
SELECT order_id, customer_id, restaurant_id, delivery_address, order_status, subtotal, discount,
  delivery_fee, total_amount, ordered_at, created_at, updated_at FROM shaped
UNION ALL
SELECT order_id, customer_id, restaurant_id, delivery_address, 'DELIVERED', subtotal, discount,
  delivery_fee, total_amount, ordered_at, created_at, updated_at + INTERVAL '3' DAY
FROM shaped WHERE priority = '5-LOW'
"""

ROLES["src_order_items"] = """
SELECT l_orderkey * 10 + l_linenumber - CASE WHEN l_tax = 0.08 AND l_partkey % 19 = 3
    THEN l_orderkey * 10 + l_linenumber ELSE 0 END AS order_item_id,
  CASE WHEN l_partkey % 151 = 1 THEN l_orderkey + 1000000000000 ELSE l_orderkey END AS order_id,
  CASE WHEN l_suppkey % 19 = 7 AND l_partkey % 3 = 0 THEN ' '
       ELSE 'MENU-' || lpad(CAST(
         CASE WHEN l_suppkey % 13 = 5 THEN l_partkey
              WHEN l_suppkey % 17 = 6 THEN l_partkey + 90000000
              ELSE l_partkey - l_partkey % 10 + l_orderkey % 10 END AS STRING), 8, '0') || ' '
  END AS menu_item_id,
  CASE WHEN l_partkey % 157 = 2 THEN '' ELSE ' item ' || CAST(l_partkey AS STRING) END AS menu_item_name,
  CASE WHEN l_partkey % 163 = 3 THEN 'two'
       WHEN l_partkey % 167 = 4 THEN '0' ELSE CAST(CAST(l_quantity AS INT) AS STRING) END AS quantity,
  CASE WHEN l_partkey % 173 = 5 THEN CAST(-1 AS DECIMAL(12,2))
       ELSE CAST(l_extendedprice AS DECIMAL(12,2)) END AS unit_price,
  CASE WHEN l_partkey % 11 = 6 THEN CAST(0 AS DECIMAL(14,2))
       ELSE CAST(l_quantity * l_extendedprice AS DECIMAL(14,2)) END AS total_price,
  l_shipdate + INTERVAL '26' YEAR AS created_at,
  CASE WHEN l_partkey % 179 = 7 THEN l_shipdate + INTERVAL '25' YEAR
       WHEN l_partkey % 181 = 8 THEN NULL
       ELSE l_shipdate + INTERVAL '26' YEAR + l_linenumber * INTERVAL '1' HOUR END AS updated_at
FROM {lineitem}
"""

ROLES["src_payments"] = """
SELECT k AS payment_id,
  CASE WHEN k % 149 = 2 THEN k + 1000000000000 ELSE k END AS order_id,
  CASE WHEN priority = '1-URGENT' THEN ' card ' WHEN priority = '2-HIGH' THEN 'PromptPay'
       WHEN priority = '3-MEDIUM' THEN 'cash' WHEN priority = '4-NOT SPECIFIED' THEN 'WALLET'
       WHEN k % 7 = 0 THEN 'bitcoin' WHEN k % 7 = 1 THEN NULL ELSE 'Card' END AS payment_method,
  CASE WHEN k % 151 = 3 THEN 'held' WHEN k % 157 = 4 THEN NULL WHEN state = 'F' THEN 'paid'
       WHEN state = 'O' THEN ' REFUNDED' ELSE 'pending' END AS payment_status,
  CASE WHEN k % 163 = 5 THEN NULL WHEN k % 167 = 6 THEN '-1'
       WHEN k % 19 = 7 THEN CAST(CAST(subtotal + 1 AS DECIMAL(12,2)) AS STRING)
       ELSE CAST(CAST(subtotal - discount + fee AS DECIMAL(12,2)) AS STRING) END AS amount,
  CASE WHEN k % 13 = 8 THEN '  ' ELSE ' TX-' || CAST(k AS STRING) END AS transaction_ref,
  CASE WHEN k % 173 = 9 AND state = 'P' THEN placed
       WHEN k % 179 = 10 THEN NULL WHEN k % 181 = 11 THEN placed - INTERVAL '1' HOUR
       WHEN state = 'P' THEN NULL ELSE placed + INTERVAL '20' MINUTE END AS paid_at,
  CASE WHEN k % 191 = 12 THEN NULL ELSE placed + INTERVAL '5' MINUTE END AS created_at,
  CASE WHEN k % 193 = 13 THEN NULL WHEN k % 197 = 14 THEN placed
       ELSE placed + INTERVAL '6' MINUTE + (k % 48) * INTERVAL '1' HOUR END AS updated_at
FROM {order_base}
"""

ROLES["src_deliveries"] = """
SELECT k AS delivery_id,
  CASE WHEN k % 149 = 3 THEN k + 1000000000000 ELSE k END AS order_id,
  CASE WHEN k % 151 = 4 THEN CAST(0 AS BIGINT) ELSE k % 10 + 1 END AS driver_id,
  CASE WHEN k % 157 = 5 THEN 'flying' WHEN k % 163 = 6 THEN NULL
       WHEN state = 'P' THEN 'assigned ' ELSE ' Delivered' END AS delivery_status,
  CASE WHEN k % 61 = 7 THEN '-1' WHEN k % 67 = 8 THEN '999' WHEN k % 71 = 9 THEN 'far'
       ELSE CAST(k % 200 AS STRING) || '.50' END AS distance_km,
  CASE WHEN k % 167 = 7 THEN NULL ELSE placed + INTERVAL '10' MINUTE END AS assigned_at,
  CASE WHEN k % 73 = 10 THEN placed WHEN k % 79 = 11 OR state = 'P' THEN NULL
       ELSE placed + INTERVAL '25' MINUTE END AS picked_up_at,
  CASE WHEN k % 83 = 12 THEN placed + INTERVAL '20' MINUTE
       WHEN k % 89 = 13 OR (state = 'P' AND k % 7 > 0) THEN NULL
       ELSE placed + INTERVAL '45' MINUTE END AS delivered_at,
  placed AS created_at,
  CASE WHEN k % 173 = 14 THEN NULL ELSE placed + INTERVAL '50' MINUTE END AS updated_at
FROM {order_base}
"""

# --- an older warehouse ----------------------------------------------------

_HISTORY = """
WITH base AS (SELECT {columns} FROM {source})
SELECT ident * 2 + 1 AS {key}, {picked}, since AS valid_from,
  CASE WHEN changed THEN since + INTERVAL '700' DAY END AS valid_to, NOT changed AS is_current,
  md5('a' || label) || md5('b' || label) AS hash_diff, since + INTERVAL '5' DAY AS source_updated_at,
  'batch-1' AS batch_id
FROM base
UNION ALL
SELECT ident * 2 + 2 AS {key}, {picked}, since + INTERVAL '700' DAY AS valid_from,
  CAST(NULL AS TIMESTAMP) AS valid_to, true AS is_current,
  md5('c' || label) || md5('d' || label) AS hash_diff,
  since + INTERVAL '705' DAY AS source_updated_at, 'batch-2' AS batch_id
FROM base WHERE changed
"""


def _history(key: str, source: str, columns: str, picked: str) -> str:
    text = _HISTORY
    for name, value in (("columns", columns), ("source", source), ("key", key), ("picked", picked)):
        text = text.replace("{" + name + "}", value)
    return text


ROLES["hist_customer"] = _history(
    "customer_key", "{customer} JOIN {nation} ON c_nationkey = n_nationkey",
    "c_custkey AS ident, c_name AS label, lower(c_name) || '@example.com' AS email, "
    "'08' || CAST(c_custkey AS STRING) AS phone, n_name AS city, c_nationkey < 12 AS changed, "
    "TS'2020-06-01 00:00:00' + (c_custkey % 900) * INTERVAL '1' DAY AS since",
    "ident AS customer_id, label AS full_name, email, phone, city",
)
ROLES["hist_restaurant"] = _history(
    "restaurant_key", "{supplier} JOIN {nation} ON s_nationkey = n_nationkey",
    "s_suppkey + 1 AS ident, s_name AS label, n_name AS city, s_nationkey % 3 > 0 AS changed, "
    "TS'2020-02-01 06:00:00' + (s_suppkey % 600) * INTERVAL '1' DAY AS since",
    "ident AS restaurant_id, label AS restaurant_name, 'Thai' AS category, city, "
    "label || ' Road' AS address, 'ACTIVE' AS status",
)
ROLES["hist_driver"] = _history(
    "driver_key", "{supplier}",
    "s_suppkey + 1 AS ident, s_name AS label, s_nationkey % 2 = 0 AS changed, "
    "TS'2020-04-01 12:00:00' + (s_suppkey % 700) * INTERVAL '1' DAY AS since",
    "ident AS driver_id, label AS driver_name, '06' || CAST(ident AS STRING) AS phone, "
    "'BKK-' || CAST(ident AS STRING) AS number_plate, 'ACTIVE' AS driver_status",
)
ROLES["hist_menu_item"] = _history(
    "menu_item_key", "{part}",
    "p_partkey AS ident, p_name AS label, p_type AS kind, p_size > 20 AS changed, "
    "CAST(p_retailprice AS DECIMAL(12,2)) AS price, "
    "TS'2020-03-01 00:00:00' + (p_partkey % 800) * INTERVAL '1' DAY AS since",
    "'MENU-' || lpad(CAST(ident AS STRING), 8, '0') AS menu_item_id, "
    "ident % 10 + 1 AS restaurant_id, label AS menu_item_name, kind AS category, "
    "price AS base_price, true AS available",
)

# The order fact before a batch, and the batch: the same orders delivered again,
# some unchanged, some newer, some older, some whose member has arrived since.
ROLES["every_fact_order"] = """
SELECT k * 3 + 7 AS order_key, k AS order_id,
  CASE WHEN k % 5 = 0 THEN CAST(0 AS BIGINT) ELSE cust * 2 + 1 END AS customer_key,
  (k % 10 + 1) * 2 + 1 AS restaurant_key, 'old road' AS delivery_address,
  CAST(year(placed) * 10000 + month(placed) * 100 + 1 AS INT) AS order_date_key,
  'PREPARING' AS order_status, subtotal, discount, fee AS delivery_fee,
  CAST(subtotal - discount + fee AS DECIMAL(12,2)) AS total_amount,
  placed AS ordered_at, placed + INTERVAL '2' DAY AS source_updated_at, 'batch-1' AS batch_id, priority
FROM {order_base}
"""
# One order in five is not loaded yet, so that the batch has new orders too.
ROLES["old_fact_order"] = """
SELECT order_key, order_id, customer_key, restaurant_key, delivery_address, order_date_key, order_status,
  subtotal, discount, delivery_fee, total_amount, ordered_at, source_updated_at, batch_id
FROM {every_fact_order} WHERE priority <> '5-LOW'
"""
ROLES["new_fact_order"] = """
SELECT k AS order_id, cust * 2 + 1 AS customer_key, (k % 10 + 1) * 2 + 1 AS restaurant_key,
  'new road' AS delivery_address,
  CAST(year(placed) * 10000 + month(placed) * 100 + 1 AS INT) AS order_date_key,
  'DELIVERED' AS order_status, subtotal, discount, fee AS delivery_fee,
  CAST(subtotal - discount + fee AS DECIMAL(12,2)) AS total_amount, placed AS ordered_at,
  CASE WHEN k % 4 = 0 THEN placed + INTERVAL '3' DAY
       WHEN k % 4 = 1 THEN placed + INTERVAL '1' DAY
       ELSE placed + INTERVAL '2' DAY END AS source_updated_at, 'batch-2' AS batch_id
FROM {order_base}
"""

# The batch ledger, one batch per event.
ROLES["ledger_revisions"] = """
WITH runs AS (
  SELECT 'batch-' || CAST(event_id AS STRING) AS batch_id, event_type AS pipeline_name, ts,
    event_id, user_id,
    CASE WHEN event_id % 7 = 3 THEN 'FAILED' WHEN event_id % 7 = 5 THEN 'RUNNING'
         WHEN event_id % 3 = 0 THEN 'PARTIAL' ELSE 'SUCCEEDED' END AS outcome
  FROM {events}
)
SELECT batch_id, pipeline_name, ts AS started_at, CAST(NULL AS TIMESTAMP) AS completed_at,
  'RUNNING' AS batch_status, ts - INTERVAL '1' DAY AS mysql_watermark_from,
  ts AS mysql_watermark_to, user_id + 100 AS input_row_count, CAST(0 AS BIGINT) AS loaded_row_count,
  CASE WHEN event_id % 3 = 0 THEN user_id ELSE CAST(0 AS BIGINT) END AS rejected_row_count,
  CAST(NULL AS STRING) AS error_message, 1 AS revision
FROM runs
UNION ALL
SELECT batch_id, pipeline_name, ts, ts + (user_id - 20) * INTERVAL '1' SECOND, outcome,
  ts - INTERVAL '1' DAY, CASE WHEN event_id % 11 = 2 THEN NULL ELSE ts END, user_id + 100,
  CASE WHEN outcome = 'FAILED' THEN CAST(0 AS BIGINT) ELSE CAST(100 AS BIGINT) END,
  CASE WHEN event_id % 3 = 0 THEN user_id + event_id % 2 ELSE CAST(0 AS BIGINT) END,
  CASE WHEN outcome = 'FAILED' THEN 'lost connection' END, 2
FROM runs WHERE outcome <> 'RUNNING'
"""

# Warehouse tables with planted violations for the checks.
ROLES["bad_dim_customer"] = """
SELECT customer_key, customer_id, full_name,
  CASE WHEN customer_id % 41 = 1 THEN NULL
       WHEN customer_id % 43 = 2 THEN ' SHARED' || CAST(customer_id % 3 AS STRING) || '@example.com'
       ELSE email END AS email,
  CASE WHEN customer_id % 47 = 3 THEN '  ' ELSE phone END AS phone, city, valid_from,
  CASE WHEN customer_id % 53 = 4 THEN valid_from - INTERVAL '1' DAY
       WHEN customer_id % 59 = 5 THEN valid_from + INTERVAL '900' DAY ELSE valid_to END AS valid_to,
  is_current,
  CASE WHEN customer_id % 61 = 6 THEN substr(hash_diff, 1, 60) ELSE hash_diff END AS hash_diff,
  CASE WHEN customer_id % 67 = 7 THEN valid_from - INTERVAL '2' DAY ELSE source_updated_at END
    AS source_updated_at,
  batch_id
FROM {hist_customer}
UNION ALL
SELECT customer_key + 100000000, customer_id, full_name, email, phone, city,
  valid_from + CASE WHEN customer_id % 2 = 0 THEN INTERVAL '0' DAY ELSE INTERVAL '30' DAY END,
  valid_to, is_current, hash_diff, source_updated_at, batch_id
FROM {hist_customer} WHERE is_current AND customer_id % 37 = 8
"""
ROLES["bad_dim_driver"] = """
SELECT driver_key, driver_id, driver_name,
  CASE WHEN driver_id % 11 = 1 THEN NULL ELSE phone END AS phone,
  CASE WHEN driver_id % 13 = 2 THEN ' ' WHEN driver_id % 17 = 3 THEN ' bkk-1' ELSE number_plate END
    AS number_plate,
  driver_status, valid_from, CASE WHEN driver_id % 19 = 4 THEN valid_from ELSE valid_to END AS valid_to,
  is_current, hash_diff, source_updated_at, batch_id
FROM {hist_driver}
"""
ROLES["bad_fact_order"] = """
SELECT CASE WHEN order_id % 199 = 1 THEN NULL ELSE order_key END AS order_key, order_id,
  CASE WHEN order_id % 101 = 1 THEN NULL WHEN order_id % 103 = 2 THEN CAST(-7 AS BIGINT)
       ELSE customer_key END AS customer_key,
  CASE WHEN order_id % 107 = 3 THEN NULL ELSE restaurant_key END AS restaurant_key,
  CASE WHEN order_id % 109 = 4 THEN '  ' WHEN order_id % 211 = 4 THEN NULL
       ELSE delivery_address END AS delivery_address,
  CASE WHEN order_id % 113 = 5 THEN 20991231 ELSE order_date_key END AS order_date_key,
  CASE WHEN order_id % 127 = 6 THEN 'LOST' WHEN order_id % 131 = 7 THEN NULL ELSE order_status END
    AS order_status,
  CASE WHEN order_id % 137 = 8 THEN -subtotal ELSE subtotal END AS subtotal, discount, delivery_fee,
  total_amount, ordered_at, source_updated_at,
  CASE WHEN order_id % 139 = 9 THEN NULL ELSE batch_id END AS batch_id
FROM {every_fact_order}
"""
ROLES["bad_fact_order_item"] = """
SELECT l_orderkey * 10 + l_linenumber AS order_item_id, l_orderkey AS order_id,
  CASE WHEN l_partkey % 101 = 1 THEN CAST(NULL AS BIGINT) ELSE l_suppkey END AS customer_key,
  l_suppkey AS restaurant_key,
  CASE WHEN l_partkey % 103 = 2 THEN CAST(NULL AS BIGINT) ELSE l_partkey * 2 + 1 END AS menu_item_key,
  20240101 AS order_date_key,
  CASE WHEN l_partkey % 107 = 3 THEN 0 ELSE CAST(l_quantity AS INT) END AS quantity,
  CAST(l_extendedprice AS DECIMAL(12,2)) AS unit_price,
  CASE WHEN l_partkey % 109 = 4 THEN CAST(1 AS DECIMAL(12,2))
       ELSE CAST(l_quantity * l_extendedprice AS DECIMAL(12,2)) END AS total_price,
  'batch-1' AS batch_id
FROM {lineitem}
"""
ROLES["bad_fact_payment"] = """
SELECT k AS payment_id, cust * 2 + 1 AS customer_key, (k % 10 + 1) * 2 + 1 AS restaurant_key,
  CASE WHEN k % 101 = 1 THEN CAST(NULL AS INT) WHEN k % 103 = 2 THEN 9
       ELSE CAST(k % 5 AS INT) END AS payment_method_key,
  20240101 AS payment_created_date_key,
  CASE WHEN state = 'P' AND k % 107 > 0 THEN 0 WHEN k % 109 = 3 THEN 0 ELSE 20240102 END AS paid_date_key,
  CASE WHEN k % 113 = 4 THEN 'HELD' WHEN state = 'P' THEN 'PENDING' ELSE 'PAID' END AS payment_status,
  CASE WHEN k % 127 = 5 THEN -subtotal ELSE subtotal END AS amount,
  placed AS payment_created_at,
  CASE WHEN state = 'P' THEN NULL WHEN k % 131 = 6 THEN placed - INTERVAL '1' MINUTE
       ELSE placed + INTERVAL '1' MINUTE END AS paid_at,
  'batch-1' AS batch_id
FROM {order_base}
"""
ROLES["bad_fact_delivery"] = """
SELECT k AS delivery_id, cust * 2 + 1 AS customer_key, (k % 10 + 1) * 2 + 1 AS restaurant_key,
  CASE WHEN k % 101 = 1 THEN CAST(NULL AS BIGINT) ELSE k % 10 + 1 END AS driver_key,
  CASE WHEN k % 103 = 2 THEN CAST(NULL AS INT) ELSE 20240101 END AS assigned_date_key,
  CASE WHEN k % 107 = 3 THEN 'FLYING' ELSE 'DELIVERED' END AS delivery_status,
  CAST(k % 210 AS DECIMAL(8,2)) AS distance_km, placed AS assigned_at,
  CASE WHEN k % 109 = 4 THEN NULL WHEN k % 113 = 5 THEN placed - INTERVAL '1' MINUTE
       ELSE placed + INTERVAL '9' MINUTE END AS picked_up_at,
  CASE WHEN k % 127 = 6 THEN placed ELSE placed + INTERVAL '30' MINUTE END AS delivered_at,
  'batch-1' AS batch_id
FROM {order_base}
"""

_NAME = re.compile(r"\{(\w+)\}")


def referenced(text: str) -> list[str]:
    return list(dict.fromkeys(_NAME.findall(text)))


def spark_text(text: str) -> str:
    text = text.replace("TS'", "TIMESTAMP_NTZ'").replace("ARR(", "array(")
    return text.replace("AS TIMESTAMP)", "AS TIMESTAMP_NTZ)")


@lru_cache(maxsize=256)
def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base table or a role over the tables in ``sf_dir``; the plan is kept, not the data."""
    if name not in ROLES:
        return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    parts = {part: table(spark, sf_dir, part) for part in referenced(ROLES[name])}
    return spark.sql(spark_text(ROLES[name]), **parts)
