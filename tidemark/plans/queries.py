"""Every operator over the driver's tables: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from datetime import timedelta
from functools import reduce
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import columns as C
from tidemark.operators import dedup, flatten, ledger, rules, scd2, seeds, surrogate, temporal, upsert
from tidemark.plans import entities as E
from tidemark.plans import jobs, reports
from tidemark.plans import warehouse_checks as W
from tidemark.plans.bridge import table
from tidemark.plans.facts import DIMENSIONS, FACTS, resolve_fact
from tidemark.session import cut_lineage, shared_folder
from tidemark.sources import windows
from tidemark.sources.documents import parse_documents
from tidemark.sources.warehouse import Warehouse, purge_rows, stage_projection

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Bounds of the example window over the event stream.
WINDOW_FROM, WINDOW_TO = "2024-01-08 00:00:00", "2024-01-20 12:00:00"
DOCUMENTS_FROM, DOCUMENTS_TO = "2024-03-01T00:00:00Z", "2024-08-15T10:30:00Z"


def register(name: str, function: Query) -> None:
    QUERIES[name] = lambda spark, d: _amounts_as_doubles(function(spark, d))


def query(function: Query) -> Query:
    register(function.__name__, function)
    return function


def _amounts_as_doubles(df: DataFrame) -> DataFrame:
    """Hand decimals over as doubles, the form any SQL engine's client returns alike."""
    decimals = {
        f.name: F.col(f.name).cast("double")
        for f in df.schema.fields if isinstance(f.dataType, T.DecimalType)
    }
    return df.withColumns(decimals) if decimals else df


def _checked(spark: SparkSession, d: str, name: str) -> DataFrame:
    """Judged rows of one entity."""
    sources = SourceTables(spark, d)
    return jobs.JUDGES[name](sources[jobs.SOURCE_OF[name]], sources)


class SourceTables(Mapping):
    """The source tables by name, built when asked for."""

    def __init__(self, spark: SparkSession, d: str):
        self._spark, self._dir = spark, d

    def __getitem__(self, name: str) -> DataFrame:
        return table(self._spark, self._dir, f"src_{name}")

    def __iter__(self):
        return iter(jobs.SOURCE_OF.values())

    def __len__(self) -> int:
        return len(jobs.SOURCE_OF)


def _target(name: str):
    return (jobs.DIMENSIONS.get(name) or FACTS[name]).entity


def _clean(spark: SparkSession, d: str, name: str) -> DataFrame:
    return E.accept(_checked(spark, d, name), _target(name))


def _dimensions(spark: SparkSession, d: str, names) -> dict[str, DataFrame]:
    return {n: table(spark, d, f"hist_{n}") for n in names}


# --- sources ---------------------------------------------------------------


@query
def watermark_probe(spark, d):
    return windows.high_watermark(table(spark, d, "events"), "ts")


@query
def incremental_window(spark, d):
    rows = windows.incremental_window(table(spark, d, "events"), "ts", WINDOW_FROM, WINDOW_TO)
    return rows.select("event_id", "ts", "user_id", "event_type", "value")


@query
def incremental_lookback(spark, d):
    rows = windows.lookback_window(
        table(spark, d, "events"), "ts", WINDOW_FROM, WINDOW_TO, timedelta(days=3)
    )
    return rows.select("event_id", "ts", "user_id", "event_type", "value")


def _document_columns(df: DataFrame) -> DataFrame:
    return df.select(
        "_id", "restaurantId", "name", "category", "basePrice", "base_price", "available",
        C.array_text("tags").alias("tags_text"),
        F.coalesce(F.size("options").cast("bigint"), F.lit(0)).alias("n_options"), "createdAt",
        "updatedAt",
    )


@query
def doc_scan(spark, d):
    """Documents as JSON text, read back with the explicit document schema."""
    text = table(spark, d, "src_menu_items").select(F.to_json(F.struct("*")).alias("document"))
    parsed = parse_documents(text, "document")
    return _document_columns(parsed.withColumn("options", F.coalesce("options", F.array())))


@query
def doc_watermark(spark, d):
    return windows.document_watermark(table(spark, d, "src_menu_items"), "updatedAt")


@query
def doc_incremental(spark, d):
    rows = windows.document_window(
        table(spark, d, "src_menu_items"), "updatedAt", DOCUMENTS_FROM, DOCUMENTS_TO
    )
    return rows.select("_id", "restaurantId", "name", "updatedAt")


register("stage_projection", lambda spark, d: stage_projection(
    _clean(spark, d, "order"), E.ORDER.columns, "batch-7"))


@query
def staging_purge(spark, d):
    """Staging after one of its two batches has been merged."""
    staged = _clean(spark, d, "payment")
    kinds = F.when(F.col("payment_status") == "PENDING", "batch-1").otherwise("batch-2")
    return purge_rows(staged.withColumn("batch_id", kinds), "batch-1").select(
        "batch_id", "payment_id", "order_id", "amount"
    )


@query
def quarantine_counts(spark, d):
    """Rejected rows per entity and reason."""
    counted = [
        rules.quarantine_counts(_checked(spark, d, n)).select(
            F.lit(n).alias("entity"), rules.REASON, "rejected_rows"
        )
        for n in jobs.SOURCE_OF
    ]
    return reduce(DataFrame.unionByName, counted)


# --- projections -----------------------------------------------------------


@query
def safe_casts(spark, d):
    """Text of four base tables' columns, some of it unreadable, to every target type."""
    lines = table(spark, d, "lineitem")
    return lines.select(
        "l_orderkey", "l_linenumber", "l_partkey",
        C.safe_cast(
            F.when(F.col("l_returnflag") == "R", F.lit("x1"))
            .otherwise(F.col("l_orderkey").cast("string")), "bigint").alias("as_long"),
        C.safe_cast(
            F.when(F.col("l_linestatus") == "F", F.concat(F.col("l_linenumber"), F.lit("e")))
            .otherwise(F.concat(F.lit(" "), F.col("l_linenumber"))), "int").alias("as_int"),
        C.safe_cast(
            F.when(F.col("l_tax") == 0, F.lit("5.x"))
            .otherwise(F.col("l_extendedprice").cast("decimal(12,2)").cast("string")),
            C.MONEY).alias("as_money"),
        C.safe_cast(
            F.when(F.col("l_discount") == 0, F.lit("")).otherwise(
                F.col("l_quantity").cast("decimal(8,2)").cast("string")),
            C.DISTANCE).alias("as_distance"),
        C.safe_cast(
            F.when(F.col("l_returnflag") == "N", F.lit("maybe"))
            .when(F.col("l_returnflag") == "A", F.lit("TRUE")).otherwise(F.lit("false")),
            "boolean").alias("as_boolean"),
    )


@query
def safe_timestamps(spark, d):
    docs = table(spark, d, "src_menu_items")
    return docs.select(
        "_id", C.utc(docs, "createdAt").alias("created_utc"),
        C.utc(docs, "updatedAt").alias("updated_utc"),
    )


@query
def text_normalize(spark, d):
    return table(spark, d, "src_customers").select(
        "customer_id", "updated_at",
        C.trimmed("full_name").alias("trimmed"), C.code_text("city").alias("code"),
        C.email_text("email").alias("email"), C.title_text("city").alias("title"),
        C.optional_text("phone").alias("optional"),
    )


@query
def schema_drift(spark, d):
    docs = table(spark, d, "src_menu_items")
    return docs.select(
        "_id",
        C.first_castable(docs, ["basePrice", "base_price"], C.MONEY).alias("price"),
        C.first_castable(docs, ["oldPrice", "base_price"], C.MONEY).alias("legacy_price"),
        C.first_castable(docs, ["oldPrice"], C.MONEY).alias("no_price"),
    )


@query
def array_normalize(spark, d):
    docs = table(spark, d, "src_menu_items").withColumn("tags", C.normalized_array("tags"))
    return docs.select(
        "_id", C.array_text("tags").alias("tags_text"),
        F.size("tags").cast("bigint").alias("n_tags"),
        F.array_join("tags", ",", "?").alias("tags_with_nulls"),
    )


@query
def json_roundtrip(spark, d):
    """Tags to JSON text and back, and the numbers inside the events' JSON text."""
    docs = table(spark, d, "src_menu_items").select(
        F.trim("_id").alias("id"), C.array_to_json(C.normalized_array("tags")).alias("tags_json")
    )
    events = table(spark, d, "events").select(
        F.concat(F.lit("event-"), F.col("event_id")).alias("id"),
        F.concat(F.lit("["), F.get_json_object("props", "$.k"), F.lit("]")).alias("tags_json"),
    )
    both = docs.unionByName(events).withColumn("tags", C.json_to_array("tags_json"))
    return both.select(
        "id", "tags_json", F.array_join("tags", "|").alias("tags_text"),
        F.size("tags").cast("bigint").alias("n_tags"),
    )


@query
def order_totals(spark, d):
    audited = E.with_correction_flag(_checked(spark, d, "order"))
    return audited.select(
        "order_id", "customer_id", "order_status", "source_updated_at", "source_total_amount",
        "total_amount", "total_was_corrected",
    )


@query
def line_totals(spark, d):
    lines = table(spark, d, "src_order_items").select(
        "order_item_id", "created_at", "menu_item_id", "total_price",
        C.safe_cast("quantity", "int").alias("quantity"), "unit_price",
    )
    return lines.withColumn("line_total", C.line_total("quantity", "unit_price")).withColumn(
        "was_corrected", C.was_corrected("total_price", "line_total")
    ).drop("total_price")


@query
def business_date_key(spark, d):
    """Local date of every event and order; a missing time becomes key 0."""
    events = table(spark, d, "events").select(
        F.lit("event").alias("kind"), F.col("event_id").alias("id"),
        F.when(F.col("event_type") != "error", F.col("ts")).alias("moment"),
    )
    orders = table(spark, d, "order_base").select(
        F.lit("order").alias("kind"), F.col("k").alias("id"), F.col("placed").alias("moment")
    )
    return events.unionByName(orders).select(
        "kind", "id", C.business_date_key("moment").alias("date_key"),
        C.date_key_or_unknown("moment").alias("date_key_or_unknown"),
    )


@query
def change_hash(spark, d):
    restaurants = _clean(spark, d, "restaurant").select(
        F.lit("restaurant").alias("kind"), F.col("restaurant_id").alias("id"), "hash_diff")
    customers = _clean(spark, d, "customer").select(
        F.lit("customer").alias("kind"), F.col("customer_id").alias("id"), "hash_diff")
    return restaurants.unionByName(customers)


@query
def flatten_options(spark, d):
    return flatten.menu_options(_trimmed_documents(spark, d))


@query
def flatten_choices(spark, d):
    return flatten.menu_option_choices(_trimmed_documents(spark, d))


def _trimmed_documents(spark, d):
    return table(spark, d, "src_menu_items").withColumn("_id", F.trim("_id"))


# --- rules and entities ----------------------------------------------------


def _reason_query(name: str) -> Query:
    def run(spark, d):
        checked = _checked(spark, d, name)
        return checked.select(_target(name).key, "source_updated_at", rules.REASON)

    return run


def _clean_query(name: str) -> Query:
    def run(spark, d):
        cleaned = _clean(spark, d, name)
        if "tags" in cleaned.columns:
            cleaned = cleaned.withColumn("tags", C.array_text("tags"))
        return cleaned

    return run


for _name, _source in jobs.SOURCE_OF.items():
    register(f"reject_reasons_{_name}", _reason_query(_name))
    register(f"clean_{_source}", _clean_query(_name))


@query
def reject_reasons_null_passes(spark, d):
    """The literal three-valued reading: an unknown status passes its rule."""
    checked = E.check_payments(
        table(spark, d, "src_payments"), table(spark, d, "src_orders"), null_is_violation=False
    )
    return checked.select("payment_id", "source_updated_at", rules.REASON)


@query
def batch_counts(spark, d):
    counted = [
        rules.row_counts(_checked(spark, d, n)).select(
            F.lit(n).alias("entity"), "input_rows", "valid_rows", "rejected_rows"
        )
        for n in jobs.SOURCE_OF
    ]
    return reduce(DataFrame.unionByName, counted)


@query
def dedup_latest(spark, d):
    """Lines repeated under one (order, line number): the latest shipped one stays."""
    lines = table(spark, d, "lineitem")
    return dedup.latest_per_key(
        lines, ["l_orderkey", "l_linenumber"], "l_shipdate",
        ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"],
    ).select("l_orderkey", "l_linenumber", "l_shipdate", "l_partkey", "l_suppkey", "l_quantity")


# --- lookups ---------------------------------------------------------------


@query
def lookup_exists(spark, d):
    return _checked(spark, d, "menu_item").select(
        "menu_item_id", "restaurant_id", "known_restaurant_id",
        F.col("known_restaurant_id").isNotNull().alias("restaurant_known"),
    )


@query
def lookup_enrich(spark, d):
    return _checked(spark, d, "delivery").select(
        "delivery_id", "order_id", "customer_id", "restaurant_id"
    )


@query
def lookup_two_sources(spark, d):
    return _checked(spark, d, "order_item").select(
        "order_item_id", "source_updated_at", "lookup_order_id", "customer_id", "restaurant_id",
        "ordered_at", "lookup_menu_item_id", "menu_restaurant_id",
    )


# --- point in time ---------------------------------------------------------


def _placed_orders(spark, d):
    return table(spark, d, "order_base").select(
        F.col("k").alias("order_id"), F.col("cust").alias("customer_id"),
        F.col("placed").alias("ordered_at"),
    )


def _customer_lookup(spark, d):
    return temporal.VersionLookup(table(spark, d, "hist_customer"), "customer_id", "customer_key")


@query
def asof_join(spark, d):
    """Every order with the customer version in force when it was placed."""
    return temporal.as_of_lookup(_placed_orders(spark, d), _customer_lookup(spark, d), "ordered_at")


@query
def asof_join_sorted(spark, d):
    """The same lookup; kept under its name from when it had a form of its own."""
    return temporal.as_of_lookup(
        _placed_orders(spark, d), _customer_lookup(spark, d), "ordered_at"
    )


def _event_versions(spark, d):
    """A dimension whose every user changes with each of their purchases."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return (
        table(spark, d, "events").filter("event_type = 'purchase'")
        .select("user_id", F.col("event_id").alias("user_key"), F.col("ts").alias("valid_from"),
                F.lead("ts").over(w).alias("valid_to"))
    )


@query
def asof_join_busy(spark, d):
    """Events against user versions, among them users with very many."""
    lookup = temporal.VersionLookup(_event_versions(spark, d), "user_id", "user_key", busy=True)
    events = table(spark, d, "events").select("event_id", "user_id", "ts")
    return temporal.as_of_lookup(events, lookup, "ts")


def _resolve_query(name: str) -> Query:
    def run(spark, d):
        fact = FACTS[name]
        return resolve_fact(
            _clean(spark, d, name), fact, _dimensions(spark, d, fact.dimensions),
            seeds.dim_date(spark), seeds.dim_payment_method(spark),
        )

    return run


for _name in FACTS:
    register(f"resolve_keys_{_name}", _resolve_query(_name))


@query
def ambiguous_versions(spark, d):
    """Orders that fall where planted customer versions overlap."""
    lookup = temporal.VersionLookup(
        table(spark, d, "bad_dim_customer"), "customer_id", "customer_key")
    return temporal.ambiguous_events(
        _placed_orders(spark, d), "order_id", "ordered_at", [lookup]
    )


@query
def version_overlaps(spark, d):
    return temporal.version_overlaps(table(spark, d, "bad_dim_customer"), "customer_id")


@query
def uniqueness_conflicts(spark, d):
    staged = _clean(spark, d, "driver")
    held = table(spark, d, "hist_driver").withColumn(
        "number_plate", F.concat(F.lit("bkk-"), F.lpad(F.col("driver_id").cast("string"), 5, "0"))
    )
    return scd2.uniqueness_conflicts(staged, held, "driver_id", C.code_text("number_plate"))


# --- dimensions ------------------------------------------------------------


def _customer_batches(spark, d):
    """Dimension after a first batch, and the batch that follows."""
    first = _clean(spark, d, "customer")
    later = E.clean_customers(table(spark, d, "src_customers_next")).valid
    early = first.filter("city <> 'Nation_4'")
    start = early.select(
        "*", F.lit(None).cast("timestamp_ntz").alias("valid_to"), F.lit(True).alias("is_current"),
        F.lit("batch-1").alias("batch_id"),
    )
    return start, later.withColumn("batch_id", F.lit("batch-2"))


_VERSION = ["customer_id", "phone", "city", "valid_from", "valid_to", "is_current", "hash_diff",
            "source_updated_at", "batch_id"]


@query
def scd2_closes(spark, d):
    start, later = _customer_batches(spark, d)
    return scd2.scd2_closes(start, later, "customer_id").select(_VERSION)


@query
def scd2_inserts(spark, d):
    start, later = _customer_batches(spark, d)
    return scd2.scd2_inserts(start, later, "customer_id").select(_VERSION)


@query
def scd2_apply(spark, d):
    start, later = _customer_batches(spark, d)
    return scd2.scd2_apply(start, later, "customer_id").select(_VERSION)


@query
def scd2_replay(spark, d):
    """Applying the same batch twice leaves what applying it once leaves."""
    start, later = _customer_batches(spark, d)
    once = cut_lineage(scd2.scd2_apply(start, later, "customer_id"), _scratch(spark))
    return scd2.scd2_apply(once, later, "customer_id").select(_VERSION)


@query
def surrogate_keys(spark, d):
    """Keys for all cleaned orders, after a highest key of 1000."""
    orders = _clean(spark, d, "order").select("order_id", "customer_id")
    return surrogate.assign_keys(orders, "order_key", ["order_id"], after=1000)


@query
def seed_idempotent(spark, d):
    """Unknown members seeded twice into dimensions built from the tables."""
    def seeded(name):
        dimension = table(spark, d, f"hist_{name}")
        key = jobs.DIMENSIONS[name].key
        member = seeds.unknown_member(dimension, name)
        twice = seeds.insert_if_absent(
            seeds.insert_if_absent(dimension, member, [key]), member, [key])
        return twice.groupBy((F.col(key) == 0).alias("is_unknown")).agg(
            F.count(F.lit(1)).alias("members"), F.max(key).alias("top_key"),
            F.min("valid_from").alias("first_from"), F.min("hash_diff").alias("low_hash"),
        ).select(F.lit(name).alias("dimension"), "*")

    return reduce(DataFrame.unionByName, [seeded(n) for n in jobs.DIMENSIONS])


@query
def unknown_members(spark, d):
    dimension = table(spark, d, "hist_customer")
    member = seeds.unknown_member(dimension, "customer")
    return seeds.insert_if_absent(dimension, member, ["customer_key"]).select(
        "customer_key", "customer_id", "full_name", "email", "phone", "city", "valid_from",
        "valid_to", "is_current", "hash_diff", "source_updated_at", "batch_id",
    )


@query
def dim_payment_method(spark, d):
    """Each payment method with its payments."""
    used = _clean(spark, d, "payment").groupBy("payment_method").agg(
        F.count(F.lit(1)).alias("payments"), F.sum("amount").cast("decimal(18,2)").alias("amount"))
    methods = seeds.dim_payment_method(spark)
    return methods.join(
        used, F.col("payment_method_code") == F.col("payment_method"), "left"
    ).drop("payment_method")


@query
def dim_date(spark, d):
    """Each calendar day with the orders placed on it."""
    placed = table(spark, d, "order_base").groupBy(
        C.business_date_key("placed").alias("placed_key")).agg(F.count(F.lit(1)).alias("orders"))
    return (
        seeds.dim_date(spark)
        .join(placed, F.col("date_key") == F.col("placed_key"), "left")
        .drop("placed_key")
    )


# --- facts -----------------------------------------------------------------

_ORDER_KEYS = ["customer_key", "restaurant_key", "order_date_key"]


def _order_fact(spark, d):
    return table(spark, d, "old_fact_order"), table(spark, d, "new_fact_order")


@query
def fact_updates(spark, d):
    old, new = _order_fact(spark, d)
    return upsert.fact_updates(old, new, "order_id", _ORDER_KEYS, "order_key")


@query
def fact_inserts(spark, d):
    old, new = _order_fact(spark, d)
    return upsert.fact_inserts(old, new, "order_id")


@query
def fact_upsert(spark, d):
    old, new = _order_fact(spark, d)
    return upsert.fact_upsert(old, new, "order_id", _ORDER_KEYS, "order_key")


@query
def fact_key_repair(spark, d):
    """Stored rows with an unknown customer that an equally old replay repairs."""
    old, new = _order_fact(spark, d)
    updates = upsert.fact_updates(old, new, "order_id", _ORDER_KEYS, "order_key")
    before = old.select(
        F.col("order_id").alias("_id"), F.col("customer_key").alias("old_customer_key"),
        F.col("source_updated_at").alias("_at"),
    )
    return updates.join(
        before, (F.col("order_id") == F.col("_id")) & (F.col("source_updated_at") == F.col("_at"))
    ).select("order_id", "order_key", "old_customer_key", "customer_key", "source_updated_at")


# --- ledger and jobs -------------------------------------------------------


def _batches(spark, d):
    return ledger.latest_state(table(spark, d, "ledger_revisions"))


@query
def ledger_status(spark, d):
    """Newest state per batch, with the status its reject count calls for."""
    return _batches(spark, d).select(
        "batch_id", "pipeline_name", "batch_status", "started_at", "completed_at",
        "loaded_row_count", "rejected_row_count", "error_message",
        ledger.completed_status().alias("status_if_completed"),
    )


@query
def last_watermark(spark, d):
    return ledger.last_watermarks(_batches(spark, d), "mysql_watermark_to")


@query
def recent_batches_ok(spark, d):
    return ledger.recent_batches(_batches(spark, d))


def _scratch(spark: SparkSession) -> str:
    """A new warehouse in the folder that all executors share; below the catalog's where none is named."""
    base = shared_folder(spark) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"
    return f"{base.rstrip('/')}/warehouse-{uuid4().hex}"


@query
def run_dimension(spark, d):
    """Customer dimension after the jobs of two successive source windows."""
    warehouse = Warehouse(spark, _scratch(spark), buckets=8)
    book = ledger.Ledger(warehouse)
    for source in ("src_customers", "src_customers_next"):
        feed = jobs.Feed(table(spark, d, source))
        jobs.run_entity(warehouse, book, "customer", feed, {})
    return jobs.read_dimension(warehouse, "customer").select(
        [c for c in _VERSION if c != "batch_id"])


@query
def run_fact(spark, d):
    """Order fact loaded by its job against dimensions loaded by theirs."""
    warehouse = Warehouse(spark, _scratch(spark), buckets=8)
    book = ledger.Ledger(warehouse)
    sources = {s: table(spark, d, f"src_{s}") for s in ("customers", "restaurants", "orders")}
    for pipeline in ("customer", "restaurant", "order"):
        feed = jobs.Feed(sources[jobs.SOURCE_OF[pipeline]])
        jobs.run_entity(warehouse, book, pipeline, feed, sources)
    customers = jobs.read_dimension(warehouse, "customer").select("customer_key", "customer_id")
    restaurants = jobs.read_dimension(warehouse, "restaurant").select(
        "restaurant_key", "restaurant_id")
    return (
        jobs.read_fact(warehouse, "order")
        .join(customers, "customer_key", "left").join(restaurants, "restaurant_key", "left")
        .select("order_id", "customer_id", "restaurant_id", "order_date_key", "order_status",
                "total_amount", "ordered_at", "source_updated_at")
    )


# --- checks ----------------------------------------------------------------


def _tables(spark, d, *names):
    source = {
        "dim_customer": "bad_dim_customer", "dim_driver": "bad_dim_driver",
        "dim_restaurant": "hist_restaurant", "dim_menu_item": "hist_menu_item",
        "fact_order": "bad_fact_order", "fact_order_item": "bad_fact_order_item",
        "fact_payment": "bad_fact_payment", "fact_delivery_attempt": "bad_fact_delivery",
    }
    return {n: table(spark, d, source[n]) for n in names}


_DIMENSIONS = ("dim_customer", "dim_restaurant", "dim_driver", "dim_menu_item")
_FACTS = ("fact_order", "fact_order_item", "fact_payment", "fact_delivery_attempt")


@query
def dq_one_current(spark, d):
    return W.one_current(_tables(spark, d, *_DIMENSIONS))


@query
def dq_unique_current(spark, d):
    return W.unique_current(_tables(spark, d, "dim_customer", "dim_driver"))


@query
def dq_required(spark, d):
    return W.required(_tables(spark, d, "dim_customer", "dim_driver", "fact_order"))


@query
def dq_current_open(spark, d):
    return W.current_open(_tables(spark, d, *_DIMENSIONS))


@query
def dq_fact_keys(spark, d):
    return W.fact_keys(_tables(spark, d, *_FACTS))


@query
def staging_empty(spark, d):
    """Rows left in the eight staging tables when nothing has been purged."""
    return W.staging_empty([_clean(spark, d, n) for n in jobs.SOURCE_OF])


@query
def ck_not_null(spark, d):
    return W.not_null(_tables(spark, d, *_DIMENSIONS, *_FACTS))


@query
def ck_unique(spark, d):
    return W.unique(_tables(spark, d, *_DIMENSIONS, *_FACTS) | {"etl_batch": _batches(spark, d)})


@query
def ck_foreign_key(spark, d):
    tables = _tables(spark, d, *_DIMENSIONS, *_FACTS) | {
        "dim_date": seeds.dim_date(spark), "dim_payment_method": seeds.dim_payment_method(spark),
        "etl_batch": _batches(spark, d),
    }
    return W.foreign_keys(tables)


@query
def ck_source_foreign_key(spark, d):
    return W.source_foreign_keys({s: table(spark, d, f"src_{s}") for s in (
        "customers", "restaurants", "drivers", "orders", "order_items", "payments", "deliveries")})


@query
def ck_identifier(spark, d):
    """Dimensions with some identifiers negated or emptied."""
    tables = _tables(spark, d, *_DIMENSIONS)
    for t in ("dim_customer", "dim_restaurant", "dim_driver"):
        name = W.DIMENSION_OF[t].identifier
        tables[t] = tables[t].withColumn(name, F.when(F.col(name) % 7 == 3, -F.col(name)).otherwise(F.col(name)))
    tables["dim_menu_item"] = tables["dim_menu_item"].withColumns({
        "menu_item_id": F.when(F.col("menu_item_key") % 11 == 4, F.lit("")).otherwise(F.col("menu_item_id")),
        "restaurant_id": F.col("restaurant_id") - 3,
    })
    return W.identifiers(tables)


@query
def ck_valid_period(spark, d):
    return W.valid_period(_tables(spark, d, *_DIMENSIONS))


@query
def ck_amounts(spark, d):
    return W.amounts(_tables(spark, d, "fact_order", "fact_order_item", "fact_payment",
                             "dim_menu_item"))


@query
def ck_domains(spark, d):
    return W.domains(_tables(spark, d, "fact_order", "fact_payment", "fact_delivery_attempt"))


@query
def ck_dim_date(spark, d):
    """The calendar, and the same calendar with the key taken from each day's orders."""
    calendar = seeds.dim_date(spark)
    used = table(spark, d, "order_base").select(
        C.business_date_key("placed").alias("date_key"),
        (C.business_date_key("placed") + F.col("k").cast("int") % 2).alias("_shown"),
    )
    shown = used.join(calendar, "date_key").drop("date_key").withColumnRenamed("_shown", "date_key")
    return W.date_rows(calendar.unionByName(shown))


@query
def ck_ledger(spark, d):
    return W.ledger_rows(_batches(spark, d))


@query
def ck_not_blank(spark, d):
    return W.not_blank({s: table(spark, d, f"src_{s}") for s in ("customers", "drivers", "orders")})


@query
def ck_lengths(spark, d):
    long_names = {
        t: df.withColumn("city", F.repeat("city", 12)) if "city" in df.columns else df
        for t, df in _tables(spark, d, *_DIMENSIONS, *_FACTS).items()
    }
    return W.lengths(long_names)


# --- reports ---------------------------------------------------------------


@query
def hourly_item_sales(spark, d):
    """Flagship: clean lines, find their menu item as of the order time, report by local hour."""
    item = DIMENSIONS["menu_item"]
    versions = _dimensions(spark, d, ["menu_item"])["menu_item"]
    lookup = temporal.VersionLookup(versions, item.identifier, item.key)
    resolved = temporal.as_of_lookup(_clean(spark, d, "order_item"), lookup, "ordered_at")
    return reports.hourly_item_sales(resolved, table(spark, d, "hist_menu_item"))
