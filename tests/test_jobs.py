import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators.ledger import Ledger, last_watermark, last_watermarks, latest_state, recent_batches
from tidemark.plans import jobs
from tidemark.plans.reports import hourly_item_sales
from tidemark.sources.delimited import LAYOUTS
from tidemark.sources.documents import MENU_DOCUMENT
from tidemark.sources.warehouse import Warehouse


def table(spark, name, *rows):
    names = [p.split(" ")[0] for p in LAYOUTS[name].split(", ")]
    kinds = dict(p.split(" ", 1) for p in LAYOUTS[name].split(", "))
    text = spark.createDataFrame(list(rows), ", ".join(f"{n} string" for n in names))
    return text.select(*[F.col(n).cast(kinds[n]).alias(n) for n in names])


def stamp(d, h=0):
    return f"2026-03-{d:02d} {h:02d}:00:00"


def menu(spark, *rows):
    docs = [json.dumps({"_id": i, "restaurantId": r, "name": n, "category": "main", "basePrice": p,
                        "available": True, "tags": ["b", "a"], "createdAt": "2026-01-01T00:00:00Z",
                        "updatedAt": u}) for i, r, n, p, u in rows]
    return spark.createDataFrame([(d,) for d in docs], "d string").select(
        F.from_json("d", MENU_DOCUMENT).alias("x")).select("x.*")


def sources(spark):
    return {
        "customers": table(spark, "customers",
                           ("1", "Ann", "a@x", "1", "bangkok", "2026-01-01", stamp(1)),
                           ("2", "Bob", "b@x", "2", "bangkok", "2026-01-01", stamp(2)),
                           ("3", "Cid", "c@x", " ", "bangkok", "2026-01-01", stamp(2))),
        "restaurants": table(spark, "restaurants",
                             ("1", "R1", "thai", "bkk", None, "active", "2026-01-01", stamp(1))),
        "drivers": table(spark, "drivers",
                         ("1", "Dan", "1", "p-1", "active", "2026-01-01", stamp(1))),
        "menu_items": menu(spark, ("M1", 1, "Rice", "10", "2026-03-01T00:00:00Z")),
        "orders": table(spark, "orders",
                        ("1", "1", "1", "Road", "delivered", "20", "0", "5", "25", stamp(5), stamp(5), stamp(5)),
                        ("2", "9", "1", "Road", "preparing", "10", "0", "0", "1", stamp(6), stamp(6), stamp(6)),
                        ("3", "1", "1", " ", "delivered", "20", "0", "5", "25", stamp(5), stamp(5), stamp(5))),
        "order_items": table(spark, "order_items",
                             ("1", "1", "M1", "Rice", "2", "10", "20", stamp(5), stamp(5)),
                             ("2", "2", "M9", "Soup", "1", "10", "10", stamp(6), stamp(6))),
        "payments": table(spark, "payments",
                          ("1", "1", "card", "paid", "25", "TX", stamp(5, 1), stamp(5), stamp(5, 1)),
                          ("2", "2", "cash", "pending", "10", None, None, stamp(6), stamp(6))),
        "deliveries": table(spark, "deliveries",
                            ("1", "1", "1", "delivered", "3.5", stamp(5), stamp(5, 1), stamp(5, 2),
                             stamp(5), stamp(5, 2))),
    }


class Clock:
    def __init__(self):
        self.now = datetime(2026, 4, 1)

    def __call__(self):
        self.now += timedelta(seconds=1)
        return self.now


@pytest.fixture
def warehouse(spark, tmp_path):
    return Warehouse(spark, str(tmp_path / "warehouse"), buckets=2)


@pytest.fixture
def book(warehouse):
    return Ledger(warehouse, Clock())


def test_full_load_then_changes(spark, warehouse, book):
    first = sources(spark)
    runs, report = jobs.run_full_load(warehouse, book, first)
    assert [r["batch_status"] for r in runs] == [
        "PARTIAL", "SUCCEEDED", "SUCCEEDED", "SUCCEEDED", "PARTIAL", "PARTIAL", "SUCCEEDED", "SUCCEEDED"]
    assert [r["loaded_row_count"] for r in runs] == [2, 1, 1, 1, 2, 1, 2, 1]
    failures = {r.check_name: r.violations for r in report.collect() if r.violations}
    assert failures == {}
    assert report.count() == 19
    quarantined = spark.read.parquet(warehouse.path("quarantine", "order_item"))
    assert [r.rejection_reason for r in quarantined.collect()] == ["MENU_ITEM_NOT_FOUND"]

    orders = {r.order_id: r for r in jobs.read_fact(warehouse, "order").collect()}
    assert orders[1].customer_key > 0 and orders[2].customer_key == 0
    assert str(orders[2].total_amount) == "10.00" and orders[1].event_month == 202603
    payments = {r.payment_id: r for r in jobs.read_fact(warehouse, "payment").collect()}
    assert payments[2].paid_date_key == 0 and payments[1].payment_method_key == 1
    item = jobs.read_dimension(warehouse, "menu_item").filter("menu_item_key > 0").first()
    assert item.tags == ["a", "b"]

    # Nothing new: a second run reads empty windows and writes nothing.
    runs, _ = jobs.run_full_load(warehouse, book, first)
    assert [r["input_row_count"] for r in runs] == [0] * 8
    assert {r.order_id: r for r in jobs.read_fact(warehouse, "order").collect()} == orders

    # The late customer arrives, Ann moves, order 1 changes month, order 2 is replayed.
    later = first | {
        "customers": table(spark, "customers",
                           ("1", "Ann", "a@x", "1", "chiang mai", "2026-01-01", stamp(10)),
                           ("9", "Zoe", "z@x", "9", "bangkok", "2026-01-01", stamp(9))),
        "orders": table(spark, "orders",
                        ("1", "1", "1", "Road", "delivered", "20", "0", "5", "25",
                         "2026-02-01", "2026-02-01", stamp(12)),
                        ("2", "9", "1", "Road", "preparing", "10", "0", "0", "1", stamp(6), stamp(6), stamp(6))),
    }
    jobs.run_entity(warehouse, book, "customer", jobs.as_feed("customer", later["customers"]), later)
    jobs.run_entity(warehouse, book, "order", jobs.as_feed("order", later["orders"]), later,
                    lookback=timedelta(days=30))
    versions = jobs.read_dimension(warehouse, "customer").filter("customer_id = 1").orderBy("valid_from").collect()
    assert [(r.city, r.is_current) for r in versions] == [("Bangkok", False), ("Chiang Mai", True)]
    assert versions[0].valid_to == versions[1].valid_from == datetime(2026, 3, 10)
    after = {r.order_id: r for r in jobs.read_fact(warehouse, "order").collect()}
    assert len(after) == 2 and jobs.read_fact(warehouse, "order").count() == 2
    assert after[1].event_month == 202602 and after[1].order_key == orders[1].order_key
    assert after[1].customer_key == versions[0].customer_key
    assert after[2].customer_key > 0 and after[2].order_key == orders[2].order_key
    keys = [r.customer_key for r in jobs.read_dimension(warehouse, "customer").collect()]
    assert sorted(keys) == [0, 1, 2, 3, 4]


def test_emptied_month_disappears(spark, warehouse, book):
    src = sources(spark)
    only = table(spark, "orders", ("1", "1", "1", "Road", "delivered", "20", "0", "5", "25",
                                   stamp(5), stamp(5), stamp(5)))
    moved = table(spark, "orders", ("1", "1", "1", "Road", "delivered", "20", "0", "5", "25",
                                    "2026-01-05", "2026-01-05", stamp(6)))
    for rows in (only, moved):
        jobs.run_entity(warehouse, book, "order", jobs.as_feed("order", rows), src)
    assert [(r.order_id, r.event_month) for r in jobs.read_fact(warehouse, "order").collect()] == [(1, 202601)]
    assert [c.split("/")[0] for c in warehouse.table("fact_order").manifest().cells("rows")] == ["event_month=202601"]


def test_shared_email_stops_the_batch(spark, warehouse, book):
    rows = table(spark, "customers", ("1", "Ann", "a@x", "1", "bkk", "2026-01-01", stamp(1)),
                 ("2", "Bob", " A@X", "2", "bkk", "2026-01-01", stamp(1)))
    with pytest.raises(RuntimeError, match="unique"):
        jobs.run_entity(warehouse, book, "customer", jobs.as_feed("customer", rows), {})
    batch = book.batches().first()
    assert batch.batch_status == "FAILED" and "unique" in batch.error_message
    assert jobs.read_dimension(warehouse, "customer").count() == 0
    assert jobs.read_staging(warehouse, "customer").count() == 2
    assert book.resume_from("customer", "mysql_watermark_to") == datetime(1900, 1, 1)


def test_more_closes_than_inserts_stop_the_batch(spark, warehouse, book):
    src = sources(spark)
    feed = jobs.as_feed("restaurant", src["restaurants"])
    jobs.run_entity(warehouse, book, "restaurant", feed, src)
    stored = jobs.read_dimension(warehouse, "restaurant")
    newer = stored.withColumns({
        "restaurant_key": F.col("restaurant_key") + 100, "hash_diff": F.lit("f" * 64),
        "source_updated_at": F.col("source_updated_at") + F.expr("INTERVAL 90 DAY")})
    rows = spark.createDataFrame(stored.unionByName(newer).collect(), stored.schema)
    jobs.replace_dimension(warehouse, "restaurant", rows)
    moved = table(spark, "restaurants", ("1", "R1", "thai", "elsewhere", None, "active", "2026-01-01", stamp(20)))
    with pytest.raises(RuntimeError, match="closes more"):
        jobs.run_entity(warehouse, book, "restaurant", jobs.as_feed("restaurant", moved), src)
    assert jobs.read_dimension(warehouse, "restaurant").filter("is_current").count() == 2


def test_overlapping_versions_stop_the_fact(spark, warehouse, book):
    src = sources(spark)
    jobs.run_entity(warehouse, book, "customer", jobs.as_feed("customer", src["customers"]), src)
    broken = jobs.read_dimension(warehouse, "customer")
    twice = broken.unionByName(broken.withColumn("customer_key", F.col("customer_key") + 100))
    rows = spark.createDataFrame(twice.collect(), twice.schema)
    jobs.replace_dimension(warehouse, "customer", rows)
    with pytest.raises(RuntimeError, match="several versions"):
        jobs.run_entity(warehouse, book, "order", jobs.as_feed("order", src["orders"]), src)
    assert jobs.read_fact(warehouse, "order").count() == 0


def test_interrupted_merge_is_repaired_by_running_again(spark, warehouse, book, monkeypatch):
    src = sources(spark)
    feed = jobs.as_feed("customer", src["customers"])
    monkeypatch.setattr(Warehouse, "purge_batch", lambda *_: (_ for _ in ()).throw(OSError("gone")))
    with pytest.raises(OSError):
        jobs.run_entity(warehouse, book, "customer", feed, src)
    monkeypatch.undo()
    done = jobs.run_entity(warehouse, book, "customer", feed, src)
    assert done["batch_status"] == "PARTIAL" and done["loaded_row_count"] == 0
    assert jobs.read_dimension(warehouse, "customer").count() == 2


LEDGER = ("batch_id string; pipeline_name string; started_at timestamp_ntz; completed_at timestamp_ntz; "
          "batch_status string; mysql_watermark_to timestamp_ntz; revision int")


def test_ledger_relations(frame):
    revisions = frame(
        LEDGER, ("1", "p", stamp(1), None, "RUNNING", stamp(1), 1), ("1", "p", stamp(1), stamp(2), "SUCCEEDED", stamp(1), 2),
        ("2", "p", stamp(3), None, "RUNNING", stamp(3), 1), ("2", "p", stamp(3), stamp(4), "FAILED", stamp(3), 2),
        ("3", "q", stamp(1), stamp(2), "PARTIAL", None, 1))
    batches = latest_state(revisions)
    assert {r.batch_id: r.batch_status for r in batches.collect()} == {
        "1": "SUCCEEDED", "2": "FAILED", "3": "PARTIAL"}
    assert [tuple(r) for r in last_watermarks(batches, "mysql_watermark_to").collect()] == [
        ("p", datetime(2026, 3, 1))]
    assert last_watermark(batches, "p", "mysql_watermark_to") == datetime(2026, 3, 1)
    assert last_watermark(batches, "q", "mysql_watermark_to") == datetime(1900, 1, 1)
    with pytest.raises(ValueError):
        last_watermark(batches, "", "mysql_watermark_to")
    assert recent_batches(batches).first().violations == 6
    assert recent_batches(batches.filter("false")).first().violations == 8


def test_hourly_sales(frame):
    lines = frame("ordered_at timestamp_ntz; menu_item_key bigint; quantity int; total_price decimal(12,2)") \
        .unionByName(frame("ordered_at timestamp_ntz; menu_item_key bigint; quantity int; total_price string",
                           (stamp(5, 4), 1, 2, "20"), (stamp(6, 4), 1, 1, "10"), (stamp(5, 20), 0, 1, "5"))
                     .withColumn("total_price", F.col("total_price").cast("decimal(12,2)")))
    items = frame("menu_item_key bigint; menu_item_id string; menu_item_name string", (1, "M1", "Rice"))
    out = {(r.local_hour, r.menu_item_id): (r.order_lines, r.quantity, float(r.revenue))
           for r in hourly_item_sales(lines, items).collect()}
    assert out == {(11, "M1"): (2, 3, 30.0), (3, "UNKNOWN"): (1, 1, 5.0)}


def test_batches_narrow_their_lookups(spark):
    src = sources(spark)
    one = src["payments"].filter("payment_id = 1")
    small = jobs.narrowed(src, "payment", one)
    assert [r.order_id for r in small["orders"].collect()] == [1]
    items = jobs.narrowed(src, "order_item", src["order_items"])
    assert {r._id for r in items["menu_items"].collect()} == {"M1"}
    judged = jobs.JUDGES["order_item"](src["order_items"], src).collect()
    assert sorted(map(str, judged)) == sorted(
        map(str, jobs.JUDGES["order_item"](src["order_items"], items).collect()))
