import json
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tidemark.sources import windows as W
from tidemark.sources.delimited import LAYOUTS, read_delimited
from tidemark.sources.documents import parse_documents, read_documents
from tidemark.sources.relational import RelationalSource, checked_identifier
from tidemark.sources.warehouse import Warehouse, purge_rows, stage_projection

ROWS = "id bigint; updated_at timestamp_ntz"


def ids(df):
    return sorted(r[0] for r in df.select(df.columns[0]).collect())


def test_window_bounds(frame):
    df = frame(ROWS, (1, "2026-01-01"), (2, "2026-01-02"), (3, "2026-01-03"), (4, None))
    low, high = datetime(2026, 1, 1), datetime(2026, 1, 2)
    assert ids(W.incremental_window(df, "updated_at", low, high)) == [2]
    empty = W.incremental_window(df, "updated_at", low, None)
    assert empty.columns == df.columns and empty.count() == 0
    with pytest.raises(ValueError):
        W.incremental_window(df, "updated_at", None, high)
    assert ids(W.lookback_window(df, "updated_at", high, datetime(2026, 1, 3), timedelta(days=2))) == [1, 2, 3]
    instants = df.withColumn("updated_at", F.col("updated_at").cast("timestamp"))
    assert ids(W.incremental_window(instants, "updated_at", low, high)) == [2]


def test_window_reaches_the_parquet_scan(spark, frame, tmp_path):
    path = str(tmp_path / "t")
    frame(ROWS, (1, "2026-01-01"), (2, "2026-01-02")).write.parquet(path)
    windowed = W.incremental_window(
        spark.read.parquet(path), "updated_at", "2026-01-01T00:00:00Z", "2026-01-05")
    plan = windowed._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(updated_at" in plan and "LessThanOrEqual(updated_at" in plan


def test_watermarks(frame):
    df = frame(ROWS, (1, "2026-01-01 00:00:00.25"), (2, None))
    assert W.watermark_value(W.high_watermark(df, "updated_at")) == datetime(2026, 1, 1, 0, 0, 0, 250000)
    assert W.watermark_value(W.high_watermark(df.filter("false"), "updated_at")) is None
    assert W.as_utc_naive("2026-01-01T07:00:00+07:00") == datetime(2026, 1, 1)
    assert W.as_utc_naive(datetime(2026, 1, 1, tzinfo=timezone.utc)) == datetime(2026, 1, 1)
    docs = frame("u string", ("2026-01-01T07:00:00+07:00",), ("bogus",), (None,), ("2025-01-01T00:00:00Z",))
    assert W.watermark_value(W.document_watermark(docs, "u")) == datetime(2026, 1, 1)
    assert W.document_window(docs, "u", "2024-01-01", "2027-01-01").count() == 2
    assert W.document_window(docs, "u", "2024-01-01", None).count() == 0
    with pytest.raises(ValueError):
        W.document_window(docs, "u", None, None)


def test_documents_keep_their_schema(spark, tmp_path):
    path = tmp_path / "menu.jsonl"
    path.write_text(json.dumps({"_id": "M1", "base_price": 12.5, "tags": ["a"], "available": True}) + "\n"
                    + json.dumps({"_id": "M2", "basePrice": "7.00", "options": [
                        {"name": "S", "required": True, "choices": [{"name": "L", "extraPrice": 4}]}]}) + "\n")
    rows = {r._id: r for r in read_documents(spark, str(path)).collect()}
    assert rows["M1"].base_price == "12.5" and rows["M1"].available == "true"
    assert rows["M2"].options[0].choices[0].name == "L" and rows["M2"].tags is None
    (tmp_path / "empty.jsonl").write_text("")
    assert "updatedAt" in read_documents(spark, str(tmp_path / "empty.jsonl")).columns
    text = spark.createDataFrame([('{"_id": "M3", "basePrice": 3}',)], "t string")
    assert parse_documents(text, "t").first().basePrice == "3"


def test_delimited(spark, tmp_path):
    path = tmp_path / "customers.csv"
    path.write_text('customer_id,full_name,email,phone,city,created_at,updated_at\r\n'
                    '1,"Ann ""A"" Lee, Jr", A@X ," 08 ",Bangkok,2026-01-01T00:00:00Z,2026-01-02T00:00:00Z\r\n'
                    'x,Bob,b@x,1,BKK,never,2026-01-02T00:00:00Z\r\n')
    first, second = read_delimited(spark, str(path), "customers").collect()
    assert (first.customer_id, first.full_name, first.email, first.phone) == (1, 'Ann "A" Lee, Jr', "a@x", "08")
    assert first.updated_at == datetime(2026, 1, 2)
    assert second.customer_id is None and second.created_at is None
    pay = tmp_path / "payments.csv"
    pay.write_text('payment_id,order_id,payment_method,payment_status,amount,transaction_ref,paid_at,created_at,updated_at\n'
                   '1,1,CARD,PENDING,5.5,"",,2026-01-01T00:00:00Z,2026-01-01T00:00:00Z\n')
    row = read_delimited(spark, str(pay), "payments").first()
    assert row.transaction_ref is None and row.paid_at is None and str(row.amount) == "5.50"
    assert len(LAYOUTS) == 7


class RecordedSource(RelationalSource):
    """Answers reads from a frame and records the JDBC options. No database runs."""

    def answer(self, rows):
        object.__setattr__(self, "rows", rows)
        object.__setattr__(self, "calls", [])
        return self

    def _load(self, spark, **options):
        self.calls.append(options)
        if "MIN(" in options.get("query", ""):
            return self.rows.agg(F.min("id"), F.max("id"))
        if "MAX(" in options.get("query", ""):
            return self.rows.agg(F.max("updated_at"))
        return self.rows


def test_relational_source_options(spark, frame):
    rows = frame(ROWS, (1, "2026-01-01"), (2, "2026-01-03"), (9, "2026-01-05"))
    source = RecordedSource("jdbc:x", "d", quote='"').answer(rows)
    source.read(spark, "items")
    source.read(spark, "items", "id", partitions=4)
    assert source.calls[0] == {"dbtable": '"items"'}
    assert source.calls[1]["query"] == 'SELECT MIN("id") AS low, MAX("id") AS high FROM "items"'
    assert source.calls[2] == {"dbtable": '"items"', "partitionColumn": "id", "lowerBound": "1",
                               "upperBound": "9", "numPartitions": "4"}
    assert source.high_watermark(spark, "items", "updated_at") == datetime(2026, 1, 5)
    low, high = datetime(2026, 1, 1), datetime(2026, 1, 3)
    assert ids(source.read_window(spark, "items", "updated_at", low, high)) == [2]
    assert source.read_window(spark, "items", "updated_at", low, None).count() == 0
    with pytest.raises(ValueError):
        source.read_window(spark, "items", "updated_at", None, high)
    empty = RecordedSource("jdbc:x", "d").answer(rows.filter("false"))
    empty.read(spark, "items", "id", partitions=4)
    assert empty.calls[-1] == {"dbtable": "items"}
    assert empty.high_watermark(spark, "items", "updated_at") is None


def test_names_are_checked():
    assert checked_identifier("order_items2") == "order_items2"
    for name in ("a b", "a;drop", "a-b", ""):
        with pytest.raises(ValueError):
            checked_identifier(name)


def test_staging_folders(spark, frame, tmp_path):
    warehouse = Warehouse(spark, str(tmp_path))
    schema = "batch_id string, id bigint"
    assert warehouse.read("staging", "t", schema).count() == 0
    rows = frame("id bigint", (1,), (2,))
    warehouse.append_batch(stage_projection(rows, ["id"], "b1"), "staging", "t")
    warehouse.append_batch(stage_projection(rows, ["id"], "b2"), "staging", "t")
    warehouse.replace_batch(stage_projection(rows, ["id"], "b2"), "staging", "t")
    staged = warehouse.read("staging", "t", schema)
    assert staged.groupBy("batch_id").count().orderBy("batch_id").collect() == [("b1", 2), ("b2", 2)]
    assert ids(purge_rows(staged, "b1")) == ["b2", "b2"]
    warehouse.purge_batch("staging", "t", "b1")
    assert ids(warehouse.read("staging", "t", schema)) == ["b2", "b2"]
    assert [warehouse.reserve_keys("f", n) for n in (3, 0, 2, 1)] == [0, 3, 3, 5]
    assert warehouse.reserve_keys("g", 1) == 0
