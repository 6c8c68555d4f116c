"""Nothing depends on the session's zone or on that of the driver's host."""

import os
import time
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.operators.ledger import Ledger
from tidemark.plans import jobs
from tidemark.sources import windows as W
from tidemark.sources.warehouse import Warehouse

ZONES = ("UTC", "Asia/Bangkok", "America/New_York")
TEXTS = {
    "2024-03-01": "2024-03-01 00:00:00", "2024-03-01 10:00:00": "2024-03-01 10:00:00",
    "2024-03-01 10:00:00 Asia/Bangkok": "2024-03-01 03:00:00", "2024-03-01T10:00:00.25 UTC": "2024-03-01 10:00:00.25",
    "2024-03-01 10:00:00+7:00": "2024-03-01 03:00:00", "2024-03-01 10:00:00 GMT+7": "2024-03-01 03:00:00",
    "2024-03-01T10:00:00-05:30": "2024-03-01 15:30:00", "2024-11-03T06:30:00Z": "2024-11-03 06:30:00",
    "2024-11-03T05:30:00Z": "2024-11-03 05:30:00", "2024-03-10 02:30:00": "2024-03-10 02:30:00",
    "1969-12-31T23:59:59.999999Z": "1969-12-31 23:59:59.999999", "2024-03": "2024-03-01 00:00:00", "no date": None, "": None,
}


@pytest.fixture(params=ZONES)
def zone(request, spark):
    spark.conf.set("spark.sql.session.timeZone", request.param)
    yield request.param
    spark.conf.set("spark.sql.session.timeZone", "UTC")


@pytest.fixture(params=ZONES)
def host_zone(request):
    before = os.environ.get("TZ")
    os.environ["TZ"] = request.param
    time.tzset()
    yield request.param
    os.environ.pop("TZ") if before is None else os.environ.update(TZ=before)
    time.tzset()


def test_texts_and_instants(spark, zone):
    df = spark.createDataFrame([(t, w) for t, w in TEXTS.items()], "t string, want string")
    for row in df.select("t", "want", C.utc_from_text("t").cast("string").alias("got")).collect():
        assert row.got == row.want, (zone, row.t)
    instants = spark.sql("SELECT timestamp_micros(1730615400000000) AS t")  # 2024-11-03 06:30 UTC
    assert instants.select(C.utc(instants, "t").cast("string")).first()[0] == "2024-11-03 06:30:00"


def test_watermark_is_the_instant(spark, zone, host_zone):
    df = spark.sql("SELECT timestamp_micros(1730615400000001) AS t")
    assert W.watermark_value(W.high_watermark(df, "t")) == datetime(2024, 11, 3, 6, 30, 0, 1)
    assert W.watermark_value(W.high_watermark(df.where("false"), "t")) is None


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
def test_no_source_row_is_skipped(spark, tmp_path, zone, kind):
    """Two runs over a moving source: rows changed between the marks are loaded once each."""
    def customers(*hours):
        rows = [(h, f"n{h}", f"{h}@x", str(h), "bangkok", f"2026-03-01 {h:02d}:00:00") for h in hours]
        df = spark.createDataFrame(rows, "customer_id bigint, full_name string, email string, phone string, city string, at string")
        moment = (F.concat("at", F.lit("Z")) if kind == "timestamp" else F.col("at")).cast(kind)
        return df.select("customer_id", "full_name", "email", F.col("phone").alias("phone_number"), "city",
                         moment.alias("created_at"), moment.alias("updated_at"))

    from tidemark.sources.delimited import LAYOUTS

    names = [p.split(" ")[0] for p in LAYOUTS["customers"].split(", ")]
    first, both = customers(0, 1), customers(0, 1, 3, 9)
    missing = [n for n in names if n not in first.columns]
    first, both = (df.select(*df.columns, *[F.lit(None).cast("string").alias(n) for n in missing]) for df in (first, both))
    warehouse = Warehouse(spark, str(tmp_path / "w"), buckets=2)
    book = Ledger(warehouse)
    counts = [jobs.run_entity(warehouse, book, "customer", jobs.Feed(df), {})["input_row_count"] for df in (first, both)]
    assert counts == [2, 2]


def test_bucket_count_belongs_to_the_warehouse(spark, tmp_path):
    Warehouse(spark, str(tmp_path / "w"), buckets=2).check_layout()
    Warehouse(spark, str(tmp_path / "w"), buckets=2).check_layout()
    with pytest.raises(ValueError, match="2 buckets"):
        Warehouse(spark, str(tmp_path / "w"), buckets=7).check_layout()


@pytest.mark.parametrize("batch_id", ["load 2026-01-02T00:00", "a/b=c%d", "plain"])
def test_batches_with_odd_names_are_purged(spark, tmp_path, batch_id):
    warehouse = Warehouse(spark, str(tmp_path / "w"))
    df = spark.range(5).withColumn("batch_id", F.lit(batch_id))
    other = spark.range(2).withColumn("batch_id", F.lit("other"))
    warehouse.replace_batch(df, "staging", "t")
    warehouse.replace_batch(other, "staging", "t")
    warehouse.purge_batch("staging", "t", batch_id)
    left = warehouse.read("staging", "t", "id bigint, batch_id string").collect()
    assert [r.batch_id for r in left] == ["other", "other"]
