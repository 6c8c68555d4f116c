from datetime import datetime
from decimal import Decimal

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.operators.seeds import dim_date, dim_payment_method


def column(df, expression):
    return [row[0] for row in df.select(expression).collect()]


def test_bad_text_becomes_null(frame):
    df = frame("v string", ("abc",), ("5.x",), ("maybe",), ("7",), (None,), ("2.7",))
    assert column(df, C.safe_cast("v", "bigint")) == [None, None, None, 7, None, None]
    assert column(df, C.safe_cast("v", C.MONEY))[1:4] == [None, None, Decimal("7.00")]
    assert column(df, C.safe_cast("v", "boolean"))[2] is None


def test_timestamps_become_utc_whatever_the_session_zone(spark, frame):
    df = frame("v string", ("2026-07-19T10:30:00Z",), ("2026-07-19T10:30:00+07:00",),
               ("2026-07-19 10:30:00",), ("bogus",), (None,))
    expected = [datetime(2026, 7, 19, 10, 30), datetime(2026, 7, 19, 3, 30),
                datetime(2026, 7, 19, 10, 30), None, None]
    for zone in ("UTC", "America/New_York", "Asia/Bangkok"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            assert column(df, C.utc(df, "v")) == expected
            instants = df.select(F.col("v").try_cast("timestamp").alias("t")).limit(1)
            assert column(instants, C.utc(instants, "t")) == expected[:1]
        finally:
            spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_text(frame):
    df = frame("v string", ("  x ",), ("",), ("   ",), (None,), ("\tx",))
    assert column(df, C.optional_text("v")) == ["x", None, None, None, "\tx"]
    names = frame("v string", (" bKK-1 ",), ("samut PRAKAN ",))
    assert column(names, C.code_text("v")) == ["BKK-1", "SAMUT PRAKAN"]
    assert column(names, C.email_text("v")) == ["bkk-1", "samut prakan"]
    assert column(names, C.title_text("v")) == ["Bkk-1", "Samut Prakan"]


def test_arrays(spark):
    df = spark.createDataFrame(
        [(None,), ([],), (["b", "a"],), (["b", None, "a"],)], "tags array<string>")
    sorted_tags = df.select(C.normalized_array("tags").alias("tags"))
    assert column(sorted_tags, F.col("tags")) == [[], [], ["a", "b"], ["a", "b", None]]
    assert column(sorted_tags, C.array_text("tags")) == ["", "", "a,b", "a,b"]
    back = sorted_tags.select(C.json_to_array(C.array_to_json("tags")).alias("tags"))
    assert column(back, F.col("tags")) == [[], [], ["a", "b"], ["a", "b", None]]


def test_renamed_field(frame):
    df = frame("basePrice string; base_price string", ("159.00", None), (None, "10"), ("x", "3"))
    price = C.first_castable(df, ["basePrice", "base_price"], C.MONEY)
    assert column(df, price) == [Decimal("159.00"), Decimal("10.00"), Decimal("3.00")]
    assert column(df, C.first_castable(df, ["gone"], C.MONEY)) == [None] * 3


def test_business_dates(frame):
    df = frame("t timestamp_ntz", ("2026-07-19 16:59:59",), ("2026-07-19 17:00:00",), (None,))
    assert column(df, C.business_date_key("t")) == [20260719, 20260720, None]
    assert column(df, C.date_key_or_unknown("t")) == [20260719, 20260720, 0]


def test_hash_marks_missing_values(frame):
    df = frame("a string; b string", ("x", None), ("x", "<NULL>"), ("x", "y"))
    missing, marker, other = column(df, C.change_hash(["a", "b"], nullable=["b"]))
    assert missing == marker != other
    assert len(missing) == 64


def test_money(frame):
    df = frame("s decimal(12,2); d decimal(12,2); f decimal(12,2); q int",
               (Decimal("100.10"), Decimal("0.20"), Decimal("5.05"), 3))
    assert column(df, C.order_total("s", "d", "f")) == [Decimal("104.95")]
    assert column(df, C.line_total("q", "s")) == [Decimal("300.30")]


@settings(max_examples=20, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=8)), min_size=1, max_size=12))
def test_optional_text_never_blank(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    for before, after in zip(values, column(df, C.optional_text("v")), strict=True):
        assert after == ((before or "").strip(" ") or None)


def test_static_dimensions(spark):
    days = {r.date_key: r for r in dim_date(spark).collect()}
    assert len(days) == 5845 and days[0].full_date is None
    assert (days[20200101].day_name, days[20200101].day_of_week) == ("Wed", 3)
    assert days[20210101].week_of_year == 53
    assert days[20351231].month_name == "Dec" and days[20210102].is_weekend
    codes = [r.payment_method_code for r in dim_payment_method(spark).orderBy("payment_method_key").collect()]
    assert codes == ["UNKNOWN", "CARD", "PROMPTPAY", "CASH", "WALLET"]
