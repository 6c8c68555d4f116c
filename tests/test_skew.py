"""Plans under a key that owns a third of the rows."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators.dedup import latest_per_key
from tidemark.operators.lookup import left_lookup, splittable_join
from tidemark.operators.temporal import VersionLookup, as_of_lookup

SETTINGS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "50KB",
    "spark.sql.shuffle.partitions": "16",
}


@pytest.fixture
def small_thresholds(spark):
    before = {k: spark.conf.get(k, None) for k in SETTINGS}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.fixture
def hot(spark):
    return spark.range(150_000).selectExpr(
        "CASE WHEN id % 3 = 0 THEN 7 ELSE id END AS k", "id AS v", "sha1(cast(id AS string)) AS pad",
        "timestamp_ntz'2026-01-01' + make_dt_interval(id % 300) AS at")


def final_plan(df):
    df = df.groupBy("v").count()
    rows = df.count()
    df.collect()
    return rows, df._jdf.queryExecution().executedPlan().toString()


def test_lookup_splits_a_hot_key(spark, small_thresholds, hot):
    parents = latest_per_key(
        spark.range(150_000).selectExpr("id % 149000 AS rk", "id AS t", "id * 2 AS x"), ["rk"], "t")
    rows, plan = final_plan(left_lookup(hot, parents, "k", "rk"))
    assert rows == 150_000 and "SortMergeJoin(skew=true)" in plan


def test_semi_join_splits_a_hot_key(spark, small_thresholds, hot):
    keys = spark.range(150_000).selectExpr("id % 75000 AS rk").groupBy("rk").count().filter("count > 1")
    joined = splittable_join(hot, keys, "k", "rk", "left_semi")
    rows, plan = final_plan(joined)
    assert rows == hot.filter("k < 75000").count() and "SortMergeJoin(skew=true)" in plan


def test_point_in_time_lookup_splits_a_hot_identifier(spark, small_thresholds, hot):
    versions = spark.range(150_000).selectExpr(
        "id AS k", "id AS key", "timestamp_ntz'2026-01-10' AS valid_from",
        "CAST(NULL AS timestamp_ntz) AS valid_to").repartition(8)
    resolved = as_of_lookup(hot, VersionLookup(versions, "k", "key"), "at")
    rows, plan = final_plan(resolved)
    assert rows == 150_000 and "SortMergeJoin(skew=true)" in plan
    early = resolved.agg(F.count_if((F.col("at") < "2026-01-10") & (F.col("key") != 0))).first()[0]
    assert early == 0
