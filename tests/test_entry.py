import duckdb
import pytest

import __spark_entry__ as entry_file
from compare import BASE, normalized
from tidemark.plans.facts import DIMENSIONS, FACTS

SF = "/root/testdata/sf0.001"
SAMPLE = ["watermark_probe", "clean_orders", "asof_join", "scd2_apply", "fact_upsert", "ck_foreign_key"]


def test_every_query_has_sql():
    assert set(entry_file.QUERIES) <= set(entry_file.oracle_sql()) <= set(entry_file.queries())


def test_entry_runs(spark):
    assert entry_file.entry(spark).count() > 0


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_sql(spark, name):
    duck = duckdb.connect()
    for t in BASE:
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    ours = entry_file.queries()[name](spark, SF)
    duck.execute(entry_file.oracle_sql()[name])
    columns = [c[0] for c in duck.description]
    assert normalized(ours.columns, ours.collect()) == normalized(columns, duck.fetchall())


def test_contracts_cover_the_star():
    assert set(DIMENSIONS) == {"customer", "restaurant", "driver", "menu_item"}
    assert FACTS["payment"].key_columns() == [
        "customer_key", "restaurant_key", "payment_method_key", "payment_created_date_key", "paid_date_key"]
