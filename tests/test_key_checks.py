"""Keys and references of many tables in one pass, against one check at a time."""

from tidemark.operators.checks import Key, Reference, key_checks, reference_checks
from tidemark.plans import warehouse_checks as W


def found(df):
    return {r.check_name: r.violations for r in df.collect()}


def test_repeated_keys_of_all_tables(spark):
    tables = {
        "a": spark.sql("SELECT * FROM VALUES (1, 'x', 1), (1, 'x', 2), (2, 'y', 2), (NULL, 'y', 2), (NULL, 'z', 3) AS t(id, name, n)"),
        "b": spark.sql("SELECT * FROM VALUES (1L, timestamp_ntz'2026-01-01 00:00:00.000001'), "
                       "(1L, timestamp_ntz'2026-01-01 00:00:00.000002'), (2L, NULL), (2L, NULL) AS t(id, since)"),
    }
    keys = [Key("a id", "a", ("id",)), Key("a name", "a", ("name",)), Key("a both", "a", ("name", "n")),
            Key("b id", "b", ("id",)), Key("b version", "b", ("id", "since"))]
    assert found(key_checks(tables, keys)) == {"a id": 1, "a name": 2, "a both": 1, "b id": 2, "b version": 0}


def test_parts_of_a_key_do_not_run_together(spark):
    df = spark.sql("SELECT * FROM VALUES ('a', 'b,c'), ('a,b', 'c'), ('', 'x'), (NULL, 'x'), (NULL, 'x') AS t(p, q)")
    assert found(key_checks({"t": df}, [Key("k", "t", ("p", "q"))])) == {"k": 0}


def test_instants_of_the_autumn_hour_are_two(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        df = spark.sql("SELECT timestamp_seconds(s) AS at FROM VALUES (1793511000), (1793514600) AS t(s)")
        assert df.selectExpr("count(DISTINCT string(at))").first()[0] == 1
        assert found(key_checks({"t": df}, [Key("k", "t", ("at",))])) == {"k": 0}
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_references_count_rows_and_skip_nulls(spark):
    tables = {
        "parent": spark.sql("SELECT * FROM VALUES (1L, 'p'), (2L, 'q'), (NULL, NULL) AS t(id, code)"),
        "child": spark.sql("SELECT * FROM VALUES (1, 'p', 2), (9, 'z', 2), (9, NULL, 1), (NULL, 'q', NULL) AS t(a, b, id)"),
    }
    references = [Reference("a", "child", "a", "parent", "id"), Reference("b", "child", "b", "parent", "code"),
                  Reference("id", "child", "id", "parent", "id"), Reference("self", "parent", "id", "child", "id")]
    assert found(reference_checks(tables, references)) == {"a": 2, "b": 1, "id": 0, "self": 0}


def test_numbers_meet_texts_as_text(spark):
    tables = {"orders": spark.sql("SELECT * FROM VALUES ('1'), ('n/a') AS t(order_id)"),
              "payments": spark.sql("SELECT * FROM VALUES (1L), (2L), (2L) AS t(order_id)")}
    assert found(W.source_foreign_keys(tables)) == {"payments.order_id": 2}


def test_empty_tables_give_zero_for_every_check(spark):
    nothing = spark.createDataFrame([], "id bigint, parent_id bigint")
    tables = {"t": nothing, "p": nothing}
    assert found(key_checks(tables, [Key("k", "t", ("id",)), Key("l", "p", ("id", "parent_id"))])) == {"k": 0, "l": 0}
    assert found(reference_checks(tables, [Reference("r", "t", "parent_id", "p", "id")])) == {"r": 0}


def test_a_hot_reference_is_one_row_a_task(spark, tmp_path):
    spark.range(0, 60_000, 1, 4).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 7 ELSE id + 50000 END AS parent_id").write.parquet(f"{tmp_path}/t")
    spark.range(60_000).write.parquet(f"{tmp_path}/p")
    tables = {n: spark.read.parquet(f"{tmp_path}/{n}") for n in "tp"}
    df = reference_checks(tables, [Reference("r", "t", "parent_id", "p", "id"), Reference("s", "t", "id", "p", "id")])
    lost = sum(i % 3 > 0 and i + 50_000 >= 60_000 for i in range(60_000))
    assert found(df) == {"r": lost, "s": 0}
    plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    # one scan a table, no join, one exchange of pre-aggregated values
    assert plan.count("FileScan parquet") == 2 and "Join" not in plan and plan.count("Exchange hashpartitioning") == 1


def test_identifiers(spark):
    tables = {"dim_customer": spark.sql("SELECT * FROM VALUES (0), (-1), (NULL) AS t(customer_id)"),
              "dim_menu_item": spark.sql("SELECT * FROM VALUES ('', 1), (' ', -1), (NULL, NULL) AS t(menu_item_id, restaurant_id)")}
    assert found(W.identifiers(tables)) == {
        "dim_customer identifier": 1, "dim_menu_item identifier": 1, "dim_menu_item restaurant": 1}
