from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.functions import columns as C
from tidemark.operators import checks, scd2, seeds, upsert
from tidemark.operators.temporal import version_overlaps
from tidemark.plans import warehouse_checks as W

DIM = ("customer_id bigint; phone string; valid_from timestamp_ntz; valid_to timestamp_ntz; "
       "is_current boolean; hash_diff string; source_updated_at timestamp_ntz; batch_id string")
STAGED = ("customer_id bigint; phone string; valid_from timestamp_ntz; hash_diff string; "
          "source_updated_at timestamp_ntz; batch_id string")


def stamp(n):
    return f"2026-01-{n:02d} 00:00:00"


def rows(df):
    return sorted((tuple(r) for r in df.select(
        "customer_id", "phone", "valid_from", "valid_to", "is_current", "source_updated_at",
        "batch_id").collect()), key=str)


def dim(frame, *entries):
    return frame(DIM, *[(i, p, stamp(f), stamp(t) if t else None, t is None, "h" + p, stamp(u), b)
                        for i, p, f, t, u, b in entries])


def staged(frame, *entries):
    return frame(STAGED, *[(i, p, stamp(f), "h" + p, stamp(u), b) for i, p, f, u, b in entries])


def test_new_identifier(frame):
    out = scd2.scd2_apply(dim(frame), staged(frame, (1, "a", 2, 5, "b1")), "customer_id").collect()
    assert [(r.valid_from.day, r.valid_to, r.is_current) for r in out] == [(2, None, True)]


def test_change_closes_and_opens(frame):
    old = dim(frame, (1, "a", 1, None, 3, "b1"), (2, "z", 1, None, 3, "b1"))
    batch = staged(frame, (1, "b", 1, 7, "b2"))
    closed = scd2.scd2_closes(old, batch, "customer_id").collect()
    assert [(r.phone, r.valid_to.day, r.is_current, r.batch_id) for r in closed] == [("a", 7, False, "b1")]
    fresh = scd2.scd2_inserts(old, batch, "customer_id").collect()
    assert [(r.phone, r.valid_from.day, r.is_current) for r in fresh] == [("b", 7, True)]
    assert scd2.scd2_apply(old, batch, "customer_id").count() == 3


def test_nothing_changes(frame):
    old = dim(frame, (1, "a", 1, None, 5, "b1"))
    for batch in ((1, "b", 1, 4, "b2"), (1, "b", 1, 5, "b2"), (1, "a", 1, 9, "b2")):
        assert rows(scd2.scd2_apply(old, staged(frame, batch), "customer_id")) == rows(old)


def test_update_must_follow_the_version_start(frame):
    old = dim(frame, (1, "a", 8, None, 3, "b1"))
    assert rows(scd2.scd2_apply(old, staged(frame, (1, "b", 8, 6, "b2")), "customer_id")) == rows(old)


def test_identifier_with_only_ended_versions(frame):
    old = dim(frame, (1, "a", 1, 4, 2, "b1"))
    fresh = scd2.scd2_inserts(old, staged(frame, (1, "b", 1, 7, "b2")), "customer_id").collect()
    assert [(r.valid_from.day, r.is_current) for r in fresh] == [(7, True)]


batches = st.lists(
    st.dictionaries(st.integers(1, 4), st.tuples(st.sampled_from("abc"), st.integers(2, 20)),
                    min_size=1, max_size=4), min_size=1, max_size=3)


@settings(max_examples=4, deadline=None)
@given(batches)
def test_invariants_hold_after_any_batches(frame, spark, history):
    state = dim(frame)
    for n, batch in enumerate(history):
        delivered = staged(frame, *[(i, p, 1, u, f"b{n}") for i, (p, u) in batch.items()])
        state = spark.createDataFrame(
            scd2.scd2_apply(state, delivered, "customer_id").select(state.columns).collect(),
            state.schema)
        again = scd2.scd2_apply(state, delivered, "customer_id")
        assert rows(again) == rows(state)
    assert version_overlaps(state, "customer_id").isEmpty()
    tables = {"dim_customer": state.selectExpr("*", "customer_id AS customer_key")}
    assert [r.violations for r in W.one_current(tables).collect()] == [0]
    periods = {r.check_name: r.violations for r in W.valid_period(tables).collect()}
    assert periods["dim_customer valid period"] == 0


def test_shared_values(frame):
    held = dim(frame, (5, "P-1", 1, None, 3, "b1"), (6, "Q", 1, 2, 3, "b1"), (7, "R", 1, None, 3, "b1"))
    batch = staged(frame, (1, " p-1 ", 1, 3, "b2"), (2, "x", 1, 3, "b2"), (3, " X", 1, 3, "b2"),
                   (4, "q", 1, 3, "b2"), (7, "r", 1, 3, "b2"))
    found = scd2.uniqueness_conflicts(batch, held, "customer_id", C.code_text("phone"))
    assert {tuple(r) for r in found.collect()} == {("X", "batch"), ("P-1", "current")}


FACT = "fk bigint; oid bigint; ck bigint; status string; source_updated_at timestamp_ntz"


def fact(frame, *entries):
    return frame(FACT, *[(k, o, c, s, stamp(u)) for k, o, c, s, u in entries])


def test_newer_wins(frame):
    old = fact(frame, (1, 1, 9, "old", 5), (2, 2, 9, "old", 5), (3, 3, 9, "old", 5), (4, 4, 0, "old", 5),
               (5, 5, 9, "old", 5))
    new = fact(frame, (None, 1, 9, "new", 6), (None, 2, 9, "new", 5), (None, 3, 8, "new", 4),
               (None, 4, 9, "new", 5), (None, 6, 9, "new", 1)).drop("fk")
    out = {r.oid: (r.fk, r.ck, r.status) for r in upsert.fact_upsert(old, new, "oid", ["ck"], "fk").collect()}
    assert out == {1: (1, 9, "new"), 2: (2, 9, "old"), 3: (3, 9, "old"), 4: (4, 9, "new"),
                   5: (5, 9, "old"), 6: (None, 9, "new")}
    twice = upsert.fact_upsert(
        upsert.fact_upsert(old, new, "oid", ["ck"], "fk"), new, "oid", ["ck"], "fk")
    assert {r.oid: (r.fk, r.ck, r.status) for r in twice.collect()} == out


def test_a_row_left_twice_by_an_interrupted_write_becomes_one(frame):
    old = fact(frame, (1, 1, 9, "stale", 4), (1, 1, 9, "new", 6))
    new = fact(frame, (None, 1, 9, "new", 6)).drop("fk")
    out = upsert.fact_upsert(old, new, "oid", ["ck"], "fk").collect()
    assert [(r.fk, r.status) for r in out] == [(1, "new")]


def test_seeding_twice(frame):
    dimension = dim(frame, (1, "a", 1, None, 3, "b1")).selectExpr(
        "customer_id AS customer_key", "*", "'n' AS full_name", "'e' AS email", "'c' AS city")
    member = seeds.unknown_member(dimension, "customer")
    once = seeds.insert_if_absent(dimension, member, ["customer_key"])
    twice = seeds.insert_if_absent(once, member, ["customer_key"])
    assert once.count() == twice.count() == 2
    row = twice.filter("customer_key = 0").first()
    assert (row.customer_id, row.email, row.hash_diff, row.valid_from.year) == (
        0, "unknown@invalid", "0" * 64, 1900)


def test_generic_checks(frame, spark):
    df = frame("k int; v string", (1, "a"), (1, "b"), (2, "b"), (None, "c"), (3, None))
    parents = frame("p int", (1,))

    def count(check):
        return check.first().violations

    assert count(checks.repeated_keys(df, ["k"], "n")) == 1
    assert count(checks.shared_values(df, df.v, "k", "n")) == 1
    assert count(checks.missing_references(df, "k", parents, "p", "n")) == 2
    assert count(checks.total_rows([df, parents], "n")) == 6
    found = {r.check_name: r.violations for r in checks.row_checks(
        df, {"a.b": df.v.isNull(), "small": df.k < 2}).collect()}
    assert found == {"a.b": 1, "small": 2}
    nothing = df.filter("false")
    assert count(checks.missing_references(nothing, "k", parents, "p", "n")) == 0
