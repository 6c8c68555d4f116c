import random
from datetime import datetime, timedelta

from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from tidemark.operators import temporal as T
from tidemark.operators.surrogate import assign_keys, highest_key

VERSIONS = "cid bigint; ckey bigint; valid_from timestamp_ntz; valid_to timestamp_ntz"
EVENTS = "eid bigint; cid bigint; at timestamp_ntz"
DAY = datetime(2026, 1, 1)


def day(n):
    return None if n is None else str(DAY + timedelta(days=n))


def brute_force(events, versions):
    """All (event, key) matches by the interval definition."""
    found = {}
    for eid, cid, at in events:
        found[eid] = [
            k for i, k, f, t in versions
            if cid is not None and i == cid and at is not None and at >= f and (t is None or at < t)
        ]
    return found


def test_half_open_intervals(frame):
    versions = frame(VERSIONS, (1, 10, day(0), day(5)), (1, 11, day(5), None))
    events = frame(EVENTS, (1, 1, day(5)), (2, 1, day(4)), (3, 1, day(-1)), (4, 2, day(3)),
                   (5, None, day(3)), (6, 1, None))
    lookup = T.VersionLookup(versions, "cid", "ckey")
    expected = {1: 11, 2: 10, 3: 0, 4: 0, 5: 0, 6: 0}
    assert {r.eid: r.ckey for r in T.as_of_lookup(events, lookup, "at").collect()} == expected


def test_hot_identifier_with_empty_and_inverted_versions(frame):
    """One identifier owns a third of events and versions; versions that cover no time match nothing."""
    rng = random.Random(7)
    versions, key = [], 0
    for cid, count in [(1, 60), *((c, 2) for c in range(2, 62))]:
        starts = sorted(rng.sample(range(400), count))
        for start, end in zip(starts, [*starts[1:], None], strict=True):
            key += 1
            gap = end is not None and rng.random() < 0.2 and end - start > 1
            versions.append((cid, key, day(start), day(end - 1 if gap else end)))
            if rng.random() < 0.2:
                key += 1
                versions.append((cid, key, day(start), day(start - rng.randrange(3))))
    events = [(n, 1 if n % 3 == 0 else rng.randrange(1, 70), day(rng.randrange(-5, 420)))
              for n in range(600)]
    expected = {e: (m or [0])[0] for e, m in brute_force(events, versions).items()}
    lookup = T.VersionLookup(frame(VERSIONS, *versions), "cid", "ckey")
    frame_events = frame(EVENTS, *events)
    assert {r.eid: r.ckey for r in T.as_of_lookup(frame_events, lookup, "at").collect()} == expected


def test_daylight_saving_of_the_session_does_not_matter(spark, frame):
    versions = frame(VERSIONS, (1, 10, "2026-03-08 02:30:00", "2026-03-08 03:05:00"),
                     (1, 11, "2026-03-08 03:05:00", None))
    events = frame(EVENTS, (1, 1, "2026-03-08 02:40:00"), (2, 1, "2026-03-08 03:04:00"),
                   (3, 1, "2026-03-08 03:05:00"), (4, 1, "2026-03-08 02:29:59"))
    lookup = T.VersionLookup(versions, "cid", "ckey")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        resolved = T.as_of_lookup(events, lookup, "at")
        assert {r.eid: r.ckey for r in resolved.collect()} == {1: 10, 2: 10, 3: 11, 4: 0}
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


intervals = st.lists(
    st.tuples(st.integers(1, 3), st.integers(0, 12), st.one_of(st.none(), st.integers(-1, 6))),
    min_size=1, max_size=10)


@settings(max_examples=6, deadline=None)
@given(intervals, st.lists(st.tuples(st.integers(1, 3), st.integers(-1, 20)), min_size=1, max_size=8))
def test_ambiguity_matches_its_definition(frame, spans, moments):
    versions = [(c, n, day(f), day(None if w is None else f + w)) for n, (c, f, w) in enumerate(spans)]
    events = [(n, c, day(d)) for n, (c, d) in enumerate(moments)]
    lookup = T.VersionLookup(frame(VERSIONS, *versions), "cid", "ckey")
    expected = {e for e, m in brute_force(events, versions).items() if len(m) > 1}
    flagged = T.ambiguous_events(frame(EVENTS, *events), "eid", "at", [lookup])
    assert {r.eid for r in flagged.collect()} == expected
    found = {r.cid for r in T.version_overlaps(lookup.dimension, "cid").collect()}
    assert {events[e][1] for e in expected} <= found


def test_repeated_codes_are_ambiguous(frame):
    codes = frame("code string; k int", ("A", 1), ("A", 2), ("B", 3))
    events = frame("eid bigint; code string", (1, "A"), (2, "B"))
    lookup = T.CodeLookup(codes, "code", "code", "k", "code_key")
    assert [r.eid for r in T.ambiguous_events(events, "eid", "at", [], [lookup]).collect()] == [1]


def test_code_lookup_defaults_to_unknown(frame):
    codes = frame("c string; k int", ("A", 1))
    events = frame("eid bigint; code string", (1, "A"), (2, "Z"), (3, None))
    resolved = T.resolve_keys(events, "at", [], [T.CodeLookup(codes, "code", "c", "k", "code_key")])
    assert {r.eid: r.code_key for r in resolved.collect()} == {1: 1, 2: 0, 3: 0}


def test_keys_are_dense_and_repeatable(spark):
    rows = spark.range(5_000).selectExpr("CASE WHEN id % 3 = 0 THEN 7 ELSE id END AS cid", "id AS v")
    first = assign_keys(rows, "k", ["cid", "v"], after=100, digits=2)
    keys = {(r.cid, r.v): r.k for r in first.collect()}
    assert sorted(keys.values()) == list(range(101, 5_101))
    again = assign_keys(rows.repartition(7), "k", ["cid", "v"], after=100, digits=2)
    assert {(r.cid, r.v): r.k for r in again.collect()} == keys
    assert highest_key(first, "k") == 5_100
    assert highest_key(first.filter("k < 0"), "k") == 0


def _spans(spark, *versions):
    return spark.createDataFrame(list(versions), "id bigint, k bigint, f string, t string").select(
        "id", "k", F.col("f").cast("timestamp_ntz").alias("valid_from"), F.col("t").cast("timestamp_ntz").alias("valid_to"))


def test_time_cells_equal_the_plain_join(spark):
    import random
    from datetime import timedelta

    rng, start = random.Random(4), datetime(1960, 1, 1)

    def moment():
        return start + timedelta(seconds=rng.choice([60, 5000, 10**6, 3 * 10**9]) * rng.random(), microseconds=rng.randrange(3))

    versions = []
    for k in range(1, 400):
        a, length = moment(), rng.choice([0, -5, 1, 63, 64, 1024, 10**5, 10**9])
        b = None if k % 13 == 0 else a + timedelta(seconds=length)
        versions += [(k % 7, k, str(a), str(b) if b else None)]
        if b and k % 3 == 0:  # touching
            versions.append((k % 7, 1000 + k, str(b), str(b + timedelta(seconds=rng.randrange(1, 900)))))
    dimension = _spans(spark, *versions)
    at = [v[i] for v in versions for i in (2, 3) if v[i]] + [str(moment()) for _ in range(200)]
    events = spark.createDataFrame(
        [(n, rng.choice([0, 1, 2, 3, 4, 5, 6, 99, None]), t) for n, t in enumerate([*at, None, at[0], at[0]])],
        "event bigint, id bigint, at string").withColumn("at", F.col("at").cast("timestamp_ntz"))
    plain, cells = (sorted(map(str, T.as_of_lookup(events, T.VersionLookup(dimension, "id", "k", busy=b), "at").collect()))
                    for b in (False, True))
    assert cells == plain and len(plain) >= events.count()


def test_a_busy_identifier_meets_few_versions_per_event(spark):
    """100,000 versions and 100,000 events of one identifier: the rows that meet grow with the events."""
    n = 100_000
    ids = spark.range(n).withColumn("gap", F.pmod(F.xxhash64("id"), F.lit(5)))
    second = F.col("id") * 100 + F.when(F.col("gap") == 0, 90).otherwise(F.col("gap"))
    moment = lambda s: F.expr("timestamp_ntz '2020-01-01'") + F.make_dt_interval(secs=s.cast("decimal(18,6)"))
    dimension = ids.select(F.lit(1).alias("who"), F.col("id").alias("k"), moment(second).alias("valid_from"),
                           moment(second + 60).alias("valid_to"))
    events = ids.select(F.lit(1).alias("who"), F.col("id").alias("event"), moment(F.col("id") * 97 + 13).alias("at"))
    out = T.as_of_lookup(events, T.VersionLookup(dimension, "who", "k", busy=True), "at")
    assert out.count() >= n
    versions = T.VersionLookup(dimension, "who", "k").versions().select(
        F.col("who").alias("_id"), F.col("valid_from").alias("_from"), F.col("valid_to").alias("_to"), F.col("k").alias("_key"))
    unbounded = T.covers
    try:
        T.covers = lambda *_: F.lit(True)  # every pair that shares a cell
        met = T._matches_in_cells(events, versions, "who", "at").count()
    finally:
        T.covers = unbounded
    assert met < 40 * n
