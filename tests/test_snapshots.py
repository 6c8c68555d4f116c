import threading
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tests.test_jobs import book, sources, stamp, table, warehouse  # noqa: F401
from tidemark.plans import jobs
from tidemark.sources.snapshots import Change, ConcurrentUpdate, NumberedFiles, SnapshotTable, reserve_range

SCHEMA = "k bigint, v string, part int"


def rows(spark, *values):
    return spark.createDataFrame(list(values), SCHEMA)


def state(t):
    return sorted(map(tuple, t.read("rows", SCHEMA).collect()))


@pytest.fixture
def snapshots(spark, tmp_path):
    return SnapshotTable(spark, str(tmp_path / "t"))


def test_commits_replace_append_and_drop_partitions(spark, snapshots):
    assert state(snapshots) == []
    first = snapshots.commit(snapshots.manifest(), {"rows": Change(rows(spark, (1, "a", 1), (2, "b", 2)), ["part"])})
    snapshots.commit(first, {"rows": Change(rows(spark, (3, "c", 2), (4, "d", 3)), ["part"], replaced=frozenset(["part=1", "part=3"]))})
    assert state(snapshots) == [(2, "b", 2), (3, "c", 2), (4, "d", 3)]
    assert sorted(map(tuple, snapshots.read("rows", SCHEMA, at=first).collect())) == [(1, "a", 1), (2, "b", 2)]
    assert snapshots.read("rows", SCHEMA, ["part=2", "part=9"]).count() == 2
    snapshots.commit(snapshots.manifest(), {"rows": Change(None, ["part"], replaced=frozenset(["part=2"]))})
    assert state(snapshots) == [(4, "d", 3)]


def test_a_writer_that_stops_before_publishing_changes_nothing(spark, snapshots, monkeypatch):
    base = snapshots.commit(snapshots.manifest(), {"rows": Change(rows(spark, (1, "a", 1)), ["part"])})
    monkeypatch.setattr(NumberedFiles, "create", lambda *_: (_ for _ in ()).throw(OSError("gone")))
    with pytest.raises(OSError):
        snapshots.commit(base, {"rows": Change(rows(spark, (1, "z", 2)), ["part"], replaced=frozenset(["part=1"]))})
    monkeypatch.undo()
    assert state(snapshots) == [(1, "a", 1)]
    assert snapshots.vacuum(older_than_seconds=-60) and state(snapshots) == [(1, "a", 1)]
    assert snapshots.vacuum(older_than_seconds=-60) == []


def test_writers_of_different_partitions_both_publish(spark, snapshots):
    base = snapshots.commit(snapshots.manifest(), {"rows": Change(rows(spark, (1, "a", 1), (2, "b", 2)), ["part"])})
    snapshots.commit(base, {"rows": Change(rows(spark, (1, "x", 1)), ["part"], replaced=frozenset(["part=1"]))})
    snapshots.commit(base, {"rows": Change(rows(spark, (2, "y", 2)), ["part"], replaced=frozenset(["part=2"]))})
    assert state(snapshots) == [(1, "x", 1), (2, "y", 2)]
    for change in (Change(rows(spark, (1, "z", 1)), ["part"], replaced=frozenset(["part=1"])),
                   Change(rows(spark, (9, "z", 3)), ["part"], seen=None)):
        with pytest.raises(ConcurrentUpdate):
            snapshots.commit(base, {"rows": change})
    assert state(snapshots) == [(1, "x", 1), (2, "y", 2)]


def test_two_writers_reserve_a_thousand_ranges_apart(spark, tmp_path):
    files, got = NumberedFiles(spark, str(tmp_path / "ranges")), []

    def take(seed):
        mine = [(reserve_range(files, 1 + (i + seed) % 3), 1 + (i + seed) % 3) for i in range(500)]
        got.extend(mine)

    threads = [threading.Thread(target=take, args=(s,)) for s in (0, 1)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    spans = sorted((last + 1, last + n) for last, n in got)
    assert len(spans) == 1000 and all(a[1] + 1 == b[0] for a, b in zip(spans, spans[1:])) and spans[0][0] == 1
    assert len(files.numbers()) <= 40


def orders(spark, *changes):
    made = [(str(i), "1", "1", "Road", "delivered", "20", "0", "5", "25", day, day, at) for i, day, at in changes]
    return table(spark, "orders", *made)


def load(spark, warehouse, book, rows, src):
    return jobs.run_entity(warehouse, book, "order", jobs.as_feed("order", rows), src)


def test_a_small_batch_touches_a_small_part_of_the_fact(spark, tmp_path, book, monkeypatch):
    from tidemark.sources.warehouse import Warehouse

    wide = Warehouse(spark, str(tmp_path / "wide"), buckets=8)
    ledger = type(book)(wide, book._clock)
    src = sources(spark)
    first = [(i, f"2026-0{1 + i % 3}-05", stamp(8)) for i in range(1, 121)]
    load(spark, wide, ledger, orders(spark, *first), src)
    before = {r.order_id: r for r in jobs.read_fact(wide, "order").collect()}
    fact = wide.table("fact_order")
    held = fact.manifest()
    assert len(before) == 120 and len(held.cells("rows")) == 24
    read = []
    folders = SnapshotTable.folders
    monkeypatch.setattr(SnapshotTable, "folders", lambda self, area, cells=None, at=None: (
        read.append((area, got)) if self.root.endswith("fact_order") else None, got)[1]
        if (got := folders(self, area, cells, at)) is not None else None)
    load(spark, wide, ledger, orders(spark, (7, "2026-03-09", stamp(20))), src)
    monkeypatch.undo()
    # one bucket of the index, one month and bucket of the fact
    assert sorted((area, len(got)) for area, got in read if got) == [("index", 1), ("rows", 1)]
    now = fact.manifest()
    changed = [c for c in {*held.cells("rows"), *now.cells("rows")} if held.cells("rows").get(c) != now.cells("rows").get(c)]
    assert len(changed) == 2
    after = {r.order_id: r for r in jobs.read_fact(wide, "order").collect()}
    assert len(after) == 120 and jobs.read_fact(wide, "order").count() == 120
    assert after[7].event_month == 202603 and after[7].order_key == before[7].order_key
    assert {i: r for i, r in after.items() if i != 7} == {i: r for i, r in before.items() if i != 7}


def test_new_rows_alone_are_numbered_without_a_join(spark, warehouse, book, monkeypatch):  # noqa: F811
    plans, number = [], jobs.assign_keys
    monkeypatch.setattr(jobs, "assign_keys", lambda rows, key, *a, **k: (
        plans.append((key, rows._jdf.queryExecution().optimizedPlan().toString())), number(rows, key, *a, **k))[1])
    src = sources(spark)
    load(spark, warehouse, book, orders(spark, (1, "2026-01-05", stamp(1)), (2, "2026-02-05", stamp(1))), src)
    load(spark, warehouse, book, orders(spark, (3, "2026-01-06", stamp(2))), src)
    facts = [plan for key, plan in plans if key == "order_key"]
    assert len(facts) == 2 and not any("Join" in plan for plan in facts)
    load(spark, warehouse, book, orders(spark, (1, "2026-01-07", stamp(3)), (4, "2026-01-07", stamp(3))), src)
    assert sorted(r.order_id for r in jobs.read_fact(warehouse, "order").collect()) == [1, 2, 3, 4]
    assert len({r.order_key for r in jobs.read_fact(warehouse, "order").collect()}) == 4


def test_index_and_cells_are_packed_after_many_commits(spark, warehouse, book, monkeypatch):  # noqa: F811
    monkeypatch.setattr(jobs, "MOST_COMMITS", 2)
    src, fact = sources(spark), warehouse.table("fact_order")
    for n in range(1, 5):
        load(spark, warehouse, book, orders(spark, (n, "2026-01-05", stamp(n)), *([(1, "2026-01-05", stamp(n, 1))] if n > 1 else [])), src)
    got = sorted((r.order_id, r.source_updated_at) for r in jobs.read_fact(warehouse, "order").collect())
    assert got == [(1, datetime(2026, 3, 4, 1)), *((n, datetime(2026, 3, n)) for n in (2, 3, 4))]
    assert max(map(len, fact.manifest().cells("index").values())) <= 2


def test_a_batch_does_not_rewrite_history(spark, warehouse, book):  # noqa: F811
    def customer(city, day):
        rows = table(spark, "customers", ("1", "Ann", "a@x", "1", city, "2026-01-01", stamp(day)))
        jobs.run_entity(warehouse, book, "customer", jobs.as_feed("customer", rows), {})

    closed = []
    for day, city in enumerate(("one", "two", "three", "four"), 1):
        customer(city, day)
        closed.append({c: x for c, x in warehouse.table("dim_customer").manifest().cells("closed").items()})
    (cell, commits), = closed[-1].items()
    assert len(commits) == 3 and all(commits[:len(c.get(cell, ()))] == c.get(cell, ()) for c in closed)
    versions = jobs.read_dimension(warehouse, "customer").orderBy("valid_from").collect()
    assert [v.city for v in versions] == ["One", "Two", "Three", "Four"] and [v.is_current for v in versions] == [False] * 3 + [True]
    assert all(a.valid_to == b.valid_from for a, b in zip(versions, versions[1:]))


def test_a_dimension_merge_that_stops_leaves_the_old_state(spark, warehouse, book, monkeypatch):  # noqa: F811
    def change(city, day):
        rows = table(spark, "customers", ("1", "Ann", "a@x", "1", city, "2026-01-01", stamp(day)))
        return jobs.run_entity(warehouse, book, "customer", jobs.as_feed("customer", rows), {})

    change("one", 1)
    before = jobs.read_dimension(warehouse, "customer").collect()
    create = NumberedFiles.create
    monkeypatch.setattr(NumberedFiles, "create", lambda self, *a: (_ for _ in ()).throw(OSError("gone"))
                        if self.folder.endswith("manifests") else create(self, *a))
    with pytest.raises(OSError):
        change("two", 2)
    monkeypatch.undo()
    assert jobs.read_dimension(warehouse, "customer").collect() == before
    assert change("two", 2)["loaded_row_count"] == 1 and jobs.read_dimension(warehouse, "customer").count() == 2
