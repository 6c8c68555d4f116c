"""Batch jobs: one entity from its source window to its warehouse table.

watermark -> window -> clean and judge -> count -> open batch -> quarantine and
stage -> guard -> merge -> purge staging -> close batch. The closing ledger row is
the commit: an unfinished batch does not move the resume point, and because
merges only accept newer rows, running it again repairs what it left behind.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from datetime import datetime, timedelta
from functools import reduce

from uuid import uuid4

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.operators.ledger import BOOTSTRAP_BATCH, SUCCEEDED, Ledger
from tidemark.operators.lookup import rows_of_keys
from tidemark.operators.rules import rejected_rows, row_counts
from tidemark.operators.scd2 import (
    scd2_closes,
    scd2_inserts,
    uniqueness_conflicts,
)
from tidemark.operators.seeds import (
    dim_date,
    dim_payment_method,
    unknown_member,
)
from tidemark.operators.surrogate import assign_keys
from tidemark.operators.temporal import ambiguous_events
from tidemark.operators.upsert import fact_hits
from tidemark.plans import contracts
from tidemark.plans import entities as E
from tidemark.plans import warehouse_checks
from tidemark.plans.facts import (
    DIMENSIONS,
    FACTS,
    Dimension,
    Fact,
    code_lookups,
    resolve_fact,
    version_lookups,
)
from tidemark.session import cut_lineage
from tidemark.sources.snapshots import Change, Manifest, SnapshotTable
from tidemark.sources.warehouse import Warehouse, stage_projection
from tidemark.sources.windows import (
    document_watermark,
    document_window,
    high_watermark,
    incremental_window,
    lookback_window,
    watermark_value,
)

Sources = Mapping[str, DataFrame]


@dataclass(frozen=True)
class Feed:
    """A source frame and the column its windows follow."""

    rows: DataFrame = field(repr=False)
    column: str = "updated_at"
    document: bool = False

    @property
    def ledger_prefix(self) -> str:
        return "mongo_watermark" if self.document else "mysql_watermark"

    def upper(self) -> datetime | None:
        probe = document_watermark if self.document else high_watermark
        return watermark_value(probe(self.rows, self.column))

    def window(self, lower: datetime, upper: datetime | None, lookback: timedelta) -> DataFrame:
        if self.document:
            return document_window(self.rows, self.column, lower - lookback, upper)
        if lookback:
            return lookback_window(self.rows, self.column, lower, upper, lookback)
        return incremental_window(self.rows, self.column, lower, upper)


# Source table of each pipeline, and how its changes are judged. Lookups are full
# reads: a changed line still needs its unchanged order.
SOURCE_OF = {
    "customer": "customers", "restaurant": "restaurants", "driver": "drivers",
    "menu_item": "menu_items", "order": "orders", "order_item": "order_items",
    "payment": "payments", "delivery": "deliveries",
}
JUDGES: dict[str, Callable[[DataFrame, Sources], DataFrame]] = {
    "customer": lambda rows, src: E.check_customers(rows),
    "restaurant": lambda rows, src: E.check_restaurants(rows),
    "driver": lambda rows, src: E.check_drivers(rows),
    "menu_item": lambda rows, src: E.check_menu_items(rows, src["restaurants"]),
    "order": lambda rows, src: E.check_orders(rows),
    "order_item": lambda rows, src: E.check_order_items(rows, src["orders"], src["menu_items"]),
    "payment": lambda rows, src: E.check_payments(rows, src["orders"]),
    "delivery": lambda rows, src: E.check_deliveries(rows, src["orders"]),
}

# (source table, its key, the key's name in the changed rows, cleaning of both).
LOOKUPS = {
    "menu_item": [("restaurants", "restaurant_id", "restaurantId", C.to_long)],
    "order_item": [("orders", "order_id", "order_id", C.to_long),
                   ("menu_items", "_id", "menu_item_id", C.trimmed)],
    "payment": [("orders", "order_id", "order_id", C.to_long)],
    "delivery": [("orders", "order_id", "order_id", C.to_long)],
}


def narrowed(sources: Sources, pipeline: str, changes: DataFrame) -> Sources:
    """The sources with each lookup cut to what the batch refers to."""
    lookups = LOOKUPS.get(pipeline, [])
    if not lookups:
        return sources
    return {
        name: rows_of_keys(sources[name], clean(key), changes, clean(reference))
        for name, key, reference, clean in lookups
    }


def as_feed(pipeline: str, rows: DataFrame) -> Feed:
    if pipeline == "menu_item":
        return Feed(rows, "updatedAt", document=True)
    return Feed(rows)


# --- reading the warehouse -------------------------------------------------


def read_dimension(warehouse: Warehouse, name: str, at: Manifest | None = None) -> DataFrame:
    """All versions of one state of a dimension: the current ones and the closed ones."""
    dimension = DIMENSIONS[name]
    table, schema = warehouse.table(dimension.table), contracts.dimension_schema(dimension)
    at = at or table.manifest()
    return table.read("open", schema, at=at).unionByName(table.read("closed", schema, at=at))


def read_fact(warehouse: Warehouse, name: str) -> DataFrame:
    fact = FACTS[name]
    return warehouse.table(fact.table).read("rows", contracts.fact_schema(fact))


def replace_dimension(warehouse: Warehouse, name: str, rows: DataFrame) -> None:
    """Make ``rows`` the whole dimension, in one step."""
    table = warehouse.table(DIMENSIONS[name].table)
    base = table.manifest()
    table.commit(base, {
        area: Change(rows.filter(part), ["bucket"], replaced=frozenset(base.cells(area)), seen=None)
        for area, part in (("open", F.col("is_current")), ("closed", ~F.col("is_current")))
    })


def read_staging(warehouse: Warehouse, name: str) -> DataFrame:
    return warehouse.read("staging", name, contracts.staging_schema(name))


def staging_rows(valid: DataFrame, name: str, batch_id: str) -> DataFrame:
    if "tags" in valid.columns:
        valid = valid.withColumn("tags_json", C.array_to_json("tags"))
    return stage_projection(valid, contracts.staged_columns(name), batch_id)


def _staged_batch(warehouse: Warehouse, name: str, batch_id: str) -> DataFrame:
    staged = read_staging(warehouse, name).filter(F.col("batch_id") == batch_id)
    if "tags_json" in staged.columns:
        staged = staged.withColumn("tags", C.json_to_array("tags_json")).drop("tags_json")
    return staged


def _moment(value: datetime):
    return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")


# --- merges ----------------------------------------------------------------


def merge_dimension(
    warehouse: Warehouse, dimension: Dimension, batch_id: str, loaded_at: datetime
) -> int:
    """Version the staged batch into the dimension; returns the versions inserted.

    Current versions lie apart from closed ones, both cut into buckets by identifier. Only current rows of
    buckets that change are rewritten; versions that end are appended to the closed ones, so history
    is never written again. Of the history only the narrow columns that tell whether an identifier had a version are
    read, in the buckets of arriving identifiers. Both parts are published together.
    """
    warehouse.check_layout()
    name, key = dimension.entity.name, dimension.identifier
    table, schema = warehouse.table(dimension.table), contracts.dimension_schema(dimension)
    base, fallback = table.manifest(), warehouse.checkpoint_fallback()
    staged = _staged_batch(warehouse, name, batch_id)
    if dimension.unique is not None:
        held = table.read("open", schema, at=base)
        if not uniqueness_conflicts(staged, held, key, dimension.unique()).isEmpty():
            raise RuntimeError(f"{name} batch repeats a value that must be unique")

    arriving = [f"bucket={row.bucket}" for row in staged.select(warehouse.bucket(key).alias("bucket")).distinct().collect()]
    current = table.read("open", schema, arriving, base)
    versions = current.unionByName(table.read("closed", schema, arriving, base))
    inserts = cut_lineage(
        scd2_inserts(versions, staged, key).withColumn("bucket", warehouse.bucket(key)), fallback)
    closes = cut_lineage(scd2_closes(current, staged, key), fallback)
    sizes = (
        inserts.select("bucket", F.lit(1).alias("inserted"), F.lit(0).alias("closed"))
        .unionByName(closes.select("bucket", F.lit(0).alias("inserted"), F.lit(1).alias("closed")))
        .groupBy("bucket")
        .agg(F.sum("inserted").alias("inserted"), F.sum("closed").alias("closed"))
        .collect()
    )
    inserted = sum(row.inserted for row in sizes)
    if sum(row.closed for row in sizes) > inserted:
        raise RuntimeError(f"{name} batch closes more versions than it inserts")
    if not sizes:
        return 0

    last = warehouse.reserve_keys(dimension.table, inserted)
    fresh = assign_keys(inserts, dimension.key, [key, "valid_from"], after=last).withColumn(
        "loaded_at", _moment(loaded_at)
    )
    changed = frozenset(f"bucket={row.bucket}" for row in sizes)
    kept = table.read("open", schema, changed, base).join(closes.select(dimension.key), dimension.key, "left_anti")
    table.commit(base, {
        "open": Change(kept.unionByName(fresh), ["bucket"], replaced=changed,
                       seen=None if dimension.unique is not None else frozenset(arriving)),
        "closed": Change(closes.select(*kept.columns), ["bucket"], seen=frozenset(arriving)),
    })
    return inserted


# Commits after which a partition is written again as one.
MOST_COMMITS = 8
# Identifiers of a batch up to which they are named to the scan, for its bloom filters and page ranges.
NAMED_IDS = 1000


def _indexed(table: SnapshotTable, fact: Fact, resolved: DataFrame, base: Manifest) -> DataFrame:
    """The newest index entry of each of the batch's identifiers that the fact holds.

    The index is cut by identifier like the batch, so only the buckets that the batch has are read. Its files are
    sorted by identifier and carry a bloom filter on it; a small batch names its identifiers to the scan.
    """
    key = fact.identifier
    buckets = [f"bucket={row.bucket}" for row in resolved.select("bucket").distinct().collect()]
    entries = table.read("index", contracts.index_schema(fact), buckets, base)
    named = resolved.select(key).limit(NAMED_IDS + 1).collect()
    if len(named) <= NAMED_IDS:
        entries = entries.filter(F.col(key).isin([row[0] for row in named]))
    else:
        entries = entries.join(resolved.select(key), key, "left_semi")
    payload = [c for c in entries.columns if c not in (key, "revision", "bucket")]
    return entries.groupBy(key).agg(F.max_by(F.struct(*payload), "revision").alias("_entry")).select(key, "_entry.*")


def merge_fact(warehouse: Warehouse, fact: Fact, batch_id: str, loaded_at: datetime) -> int:
    """Upsert the staged batch into the fact; returns the rows written.

    The fact is cut by month and by bucket of its identifier. An index, cut by the same buckets, tells in which month
    an identifier lies, how new it is and under which keys, so the fact itself is read only where a stored row
    goes, and only there written again; other rows are appended. Rows and index are published together.
    """
    warehouse.check_layout()
    pipeline = next(n for n, f in FACTS.items() if f is fact)
    staged = _staged_batch(warehouse, pipeline, batch_id)
    dimensions = {n: read_dimension(warehouse, n) for n in fact.dimensions}
    dates, methods = dim_date(warehouse.spark), dim_payment_method(warehouse.spark)
    versioned = version_lookups(fact, dimensions)
    codes = code_lookups(fact, dates, methods)
    ambiguous = ambiguous_events(staged, fact.identifier, fact.event_time, versioned, codes)
    if not ambiguous.isEmpty():
        raise RuntimeError(f"{pipeline} batch matches several versions of a dimension row")

    key, table = fact.identifier, warehouse.table(fact.table)
    base, scratch = table.manifest(), warehouse.path("merging", f"{pipeline}-{uuid4().hex}")
    try:
        return _merge_resolved(warehouse, fact, batch_id, loaded_at, base, scratch, resolve_fact(
            staged, fact, dimensions, dates, methods).withColumns({
                "event_month": F.floor(F.col(fact.partition_source) / 100).cast("int"), "bucket": warehouse.bucket(key)}))
    finally:
        warehouse.delete(scratch)


def _written(df: DataFrame, folder: str) -> DataFrame:
    """Evaluate once into columns below the warehouse, of which later steps read only those they need."""
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def _merge_resolved(
    warehouse: Warehouse, fact: Fact, batch_id: str, loaded_at: datetime, base: Manifest, scratch: str, resolved: DataFrame,
) -> int:
    """Upsert the resolved batch; whole rows move once to be numbered and once to their partitions."""
    key, table = fact.identifier, warehouse.table(fact.table)
    matches = F.col(key) == F.col("_id")
    resolved = _written(resolved, f"{scratch}/resolved")
    stored = _indexed(table, fact, resolved, base)
    hits = _written(
        fact_hits(stored, resolved, key, fact.key_columns(), [fact.key, "event_month"])
        .withColumnRenamed(key, "_id").withColumnRenamed("event_month", "_old_month"), f"{scratch}/hits")
    replaced = hits.filter("_overwrite").drop("_overwrite")
    updates = resolved.join(replaced, matches)
    # a batch of new rows alone, such as the first one, needs no join to tell them from updates
    met = not hits.isEmpty()
    inserts = resolved.join(hits.select("_id"), matches, "left_anti") if met else resolved

    one, none = F.lit(1), F.lit(0)
    parts = [inserts.select("event_month", "bucket", none.alias("lost"), one.alias("n"), one.alias("fresh"))]
    if met:
        parts += [updates.select(F.col("_old_month").alias("event_month"), "bucket", one.alias("lost"), none.alias("n"), none.alias("fresh")),
                  updates.select("event_month", "bucket", none.alias("lost"), one.alias("n"), none.alias("fresh"))]
    sizes = (
        reduce(DataFrame.unionByName, parts)
        .groupBy("event_month", "bucket")
        .agg(F.sum("lost").alias("lost"), F.sum("n").alias("n"), F.sum("fresh").alias("fresh"))
        .collect()
    )
    if not sizes:
        return 0
    cells = {f"event_month={r.event_month}/bucket={r.bucket}": r for r in sizes}
    full = {c for c in cells if len(base.cells("rows").get(c, ())) >= MOST_COMMITS}
    rewritten = frozenset(c for c, r in cells.items() if r.lost) | full
    last = warehouse.reserve_keys(fact.table, sum(r.fresh for r in sizes))
    numbered = assign_keys(inserts, fact.key, [key], after=last)
    loaded = numbered if not met else updates.drop("_id", "_old_month").unionByName(numbered)
    loaded = _written(loaded.withColumn("loaded_at", _moment(loaded_at)), f"{scratch}/loaded")
    rows = loaded.select(*contracts.fact_columns(fact), "event_month", "bucket")
    if rewritten:
        kept = table.read("rows", contracts.fact_schema(fact), rewritten, base).join(replaced.select("_id"), matches, "left_anti")
        rows = kept.unionByName(loaded.select(*kept.columns))

    entries = loaded.select(*contracts.index_columns(fact), "event_month", F.lit(base.version + 1).cast("long").alias("revision"), "bucket")
    buckets = {f"bucket={r.bucket}" for r in sizes}
    crowded = frozenset(c for c in buckets if len(base.cells("index").get(c, ())) >= MOST_COMMITS)
    if crowded:
        old = table.read("index", contracts.index_schema(fact), crowded, base)
        newer = loaded.select(F.col(key).alias("_id"))
        payload = [c for c in old.columns if c not in (key, "revision", "bucket")]
        packed = (old.join(newer, matches, "left_anti").groupBy(key, "bucket")
                  .agg(F.max_by(F.struct(*payload), "revision").alias("_entry"), F.max("revision").alias("revision"))
                  .select(key, "_entry.*", "revision", "bucket"))
        entries = packed.unionByName(entries)
    table.commit(base, {
        "rows": Change(rows, ["event_month", "bucket"], replaced=rewritten),
        "index": Change(entries, ["bucket"], replaced=crowded, seen=frozenset(buckets), sort=[key],
                        options={f"parquet.bloom.filter.enabled#{key}": "true"}),
    })
    return sum(r.n for r in sizes)


# --- jobs ------------------------------------------------------------------


def run_entity(
    warehouse: Warehouse, ledger: Ledger, pipeline: str, feed: Feed, sources: Sources,
    batch_id: str | None = None, lookback: timedelta = timedelta(0),
) -> dict:
    """Load one pipeline's next window. Returns the closing ledger row."""
    lower = ledger.resume_from(pipeline, f"{feed.ledger_prefix}_to")
    upper = feed.upper()
    changes = feed.window(lower, upper, lookback)
    # The judged rows feed the counts, the quarantine and the staging write. They are written once:
    # a source that moves meanwhile, or a lost executor, cannot make these three differ.
    judged = warehouse.path("judged", f"{pipeline}-{uuid4().hex}")
    JUDGES[pipeline](changes, narrowed(sources, pipeline, changes)).write.parquet(judged)
    checked = warehouse.spark.read.parquet(judged)
    try:
        counts = row_counts(checked).first()
        batch = ledger.start(
            pipeline, counts.input_rows, counts.rejected_rows, batch_id,
            **{f"{feed.ledger_prefix}_from": lower, f"{feed.ledger_prefix}_to": upper},
        )
        try:
            loaded = _load(warehouse, ledger, pipeline, checked, batch)
        except Exception as error:
            ledger.fail(batch, error)
            raise
        return ledger.complete(batch, loaded)
    finally:
        warehouse.delete(judged)


def _load(
    warehouse: Warehouse, ledger: Ledger, pipeline: str, checked: DataFrame, batch: dict
) -> int:
    batch_id = batch["batch_id"]
    target = DIMENSIONS.get(pipeline) or FACTS[pipeline]
    if batch["rejected_row_count"]:
        warehouse.replace_batch(
            rejected_rows(checked).withColumn("batch_id", F.lit(batch_id)), "quarantine", pipeline
        )
    valid = E.accept(checked, target.entity)
    warehouse.replace_batch(staging_rows(valid, pipeline, batch_id), "staging", pipeline)
    merge = merge_dimension if isinstance(target, Dimension) else merge_fact
    loaded = merge(warehouse, target, batch_id, ledger.now())
    warehouse.purge_batch("staging", pipeline, batch_id)
    return loaded


def bootstrap(warehouse: Warehouse, ledger: Ledger) -> None:
    """Seed the bootstrap batch and the unknown members; safe to run again."""
    warehouse.check_layout()
    if ledger.batches().filter(F.col("batch_id") == BOOTSTRAP_BATCH).isEmpty():
        ledger.record({
            "batch_id": BOOTSTRAP_BATCH, "pipeline_name": "bootstrap", "started_at": ledger.now(),
            "completed_at": ledger.now(), "batch_status": SUCCEEDED, "input_row_count": 0,
            "loaded_row_count": 0, "rejected_row_count": 0, "revision": 1,
        })
    for name, dimension in DIMENSIONS.items():
        table = warehouse.table(dimension.table)
        base, schema = table.manifest(), contracts.dimension_schema(dimension)
        member = unknown_member(table.read("open", schema, [], base), name).withColumn(
            "bucket", warehouse.bucket(dimension.identifier)
        )
        home = [f"bucket={member.first()['bucket']}"]
        held = table.read("open", schema, home, base)
        if held.filter(F.col(dimension.key) == C.UNKNOWN_KEY).isEmpty():
            table.commit(base, {"open": Change(member, ["bucket"], seen=frozenset(home))})


def run_full_load(
    warehouse: Warehouse, ledger: Ledger, sources: Sources,
    lookback: timedelta = timedelta(0),
) -> tuple[list[dict], DataFrame]:
    """Bootstrap, four dimensions, four facts, then the post-load checks."""
    bootstrap(warehouse, ledger)
    runs = [
        run_entity(warehouse, ledger, p, as_feed(p, sources[SOURCE_OF[p]]), sources,
                   lookback=lookback)
        for p in (*DIMENSIONS, *FACTS)
    ]
    return runs, post_load_report(warehouse, ledger)


def warehouse_tables(warehouse: Warehouse) -> dict[str, DataFrame]:
    tables = {d.table: read_dimension(warehouse, n) for n, d in DIMENSIONS.items()}
    tables |= {f.table: read_fact(warehouse, n) for n, f in FACTS.items()}
    tables |= {"dim_date": dim_date(warehouse.spark),
               "dim_payment_method": dim_payment_method(warehouse.spark)}
    return tables


def post_load_report(warehouse: Warehouse, ledger: Ledger) -> DataFrame:
    staging = [read_staging(warehouse, n) for n in (*DIMENSIONS, *FACTS)]
    return warehouse_checks.post_load_checks(
        warehouse_tables(warehouse), staging, ledger.batches()
    )
