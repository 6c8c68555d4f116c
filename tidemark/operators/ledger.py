"""Batch ledger: an append-only table in which a batch's latest revision counts."""

from __future__ import annotations

from datetime import datetime, timezone
from uuid import uuid4

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.checks import COUNT, NAME
from tidemark.sources.warehouse import Warehouse
from tidemark.sources.windows import FIRST_WATERMARK, as_utc_naive

# Ledger columns, states, and the number of pipelines in a full load.
LEDGER_COLUMNS = """
    batch_id string, pipeline_name string, started_at timestamp_ntz, completed_at timestamp_ntz,
    batch_status string, mysql_watermark_from timestamp_ntz, mysql_watermark_to timestamp_ntz,
    mongo_watermark_from timestamp_ntz, mongo_watermark_to timestamp_ntz,
    input_row_count bigint, loaded_row_count bigint, rejected_row_count bigint,
    error_message string
"""
LEDGER = LEDGER_COLUMNS + ", revision int"
RUNNING, SUCCEEDED, PARTIAL, FAILED = "RUNNING", "SUCCEEDED", "PARTIAL", "FAILED"
FINISHED = (SUCCEEDED, PARTIAL)
EXPECTED_BATCHES = 8
BOOTSTRAP_BATCH = "00000000-0000-0000-0000-000000000001"


# --- relations -------------------------------------------------------------


def latest_state(revisions: DataFrame) -> DataFrame:
    """One row per batch: its newest revision."""
    payload = [c for c in revisions.columns if c not in ("batch_id", "revision")]
    return (
        revisions.groupBy("batch_id")
        .agg(F.max_by(F.struct(*payload), "revision").alias("_row"))
        .select("batch_id", "_row.*")
    )


def last_watermarks(batches: DataFrame, column: str) -> DataFrame:
    """Resume point per pipeline: its latest finished batch that has a watermark."""
    return (
        batches.filter(F.col("batch_status").isin(*FINISHED) & F.col(column).isNotNull())
        .groupBy("pipeline_name")
        .agg(F.max_by(column, F.struct("completed_at", "started_at")).alias("watermark"))
    )


def last_watermark(batches: DataFrame, pipeline: str, column: str) -> datetime:
    """Resume point of one pipeline, the beginning of time if it never finished."""
    if not pipeline:
        raise ValueError("a pipeline name is required")
    row = (
        last_watermarks(batches.filter(F.col("pipeline_name") == pipeline), column)
        .select(F.col("watermark").cast("string"))
        .first()
    )
    return FIRST_WATERMARK if row is None else datetime.fromisoformat(row[0])


def recent_batches(batches: DataFrame, expected: int = EXPECTED_BATCHES) -> DataFrame:
    """Among the latest batches, those unfinished or failed, plus any that are missing."""
    latest = batches.orderBy(F.col("started_at").desc(), F.col("batch_id").desc()).limit(expected)
    unfinished = F.when(F.col("batch_status").isin(*FINISHED), 0).otherwise(1)
    absent = F.greatest(F.lit(expected) - F.count(F.lit(1)), F.lit(0))
    return latest.agg(
        (F.coalesce(F.sum(unfinished), F.lit(0)) + absent).alias(COUNT)
    ).select(F.lit("latest_etl_batches_succeeded").alias(NAME), COUNT)


def completed_status(rejected: str = "rejected_row_count"):
    return F.when(F.col(rejected) > 0, F.lit(PARTIAL)).otherwise(F.lit(SUCCEEDED))


# --- recording -------------------------------------------------------------


class Ledger:
    """Records batches below a warehouse root; ``clock`` can be set in tests."""

    def __init__(self, warehouse: Warehouse, clock=lambda: datetime.now(timezone.utc)):
        self.warehouse = warehouse
        self._clock = clock

    def revisions(self) -> DataFrame:
        return self.warehouse.read("warehouse", "etl_batch", LEDGER)

    def batches(self) -> DataFrame:
        return latest_state(self.revisions())

    def now(self) -> datetime:
        return as_utc_naive(self._clock())

    def resume_from(self, pipeline: str, column: str) -> datetime:
        return last_watermark(self.batches(), pipeline, column)

    def record(self, row: dict) -> None:
        spark = self.warehouse.spark
        fields = [part.strip().split(" ")[0] for part in LEDGER.split(",")]
        (
            spark.createDataFrame([tuple(row.get(f) for f in fields)], LEDGER)
            .coalesce(1)
            .write.mode("append")
            .parquet(self.warehouse.path("warehouse", "etl_batch"))
        )

    def start(
        self, pipeline: str, input_rows: int, rejected_rows: int, batch_id: str | None = None,
        **watermarks: datetime | None,
    ) -> dict:
        row = {
            "batch_id": batch_id or str(uuid4()),
            "pipeline_name": pipeline,
            "started_at": self.now(),
            "batch_status": RUNNING,
            "input_row_count": input_rows,
            "loaded_row_count": 0,
            "rejected_row_count": rejected_rows,
            "revision": 1,
            **watermarks,
        }
        self.record(row)
        return row

    def complete(self, batch: dict, loaded_rows: int) -> dict:
        status = PARTIAL if batch["rejected_row_count"] > 0 else SUCCEEDED
        return self._close(batch, batch_status=status, loaded_row_count=loaded_rows)

    def fail(self, batch: dict, error: object) -> dict:
        return self._close(batch, batch_status=FAILED, error_message=str(error))

    def _close(self, batch: dict, **changes) -> dict:
        row = {**batch, **changes, "completed_at": self.now(), "revision": batch["revision"] + 1}
        self.record(row)
        return row
