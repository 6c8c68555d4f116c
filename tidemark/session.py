"""Session defaults and the checkpoint folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def create_session(app_name: str = "tidemark", **settings: str) -> SparkSession:
    """Session with the settings the plans count on; ``settings`` override them."""
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.parquet.filterPushdown": "true",
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        # Checkpointed frames are intermediate: their files go when the frame does.
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    builder = SparkSession.builder.appName(app_name)
    for name, value in {**defaults, **settings}.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str | None:
    """The folder all executors share, as the cluster names it."""
    return spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()


def ensure_checkpoint_folder(spark: SparkSession, fallback: str) -> str:
    """Use the cluster's checkpoint folder; ``fallback`` only where none is set."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(spark) or fallback)
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame, fallback: str) -> DataFrame:
    """Evaluate once into the shared checkpoint folder and continue from there."""
    ensure_checkpoint_folder(df.sparkSession, fallback)
    return df.checkpoint(eager=True)
