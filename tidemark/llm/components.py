"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import new_folder, remove, written


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """One step: neighbours are re-hung below the least of them and the node itself."""
    both = edges if small else edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    # a > b in every edge, so the least of a's smaller neighbours is below a itself
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    hung = both.join(least, "a")
    if small:
        hung = hung.select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b")).where(F.col("a") > F.col("b"))
    else:
        hung = hung.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return hung.distinct()


def connected(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b: bigint); the root is the least of its component.

    Every round is written to the shared folder; rounds grow with the logarithm of a component's
    size. Hubs are reduced map-side, and the join that brings the minimum back can be split.
    """
    spark = links.sparkSession
    ordered = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    folder = new_folder(spark, "components")
    edges, seen = written(ordered, folder), None
    while True:
        step = _star(_star(edges, small=False), small=True)
        following = new_folder(spark, "components")
        edges = written(step, following)
        remove(spark, folder)
        folder = following
        state = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if state == seen:
            break
        seen = state
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
