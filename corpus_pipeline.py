"""From raw documents to tokens: quality, near-duplicates, decontamination, encoding.

Each stage takes (spark, docs, sf_dir), works on all rows that the one before kept, and is written as Parquet before
the next reads it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import new_folder, remove, row_key, table, written
from tidemark.llm.decontaminate import decontaminate
from tidemark.llm.kneser_ney import classify_quality
from tidemark.llm.near_copies import drop_near_copies
from tidemark.llm.queries import tokenizer_path
from tidemark.llm.unigram_pieces import encode_pieces


def whole(docs: DataFrame) -> Column:
    """All columns of a row as one, so that none clashes with those of an operator."""
    return F.struct(*docs.columns).alias("row")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the Kneser-Ney classifier does not reject."""
    judged = classify_quality(docs, table(spark, sf_dir, "labels"))
    rows = docs.select(whole(docs), row_key("doc_id", "lang", F.coalesce("text", F.lit(""))).alias("key"))
    return rows.join(judged.where("keep").select("key"), "key", "left_semi").select("row.*")


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: five-word shingles, similarity 0.8."""
    return drop_near_copies(docs, words=5, similarity=0.8)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words are benchmark passages, as they are."""
    rows = docs.select(whole(docs), "text")
    return decontaminate(rows, table(spark, sf_dir, "benchmark")).where("NOT contaminated").select("row.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document."""
    return encode_pieces(docs, tokenizer_path("piece_bpe_32k.model"))


STAGES = [
    ("quality_classifier", keep_quality),
    ("simhash_near_dedup", keep_one_of_near_copies),
    ("benchmark_decontamination", drop_contaminated),
    ("sentencepiece_encoding", encode),
]

#: Perplexities, fingerprints, automata and Viterbi paths are beyond SQL; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        folder = new_folder(spark, f"pipeline-{name}")
        docs = written(stage(spark, docs, sf_dir), folder)
        if before:
            remove(spark, before)
        before = folder
    return docs
