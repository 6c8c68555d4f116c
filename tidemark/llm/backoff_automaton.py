"""Language-model scoring by a weighted backoff automaton over the whole corpus.

States are the contexts "no word" (the root) and each training word. The arc of state ``u`` by word
``v`` weighs ``log10 (c(uv) + m p(v)) / (c(u) + m)`` and leads to state ``v``; where the pair was not
seen, the failure arc leads to the root and weighs ``log10 m / (c(u) + m)``, and the root's arc by ``v``
weighs ``log10 p(v)``. So every state's weights sum to one (Dirichlet smoothing with prior mass ``m``).
``p(v) = (c(v) + 0.5) / (N + 0.5 (V + 1))`` also covers words that training lacks; their
arc leads to the root.

The automaton of the corpus is cut by key into shards; a block of documents (see
:mod:`ngram_blocks`) fetches just its own arcs and is traversed once from left to right.

Edge cases: null and empty texts are the end token alone; a null id is not held out; equal rows are
scored alike and all count in training; without training documents N = V = 0 and every score is 0
(``p = 0.5 / 0.5``); other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import new_folder, pack, remove, unpack, written
from tidemark.llm.ngram_blocks import Block, answered, keys_of, placed, questions, shard_count, token_blocks

ANSWERS = "block string, shard int, words binary, pairs binary, n_tokens bigint, n_words bigint"
SCORES = ("doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, "
          "base_score double, score double")


def sum_counts(group: pa.Table) -> pa.Table:
    """Of one shard's questions: every key's count over all blocks, sent to each block that asked."""
    rows, out = group.to_pylist(), []
    totals = {}
    for kind in ("word", "pair"):
        sizes = [r[f"{kind}s"] for r in rows]
        keys = np.concatenate([keys_of(r[f"{kind}_keys"], n) for r, n in zip(rows, sizes)])
        counts = np.concatenate([unpack(r[f"{kind}_counts"], n, np.uint32) for r, n in zip(rows, sizes)])
        distinct, place = np.unique(keys, return_inverse=True)
        total = np.bincount(place, weights=counts, minlength=len(distinct)).astype(np.uint64)
        totals[kind] = total
        found, ends = total[place], np.cumsum(sizes)
        out.append([pack(found[e - n:e]) for e, n in zip(ends, sizes)])
    first = np.arange(len(rows)) == 0  # the shard's own figures stand on its first row
    return pa.table({
        "block": [r["block"] for r in rows], "shard": pa.array([r["shard"] for r in rows], pa.int32()),
        "words": pa.array(out[0], pa.binary()), "pairs": pa.array(out[1], pa.binary()),
        "n_tokens": (first * int(totals["word"].sum())).astype(np.int64),
        "n_words": (first * int((totals["word"] > 0).sum())).astype(np.int64)})


class BackoffAutomaton:
    """The part of the automaton that one block of documents needs."""

    def __init__(self, word_counts, pair_codes, pair_counts, total: int, distinct: int, prior: float):
        self.words = len(word_counts)
        p = (word_counts + 0.5) / (total + 0.5 * (distinct + 1))
        self.root = np.log10(p)
        self.failure = np.log10(prior / (word_counts + prior))
        seen = pair_counts > 0
        first, second = np.divmod(pair_codes[seen], self.words)
        self.arcs = pair_codes[seen]
        self.weights = np.log10((pair_counts[seen] + prior * p[second]) / (word_counts[first] + prior))
        self.is_state = word_counts > 0

    def traverse(self, tokens: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Weight of every token's step, each document from the root."""
        state = np.empty(len(tokens), np.int64)  # the word before, which is the state it leads to
        state[1:] = tokens[:-1]
        state[starts] = -1
        state[(state >= 0) & ~self.is_state[np.maximum(state, 0)]] = -1
        step = self.root[tokens].copy()
        inner = np.flatnonzero(state >= 0)
        codes = state[inner] * self.words + tokens[inner]
        arc = np.searchsorted(self.arcs, codes)
        hit = arc < len(self.arcs)
        hit[hit] = self.arcs[arc[hit]] == codes[hit]
        step[inner[hit]] = self.weights[arc[hit]]
        step[inner[~hit]] += self.failure[state[inner[~hit]]]
        return step


def score_documents(docs: DataFrame, *, folds: int = 5, held_out_fold: int = 1, prior: float = 200.0) -> DataFrame:
    """Scores of all ``docs`` (doc_id, text), learning from those outside the held-out fold."""
    spark = docs.sparkSession
    folder = new_folder(spark, "automaton")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == held_out_fold, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").withColumn("held_out", held)
    rows = rows.withColumn("train", ~F.col("held_out"))
    shards = shard_count(rows)
    blocks = written(token_blocks(rows, ["doc_id", "held_out"], "train"), f"{folder}/blocks")
    asked = questions(blocks, shards).repartition(shards, "shard")
    answers = written(asked.groupBy("shard").applyInArrow(sum_counts, ANSWERS), f"{folder}/answers")
    totals = answers.agg(F.sum("n_tokens").alias("n"), F.sum("n_words").alias("v")).first()
    total, distinct = totals.n or 0, totals.v or 0

    def read(block: Block, found: list[dict]) -> dict:
        codes, _, _ = block.pairs()
        n_words = placed(block.hashes, shards, {r["shard"]: r["words"] for r in found}, np.uint64).astype(float)
        n_pairs = placed(block.pair_keys(codes), shards, {r["shard"]: r["pairs"] for r in found}, np.uint64).astype(float)
        automaton = BackoffAutomaton(n_words, codes, n_pairs, total, distinct, prior)
        return {
            "doc_id": block.rows.column("doc_id"), "held_out": block.rows.column("held_out"),
            "n_tokens": block.lengths,
            "n_known": block.per_document((n_words > 0)[block.tokens].astype(np.int64)),
            "train_tokens": np.full(len(block.lengths), total, np.int64),
            "base_score": block.per_document(automaton.root[block.tokens]),
            "score": block.per_document(automaton.traverse(block.tokens, block.starts))}

    result = written(answered(blocks, answers.drop("n_tokens", "n_words"), read, SCORES), new_folder(spark, "scores"))
    remove(spark, folder)
    return result
