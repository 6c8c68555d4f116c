"""Blocks of tokenised documents, and what shards of n-gram keys tell about them.

Asking a corpus-sized model about every token would shuffle every token. Instead documents are
gathered into blocks of bounded size; a block sends each *distinct* word and word pair it holds once,
packed into one sorted array per shard, and gets one packed answer array per shard back. Shards are
cut by key hash, so the hottest word costs a shard one entry per block.

Tokens are lower-cased words between ASCII white space, then one end token per text.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import drop_kept, each_text, lower_words, pack, unpack

BLOCKS = "block string, n_tokens bigint, payload binary"
QUESTIONS = "shard int, block string, words int, word_keys binary, word_counts binary, pairs int, pair_keys binary, pair_counts binary"
TOKENS_PER_BLOCK = 1_000_000
CHARS_PER_SHARD = 16_000_000
#: The engine's own string hash and seed, so that SQL plans can make the same keys.
SEED = 42


def word_hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word, SEED)


#: The end token is the one word without characters.
END_HASH = word_hash(b"")


def pair_key(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Mixes two 64-bit hashes into one."""
    with np.errstate(over="ignore"):
        x = first * np.uint64(0x9E3779B97F4A7C15) + ((second << np.uint64(31)) | (second >> np.uint64(33)))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Block:
    """Documents' kept columns, their tokens as numbers, and each number's hash (0: the end)."""

    def __init__(self, payload: bytes):
        held = pickle.loads(payload)
        self.rows = pa.ipc.open_stream(held["rows"]).read_all().combine_chunks()
        self.train = np.frombuffer(held["train"], bool)
        self.lengths = np.frombuffer(held["lengths"], np.int64)
        self.tokens = unpack(held["tokens"], int(self.lengths.sum()), np.int32)
        self.hashes = np.frombuffer(held["hashes"], np.uint64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.train_tokens = np.repeat(self.train, self.lengths)

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct pairs as first * words + second; of each token that follows another, its place among them; those tokens."""
        follows = np.ones(len(self.tokens), bool)
        follows[self.starts] = False
        at = np.flatnonzero(follows)
        codes = self.tokens[at - 1].astype(np.int64) * len(self.hashes) + self.tokens[at]
        distinct, place = np.unique(codes, return_inverse=True)
        return distinct, place, at

    def pair_keys(self, distinct: np.ndarray) -> np.ndarray:
        first, second = np.divmod(distinct, len(self.hashes))
        return pair_key(self.hashes[first], self.hashes[second])

    def per_document(self, values: np.ndarray) -> np.ndarray:
        return np.add.reduceat(values, self.starts) if len(values) else np.zeros(0)


def _payload(rows: list[pa.RecordBatch], train, lengths, tokens, hashes) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows[0].schema) as stream:
        for batch in rows:
            stream.write_batch(batch)
    return pickle.dumps({
        "rows": sink.getvalue().to_pybytes(), "train": np.array(train, bool).tobytes(),
        "lengths": np.array(lengths, np.int64).tobytes(), "tokens": pack(np.concatenate(tokens)),
        "hashes": np.array(hashes, np.uint64).tobytes()})


def token_blocks(docs: DataFrame, keep: list[str], train: str | None = None, tokens_per_block: int | None = None) -> DataFrame:
    """Blocks of ``docs`` (text, the columns ``keep``, the boolean column ``train``)."""
    columns, full = [*keep, train] if train else keep, tokens_per_block or TOKENS_PER_BLOCK

    def blocks(batches) -> Iterator[pa.RecordBatch]:
        drop_kept()
        vocabulary: dict[bytes, int] = {}
        rows, trains, lengths, tokens, size = [], [], [], [], 0

        def flush():
            nonlocal vocabulary, rows, trains, lengths, tokens, size
            hashes = np.array([END_HASH, *map(word_hash, vocabulary)], np.uint64)
            flat = np.concatenate(tokens)
            # frequent words get small numbers, which pack well; the end token stays 0
            order = np.argsort(-np.bincount(flat, minlength=len(hashes))[1:], kind="stable") + 1
            rank = np.zeros(len(hashes), np.int32)
            rank[order] = np.arange(1, len(hashes), dtype=np.int32)
            hashes, tokens = np.concatenate([hashes[:1], hashes[order]]), [rank[flat]]
            out = pa.RecordBatch.from_pydict({
                "block": [uuid.uuid4().hex], "n_tokens": pa.array([size], pa.int64()),
                "payload": pa.array([_payload(rows, trains, lengths, tokens, hashes)], pa.binary())})
            vocabulary, rows, trains, lengths, tokens, size = {}, [], [], [], [], 0
            return out

        for batch in batches:
            start, kept = 0, batch.select(keep)
            flags = batch.column(train).to_pylist() if train else [False] * batch.num_rows
            for at, text in enumerate(each_text(batch, "text")):
                words = lower_words(text)
                new = set(words).difference(vocabulary)
                vocabulary.update(zip(new, range(len(vocabulary) + 1, len(vocabulary) + 1 + len(new))))
                ids = np.zeros(len(words) + 1, np.int32)
                ids[:-1] = np.fromiter(map(vocabulary.__getitem__, words), np.int32, len(words))
                tokens.append(ids)
                trains.append(bool(flags[at]))
                lengths.append(len(ids))
                size += len(ids)
                if size >= full:
                    rows.append(kept.slice(start, at + 1 - start))
                    start = at + 1
                    yield flush()
            if start < batch.num_rows:
                rows.append(kept.slice(start))
        if size:
            yield flush()

    return docs.select(*columns, F.col("text").cast("string").alias("text")).mapInArrow(blocks, BLOCKS)


def shard_count(docs: DataFrame) -> int:
    """Shards in proportion to the text."""
    chars = docs.agg(F.sum(F.length("text")).alias("n")).first().n or 0
    return max(24, -(-chars // CHARS_PER_SHARD))


class _Cut:
    """Keys in the order of (shard, key), and the bounds of the shards."""

    def __init__(self, keys: np.ndarray, shards: int):
        shard = (keys % np.uint64(shards)).astype(np.int64)
        self.order = np.lexsort((keys, shard))
        self.keys = keys[self.order]
        self.bounds = np.searchsorted(shard[self.order], np.arange(shards + 1))

    def blob(self, shard: int, column: np.ndarray) -> bytes:
        return pack(column[self.bounds[shard]:self.bounds[shard + 1]])

    def key_blob(self, shard: int) -> bytes:
        part = self.keys[self.bounds[shard]:self.bounds[shard + 1]]
        return pack(np.diff(part, prepend=np.uint64(0)))

    def size(self, shard: int) -> int:
        return int(self.bounds[shard + 1] - self.bounds[shard])


def questions(blocks: DataFrame, shards: int) -> DataFrame:
    """Each block's distinct keys by shard, with their counts in its training documents."""
    def ask(batches):
        for batch in batches:
            for name, payload in zip(batch.column(0).to_pylist(), batch.column(1)):
                block = Block(payload.as_py())
                distinct, place, at = block.pairs()
                pair_keys = block.pair_keys(distinct)
                words, pairs = _Cut(block.hashes, shards), _Cut(pair_keys, shards)
                n_words = np.bincount(block.tokens[block.train_tokens], minlength=len(block.hashes))
                n_pairs = np.bincount(place[block.train_tokens[at]], minlength=len(distinct))
                n_words = n_words.astype(np.uint32)[words.order]
                n_pairs = n_pairs.astype(np.uint32)[pairs.order]
                for s in range(shards):
                    yield pa.RecordBatch.from_arrays([
                        pa.array([s], pa.int32()), pa.array([name]),
                        pa.array([words.size(s)], pa.int32()), pa.array([words.key_blob(s)], pa.binary()),
                        pa.array([words.blob(s, n_words)], pa.binary()),
                        pa.array([pairs.size(s)], pa.int32()), pa.array([pairs.key_blob(s)], pa.binary()),
                        pa.array([pairs.blob(s, n_pairs)], pa.binary())],
                        names=[c.split()[0] for c in QUESTIONS.split(", ")])

    return blocks.select("block", "payload").mapInArrow(ask, QUESTIONS)


def keys_of(blob: bytes, count: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumsum(unpack(blob, count, np.uint64), dtype=np.uint64)


def placed(keys: np.ndarray, shards: int, blobs: dict[int, bytes], dtype) -> np.ndarray:
    """Answers of all shards in the order of ``keys``."""
    cut = _Cut(keys, shards)
    parts = [unpack(blobs[s], cut.size(s), dtype) for s in range(shards)]
    out = np.empty(len(keys), dtype)
    out[cut.order] = np.concatenate(parts)
    return out


def answered(blocks: DataFrame, answers: DataFrame, read: Callable, schema: str) -> DataFrame:
    """``read(block, rows of answers)`` for each block, one row per document; names of answers stay."""
    fields = T._parse_datatype_string(schema).fieldNames()

    def per_block(left: pa.Table, right: pa.Table) -> pa.Table:
        payloads = left.column("payload")
        if not len(payloads):
            raise ValueError("answers without their block")
        block = Block(payloads[0].as_py())
        return pa.table(read(block, right.to_pylist())).select(fields)

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(per_block, schema)
