"""Token ids as Arrow files of equal-length sequences with masks.

A corpus is cut into shards of ascending ``doc_id``. Each shard is one Arrow IPC
file of record batches that all hold the same number of sequences; a sequence is
a fixed-size list of ids and a fixed-size list of mask bits (false: padding at the
shard's end). Neither column is compressed, so with a memory map sequence ``i`` is a view:
batch ``i // batch_sequences``, row ``i % batch_sequences``. A second Arrow file names
each document's first token and length.

Edge cases: null and empty texts are documents of the end id alone; a null ``doc_id`` sorts
first; equal ids sort by their text's hash; an empty table gives no files and no rows; other
columns are not read.
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import (
    SPACES_MEET,
    SPLIT_BETWEEN_WORDS,
    crc,
    file_system,
    kept_by_worker,
    new_folder,
    remove,
    texts_of,
    written,
)

#: Longer stretches without a space are encoded each time.
KEPT_CHARS = 64
TEXTS_AT_ONCE = 128
LAST_LATIN = "\u024f"
_LETTER, _NUMBER, _SPACE = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼½¾", r"\x09-\x0d \x85\xa0"
# The byte-level pre-tokenizer's pattern, a fixed value, with the classes as they are up to LAST_LATIN.
LATIN_PATTERN = re.compile(
    rf"'(?:[stmd]|re|ve|ll)| ?[{_LETTER}]+| ?[{_NUMBER}]+| ?[^{_SPACE}{_LETTER}{_NUMBER}]+"
    rf"|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
SPACED_WORD = re.compile(f" [{_LETTER}]+")
WORDS_AT_ONCE = 256
MANIFEST = "shard int, tokens_file string, docs_file string, n_docs bigint, n_tokens bigint"
DOC_SCHEMA = pa.schema([("doc_id", pa.int64()), ("offset", pa.int64()), ("n_tokens", pa.int64())])


class PieceCache:
    """Encodes texts by a byte-level ``tokenizers`` file, each distinct piece of text once.

    Latin texts are cut by the pre-tokenizer's own pattern; others between two non-space
    characters at a single space, where it always starts a new token; a text with an added token's
    string goes to the library whole. All cuts leave the ids as they are. A worker keeps its cache
    from task to task.
    """

    def __init__(self, path: str, end_id: int, kept: int):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = max(self.tokenizer.get_vocab_size(), end_id + 1)
        self.dtype = np.dtype("<u2" if size <= 65_536 else "<u4")
        self.end = np.array([end_id], self.dtype).tobytes()
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added)) or "(?!)")
        self.kept, self.ids = kept, {}

    @classmethod
    def of_worker(cls, *arguments) -> PieceCache:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism
        return kept_by_worker((cls, arguments), lambda: cls(*arguments))

    def cut(self, text: str) -> list[str]:
        if self.added.search(text):
            return [text]
        if text.isascii() or max(text) <= LAST_LATIN:
            return LATIN_PATTERN.findall(text)
        parts = SPLIT_BETWEEN_WORDS.split(text) if SPACES_MEET.search(text) else text.split(" ")
        return [parts[0], *[" " + p for p in parts[1:]]]

    def _encode(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        flat = np.fromiter(chain.from_iterable(e.ids for e in found), self.dtype).tobytes()
        ends = (np.cumsum([len(e) for e in found], dtype=int) * self.dtype.itemsize).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends)]

    def _learn(self, pieces: list[str]) -> None:
        """Encode new pieces; words with their space are joined, for the pre-tokenizer parts them again."""
        words = list(filter(SPACED_WORD.fullmatch, pieces))
        joined = [words[i:i + WORDS_AT_ONCE] for i in range(0, len(words), WORDS_AT_ONCE)]
        found = self.tokenizer.encode_batch(list(map("".join, joined)), add_special_tokens=False)
        for group, encoded in zip(joined, found):
            flat, size = np.array(encoded.ids, self.dtype).tobytes(), self.dtype.itemsize
            ends = np.searchsorted(encoded.word_ids, np.arange(len(group)), "right") * size
            self.ids.update(zip(group, [flat[a:b] for a, b in zip([0, *ends.tolist()], ends.tolist())]))
        rest = [p for p in pieces if p not in self.ids]
        self.ids.update(zip(rest, self._encode(rest)))

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Bytes of each text's ids and the end id."""
        for at in range(0, len(texts), TEXTS_AT_ONCE):
            if len(self.ids) > self.kept:
                self.ids = {}
            pieces = list(map(self.cut, texts[at:at + TEXTS_AT_ONCE]))
            new = list(set().union(*pieces).difference(self.ids))
            self._learn(new)
            for of_text in pieces:
                yield b"".join(map(self.ids.__getitem__, of_text)) + self.end
            for piece in new:
                if len(piece) > KEPT_CHARS:
                    del self.ids[piece]


class ShardWriter:
    """Appends documents to one shard; memory is one batch of sequences."""

    def __init__(self, folder: str, shard: int, dtype, length: int, batch: int):
        self.fs, base = file_system(folder)
        self.fs.create_dir(base, recursive=True)
        # A repeated task writes other files; only those in the manifest count.
        stem = f"{base}/{shard:06d}-{uuid.uuid4().hex}"
        self.names = f"{stem}.tokens.arrow", f"{stem}.docs.arrow"
        self.dtype, self.length, self.batch = np.dtype(dtype), length, batch
        value = pa.from_numpy_dtype(self.dtype)
        self.schema = pa.schema(
            [("tokens", pa.list_(value, length)), ("mask", pa.list_(pa.bool_(), length))],
            metadata={"sequence_length": str(length), "batch_sequences": str(batch)})
        self.streams = [self.fs.open_output_stream(n) for n in self.names]
        self.tokens = pa.ipc.new_file(self.streams[0], self.schema)
        self.docs = pa.ipc.new_file(self.streams[1], DOC_SCHEMA)
        self.waiting, self.waiting_bytes, self.rows = [], 0, []
        self.n_docs = self.n_tokens = 0

    def add(self, doc_id, ids: bytes) -> None:
        count = len(ids) // self.dtype.itemsize
        self.rows.append((doc_id, self.n_tokens, count))
        self.n_docs, self.n_tokens = self.n_docs + 1, self.n_tokens + count
        self.waiting.append(ids)
        self.waiting_bytes += len(ids)
        full = self.length * self.batch * self.dtype.itemsize
        if self.waiting_bytes >= full:
            joined = b"".join(self.waiting)
            cut = len(joined) // full * full
            for at in range(0, cut, full):
                self._write(np.frombuffer(joined[at:at + full], self.dtype))
            self.waiting, self.waiting_bytes = [joined[cut:]], len(joined) - cut
        if len(self.rows) >= 50_000:
            self._write_docs()

    def _write(self, ids: np.ndarray) -> None:
        padded = -len(ids) % self.length
        mask = np.ones(len(ids) + padded, dtype=bool)
        mask[len(ids):] = False
        ids = np.concatenate([ids, np.zeros(padded, self.dtype)])
        self.tokens.write_batch(pa.record_batch([
            pa.FixedSizeListArray.from_arrays(pa.array(ids), self.length),
            pa.FixedSizeListArray.from_arrays(pa.array(mask), self.length)], schema=self.schema))

    def _write_docs(self) -> None:
        columns = zip(*self.rows)
        self.docs.write_batch(pa.record_batch([pa.array(c, pa.int64()) for c in columns], schema=DOC_SCHEMA))
        self.rows = []

    def close(self) -> None:
        if self.waiting_bytes:
            self._write(np.frombuffer(b"".join(self.waiting), self.dtype))
        if self.rows:
            self._write_docs()
        for sink in (self.tokens, self.docs, *self.streams):
            sink.close()


class TokenShard:
    """Random access to one shard; views of a memory map where the folder is a local one."""

    def __init__(self, folder: str, tokens_file: str, docs_file: str):
        self.fs, _ = file_system(folder)
        self.reader, self.docs = (pa.ipc.open_file(self._open(n)) for n in (tokens_file, docs_file))
        self.batch = int(self.reader.schema.metadata[b"batch_sequences"])
        self.length = int(self.reader.schema.metadata[b"sequence_length"])

    def _open(self, name: str):
        return pa.memory_map(name) if self.fs.type_name == "local" else self.fs.open_input_file(name)

    def _column(self, number: int, column: int) -> pa.Array:
        batch = self.reader.get_batch(number // self.batch)
        at = number % self.batch * self.length
        return batch.column(column).values.slice(at, self.length)

    def sequence(self, number: int) -> np.ndarray:
        """Ids of one sequence, without a copy."""
        return self._column(number, 0).to_numpy(zero_copy_only=True)

    def mask(self, number: int) -> pa.BooleanArray:
        return self._column(number, 1)

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, first token in the shard, ids) in order; memory is a batch and a document."""
        batches = (self.reader.get_batch(i).column(0).values.to_numpy()
                   for i in range(self.reader.num_record_batches))
        held = np.empty(0, np.uint32)
        for i in range(self.docs.num_record_batches):
            for doc_id, offset, count in zip(*(c.to_pylist() for c in self.docs.get_batch(i).columns)):
                if len(held) < count:
                    parts, have = [held], len(held)
                    while have < count:
                        parts.append(next(batches))
                        have += len(parts[-1])
                    held = np.concatenate(parts[1:] if not len(parts[0]) else parts)
                yield doc_id, offset, held[:count]
                held = held[count:]


def write_token_files(
    docs: DataFrame, folder: str, tokenizer: str, *, end_id: int, length: int = 1024,
    batch_sequences: int = 64, kept_pieces: int = 1_000_000,
) -> DataFrame:
    """Write ``docs`` (doc_id, text) as shards below ``folder``; the manifest of the shards.

    One range sort by ``doc_id`` (hot ids are split by their text's hash); each task tokenises and
    writes its range. ``tokenizer`` is the path of a ``tokenizers`` file on every executor.
    """
    def write(batches):
        encoder, writer = PieceCache.of_worker(tokenizer, end_id, kept_pieces), None
        shard = TaskContext.get().partitionId()
        for batch in batches:
            if writer is None and batch.num_rows:
                writer = ShardWriter(folder, shard, encoder.dtype, length, batch_sequences)
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoder.encode(texts_of(batch, "text"))):
                writer.add(doc_id, ids)
        if writer:
            writer.close()
            yield pa.RecordBatch.from_pydict({
                "shard": pa.array([shard], pa.int32()), "tokens_file": [writer.names[0]],
                "docs_file": [writer.names[1]], "n_docs": [writer.n_docs], "n_tokens": [writer.n_tokens]})

    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    manifest = rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(write, MANIFEST)
    return written(manifest, f"{folder}/manifest")


def read_token_files(manifest: DataFrame, folder: str) -> DataFrame:
    """One row per document, read back from the files.

    ``start`` counts the ids of all documents before it. The running total is over shards, one row
    for each file.
    """
    def read(batches):
        for batch in batches:
            for row in batch.to_pylist():
                rows = [(d, row["base"] + at, len(ids), crc(ids)) for d, at, ids in
                        TokenShard(folder, row["tokens_file"], row["docs_file"]).documents()]
                for at in range(0, len(rows), 10_000):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, pa.int64()) for c in zip(*rows[at:at + 10_000])],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"])

    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    based = manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    spread = based.repartition(max(1, manifest.count()))
    return spread.mapInArrow(read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def token_files(docs: DataFrame, tokenizer: str, *, end_id: int, **options) -> DataFrame:
    """Write the files to a new shared folder and return what they hold, per document."""
    spark: SparkSession = docs.sparkSession
    folder = new_folder(spark, "tokens")
    found = read_token_files(write_token_files(docs, folder, tokenizer, end_id=end_id, **options), folder)
    kept = new_folder(spark, "token-rows")
    result = written(found, kept)
    remove(spark, folder)
    return result
