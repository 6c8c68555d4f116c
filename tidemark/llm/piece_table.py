"""Fill-in-middle transformation with a piece table.

A document is a list of descriptors ``(buffer, start, end)`` over two buffers that never change: its own UTF-8 bytes and
the sentinels. Cutting splits a descriptor, an arrangement permutes descriptors and puts sentinels among them, the
inverse permutation restores the order, and hashes read the descriptors one after another. Text is copied only where
a caller asks for it. Cuts are given in code points; they become byte offsets by counting lead bytes in fixed stretches, so a
very long text needs no index.

Where a document is cut and which form it takes comes from the first four 8-digit groups of
``sha256(salt + ":" + id)``, so a run can be repeated anywhere and in any order.

Edge cases: a null text is empty; an empty text, and one that holds a sentinel, stays plain; a null id counts as an empty
one; equal rows give equal results; other columns are neither read nor returned.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The sentinels before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
SENTINELS = PREFIX + SUFFIX + MIDDLE
#: The order of the parts of each form: 0 prefix, 1 middle, 2 suffix; and where each part's sentinel lies.
FORMS = {"psm": (0, 2, 1), "spm": (2, 0, 1)}
SENTINEL_OF = {0: (0, 3), 2: (3, 6), 1: (6, 9)}
TEXT, MARKS = 0, 1
STRETCH = 1 << 16

PIECES = "array<struct<buffer: int, start: bigint, end: bigint>>"
ARRANGED = f"doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, pieces {PIECES}, output string, output_sha256 string"


def lead_bytes(data) -> int:
    """Code points of UTF-8 bytes, counted stretch by stretch."""
    return sum(int(np.count_nonzero((np.frombuffer(data[at:at + STRETCH], np.uint8) & 0xC0) != 0x80))
               for at in range(0, len(data), STRETCH))


def byte_offset(data, points: int) -> int:
    """Where the code point number ``points`` begins."""
    for at in range(0, len(data), STRETCH):
        leads = (np.frombuffer(data[at:at + STRETCH], np.uint8) & 0xC0) != 0x80
        here = int(np.count_nonzero(leads))
        if points < here:
            return at + int(np.flatnonzero(leads)[points])
        points -= here
    return len(data)


@dataclass(frozen=True)
class PieceTable:
    """Descriptors over the immutable buffers ``text`` and ``marks``."""

    text: memoryview
    pieces: tuple[tuple[int, int, int], ...]
    marks: bytes = SENTINELS

    @classmethod
    def of(cls, data) -> PieceTable:
        view = memoryview(data)
        return cls(view, ((TEXT, 0, len(view)),))

    def cut(self, *offsets: int) -> PieceTable:
        """Descriptors split at byte offsets of the document; a cut at an edge or twice leaves an empty piece."""
        pieces, at = [], 0
        left = sorted(offsets)
        for buffer, start, end in self.pieces:
            while left and left[0] <= at + end - start:
                middle = start + left.pop(0) - at
                pieces.append((buffer, start, middle))
                at, start = at + middle - start, middle
            pieces.append((buffer, start, end))
            at += end - start
        return PieceTable(self.text, tuple(pieces), self.marks)

    def permuted(self, order) -> PieceTable:
        return PieceTable(self.text, tuple(self.pieces[i] for i in order), self.marks)

    def with_sentinels(self, order) -> PieceTable:
        """Each piece behind the sentinel of the part that ``order`` says it is."""
        marked = [p for part, piece in zip(order, self.pieces) for p in ((MARKS, *SENTINEL_OF[part]), piece)]
        return PieceTable(self.text, tuple(marked), self.marks)

    def without_sentinels(self) -> PieceTable:
        return PieceTable(self.text, tuple(p for p in self.pieces if p[0] == TEXT), self.marks)

    def stream(self):
        """The bytes of the pieces, without copying."""
        buffers = (self.text, memoryview(self.marks))
        for buffer, start, end in self.pieces:
            yield buffers[buffer][start:end]

    def sha256(self) -> str:
        digest = hashlib.sha256()
        for part in self.stream():
            digest.update(part)
        return digest.hexdigest()

    def __bytes__(self) -> bytes:
        return b"".join(self.stream())


def inverse(order) -> tuple[int, ...]:
    return tuple(int(i) for i in np.argsort(order))


def arrange(data, form: str, first: int, second: int) -> PieceTable:
    """The document cut at two code points and put into ``form``."""
    table = PieceTable.of(data)
    if form == "plain":
        return table
    order = FORMS[form]
    return table.cut(byte_offset(data, first), byte_offset(data, second)).permuted(order).with_sentinels(order)


def restore(output, form: str) -> PieceTable:
    """The document again, from an arranged text and its form; sentinels are found in the text itself."""
    table = PieceTable.of(output)
    if form == "plain":
        return table
    whole, order, at, pieces = bytes(output), FORMS[form], 0, []
    for part in order:
        start, end = SENTINEL_OF[part]
        found = whole.find(SENTINELS[start:end], at)
        if found < 0 or (not pieces and found):
            raise ValueError(f"no {SENTINELS[start:end].decode()} where the form {form} has one")
        if pieces:
            pieces[-1] = (TEXT, pieces[-1][1], found)
        at = found + end - start
        pieces.append((TEXT, at, len(whole)))
    return PieceTable(table.text, tuple(pieces)).permuted(inverse(order))


def plan(doc_id: int | None, n: int, has_sentinel: bool, salt: str, plain_from: int, spm_below: int) -> tuple[str, int, int]:
    """Form and the two cuts of a document of ``n`` code points."""
    digest = hashlib.sha256(f"{salt}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i:i + 8], 16) for i in range(0, 32, 8))
    if n == 0 or has_sentinel or h3 % 100 >= plain_from:
        return "plain", 0, 0
    return ("spm" if h4 % 100 < spm_below else "psm"), *sorted((h1 % (n + 1), h2 % (n + 1)))


def _utf8(column: pa.Array):
    """The buffers of a string column's values, not copied; null is empty."""
    for value in column.cast(pa.large_string()):
        buffer = value.as_buffer()
        yield memoryview(buffer) if buffer is not None else memoryview(b"")


def fill_in_middle(docs: DataFrame, *, salt: str = "1", plain_from: int = 90, spm_below: int = 20) -> DataFrame:
    """Arranged texts of ``docs`` (doc_id, text), the descriptors they are made of, and their hashes.

    Of 100 documents ``plain_from`` are cut; of 100 of these ``spm_below`` put the suffix first.
    """
    fields = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "pieces", "output", "output_sha256"]
    piece = pa.list_(pa.struct([("buffer", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]))
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), piece, pa.string(), pa.string()]

    def arranged(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part, rows = batch.slice(at, 512), []
                for doc_id, data in zip(part.column(0).to_pylist(), _utf8(part.column(1))):
                    n, whole = lead_bytes(data), bytes(data)
                    form, first, second = plan(doc_id, n, any(s in whole for s in (PREFIX, SUFFIX, MIDDLE)),
                                               salt, plain_from, spm_below)
                    table = arrange(data, form, first, second)
                    cut = form != "plain"
                    rows.append((doc_id, n, form, first if cut else None, second - first if cut else None,
                                 [dict(zip(("buffer", "start", "end"), p)) for p in table.pieces],
                                 bytes(table).decode("utf-8", "surrogatepass"), table.sha256()))
                columns = zip(*rows) if rows else [[]] * len(types)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=fields)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        arranged, ARRANGED)


def restored(arranged: DataFrame, *, keep: list[str], with_text: bool = True) -> DataFrame:
    """The documents of :func:`fill_in_middle` again, from ``output`` and ``form`` alone.

    Returns the columns ``keep`` with ``restored`` (unless ``with_text`` is off) and ``restored_sha256``.
    """
    schema = arranged.select(keep).schema.add("restored", "string").add("restored_sha256", "string")
    if not with_text:
        schema = arranged.select(keep).schema.add("restored_sha256", "string")

    def back(batches):
        for batch in batches:
            texts, digests = [], []
            for form, data in zip(batch.column(0).to_pylist(), _utf8(batch.column(1))):
                table = restore(data, form)
                digests.append(table.sha256())
                if with_text:
                    texts.append(bytes(table).decode("utf-8", "surrogatepass"))
            added = [pa.array(texts, pa.string())] * with_text + [pa.array(digests, pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], *added], names=schema.names)

    return arranged.select("form", "output", *[F.col(c).alias(f"kept_{i}") for i, c in enumerate(keep)]).mapInArrow(back, schema)
