"""Ranked lexical search with hashed max-sketches.

The index has one row per document: its number of terms, its distinct terms with their occurrences, and a sketch. A
term's impact in a document grows with its occurrences ``tf``, so the sketch keeps, for each coordinate that terms are
hashed to, the *maximum* of ``tf`` over them (one byte, 255: any number). With the document's length that is the
greatest impact of the coordinate. A sketch has four to eight times as many coordinates as the document has
terms (64 to 65,536), so each is a power of two and the same hash serves all widths.

A query's weights times the impacts that its terms' coordinates may have is an upper bound of its score. For a batch of
queries that is one matrix product of integers held exactly in doubles. For each query, documents of a slice are rescored
exactly from their stored terms in descending order of bound, until the next bound cannot enter the ten best so far. The
best so far are carried through a task, and the tasks' lists are merged by one ranked window. So nothing is cut that could
rank, whatever collides in a sketch.

Queries are written in blocks of bounded size to the shared folder and read block by block by the tasks, so neither the
driver nor a task holds all of them. Statistics (documents, terms, documents that hold a term) are counted over all rows.

Edge cases: documents without terms (null, empty, punctuation only) are not counted and not found; an item without terms,
or whose terms no document holds, has no rows; each row of ``items`` is ranked by itself, also where an id repeats or is null;
equal documents are found with equal scores, in the order of doc_id, null last. Other columns are neither read nor returned.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import each_text, file_system, new_folder, remove, written

#: Terms are runs of digits, letters and anything that is not ASCII; only A-Z are lower-cased.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
INDEX = "doc_id bigint, n bigint, terms array<string>, tfs array<bigint>, sketch binary"
FOUND = "item bigint, doc_id bigint, score bigint"
LEAST_WIDTH, MOST_WIDTH = 64, 1 << 16
DOCS_AT_ONCE, TERMS_AT_ONCE, ITEMS_PER_BLOCK = 1024, 2048, 256
NO_ID = np.iinfo(np.int64).max


def terms_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(TERM_BYTES).split()


def coordinate(term: bytes) -> int:
    return xxhash.xxh32_intdigest(term)


def width_for(distinct: int) -> int:
    return int(np.clip(1 << (4 * max(distinct, 1) - 1).bit_length(), LEAST_WIDTH, MOST_WIDTH))


def sketch_of(terms, tfs) -> bytes:
    """Coordinatewise maxima of the occurrences, 255 for that and more."""
    width = width_for(len(terms))
    out = np.zeros(width, np.uint8)
    at = np.fromiter(map(coordinate, terms), np.int64, len(terms)) & (width - 1)
    np.maximum.at(out, at, np.minimum(np.fromiter(tfs, np.int64, len(terms)), 255).astype(np.uint8))
    return out.tobytes()


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Thousandfold saturated occurrences, rounded down."""
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def length_norm(n, documents: int, terms: int):
    return 10 + (90 * n * documents) // max(terms, 1)


def build_index(docs: DataFrame, folder: str) -> DataFrame:
    """The index of ``docs`` (doc_id, text), written to ``folder``; it does not depend on any query."""
    def indexed(batches):
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for start in range(0, len(ids), 256):
                rows = []
                for doc_id, text in zip(ids[start:start + 256], each_text(batch.slice(start, 256), "text")):
                    counts = Counter(terms_of(text))
                    if counts:
                        rows.append((doc_id, sum(counts.values()), [t.decode("utf-8", "surrogatepass") for t in counts],
                                     list(counts.values()), sketch_of(counts, counts.values())))
                columns = zip(*rows) if rows else [[]] * 5
                types = [pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)],
                                                 names=["doc_id", "n", "terms", "tfs", "sketch"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return written(rows.mapInArrow(indexed, INDEX), folder)


def query_terms(items: DataFrame, folder: str) -> tuple[DataFrame, DataFrame, int]:
    """(block, item, term): each distinct term of a row of ``items`` once; (item, item_id); and the number of blocks."""
    blocks = max(1, -(-items.count() // ITEMS_PER_BLOCK))
    numbered = items.select("item_id", F.col("text").cast("string").alias("text")).repartition(blocks)
    # written at once, so that the numbers stay
    numbered = written(numbered.select(F.monotonically_increasing_id().alias("item"), F.spark_partition_id().alias("block"),
                                       "item_id", "text"), f"{folder}/items")

    def split(batches):
        for batch in batches:
            rows = [(block, item, term.decode("utf-8", "surrogatepass"))
                    for block, item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), each_text(batch, "text"))
                    for term in set(terms_of(text))]
            columns = zip(*rows) if rows else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.string()))],
                                             names=["block", "item", "term"])

    terms = numbered.select("block", "item", "text").mapInArrow(split, "block int, item bigint, term string")
    return written(terms, f"{folder}/terms"), numbered.select("item", "item_id"), blocks


class QueryBlock:
    """Terms, weights and items of one block of queries."""

    def __init__(self, table: pa.Table):
        self.items, self.item = np.unique(table.column("item").to_numpy(), return_inverse=True)
        names = table.column("term").to_pylist()
        place = {t: i for i, t in enumerate(dict.fromkeys(names))}
        self.names = pa.array(place, pa.string())
        self.term = np.fromiter(map(place.__getitem__, names), np.int64, len(names))
        self.weight = np.zeros(len(place), np.int64)
        self.weight[self.term] = table.column("weight").to_numpy()
        self.hashes = np.fromiter((coordinate(t.encode("utf-8", "surrogatepass")) for t in place), np.int64, len(place))
        order = np.argsort(self.item, kind="stable")
        self.terms_of_item = np.split(self.term[order], np.searchsorted(self.item[order], np.arange(1, len(self.items))))
        #: For each item the best (score, doc_id) so far, best first.
        self.best = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in self.items]

    def bounds(self, sketches: np.ndarray, m: np.ndarray) -> np.ndarray:
        """Upper bounds of scores, documents by items; all sketches are of one width."""
        tf = np.arange(256, dtype=np.int64)[None, :]
        table = impact(tf, m[:, None]).astype(np.float64)
        table[:, 255] = 1_000_000  # what no number of occurrences exceeds
        out = np.zeros((len(sketches), len(self.items)))
        for at in range(0, len(self.hashes), TERMS_AT_ONCE):
            some = slice(at, at + TERMS_AT_ONCE)
            columns = self.hashes[some] & (sketches.shape[1] - 1)
            weights = np.zeros((len(columns), len(self.items)))
            mine = (self.term >= at) & (self.term < at + TERMS_AT_ONCE)
            weights[self.term[mine] - at, self.item[mine]] = self.weight[self.term[mine]]
            # whole numbers below 2^53 on the way: exact
            out += np.take_along_axis(table, sketches[:, columns].astype(np.int64), axis=1) @ weights
        return out

    def search(self, docs: IndexSlice, k: int) -> None:
        """Takes the documents of a slice into the best of each item."""
        bound = np.empty((docs.size, len(self.items)))
        for width, rows in docs.by_width():
            bound[rows] = self.bounds(docs.sketches(rows, width), docs.m[rows])
        least = np.array([scores[-1] if len(scores) == k else 1 for scores, _ in self.best])
        entries = docs.entries(np.flatnonzero((bound >= least).any(axis=1)), self)
        for item, terms in enumerate(self.terms_of_item):
            scores, ids = self.best[item]
            order = np.flatnonzero(bound[:, item] >= least[item])
            order = order[np.lexsort((docs.ids[order], -bound[order, item]))]
            step = 2 * k
            while len(order):
                if len(scores) == k:
                    # bounds fall and, where equal, ids rise: behind the first that cannot enter, none can
                    top, ident = bound[order, item], docs.ids[order]
                    order = order[:np.count_nonzero((top > scores[-1]) | ((top == scores[-1]) & (ident < ids[-1])))]
                some, order = order[:step], order[step:]
                exact = entries.scores(some, terms)
                some, exact = some[exact > 0], exact[exact > 0]
                scores, ids = np.concatenate([scores, exact]), np.concatenate([ids, docs.ids[some]])
                ranked = np.lexsort((ids, -scores))[:k]
                scores, ids = scores[ranked], ids[ranked]
                step *= 2
            self.best[item] = scores, ids


class Entries:
    """What each of a block's terms adds to the score of some documents, by (document, term)."""

    def __init__(self, row: np.ndarray, term: np.ndarray, gain: np.ndarray, n_terms: int):
        keys = row * n_terms + term
        order = np.argsort(keys)
        self.n_terms, self.keys, self.gain = n_terms, keys[order], gain[order]
        self.size = len(keys)

    def scores(self, rows: np.ndarray, terms: np.ndarray) -> np.ndarray:
        """Exact scores of documents for the terms of one item."""
        out = np.zeros(len(rows), np.int64)
        at_once = max(1, (1 << 20) // len(terms))
        for at in range(0, len(rows) if self.size else 0, at_once):
            wanted = rows[at:at + at_once, None] * self.n_terms + terms[None, :]
            place = np.minimum(np.searchsorted(self.keys, wanted), self.size - 1)
            out[at:at + at_once] = np.where(self.keys[place] == wanted, self.gain[place], 0).sum(axis=1)
        return out


class IndexSlice:
    """Some documents of the index; their terms are only looked at for what is rescored."""

    def __init__(self, batch: pa.RecordBatch, documents: int, terms: int):
        self.size = batch.num_rows
        self.ids = batch.column(0).fill_null(NO_ID).to_numpy().astype(np.int64)
        self.m = length_norm(batch.column(1).to_numpy(), documents, terms)
        self._terms, self._tfs, self._sketch = batch.column(2), batch.column(3), batch.column(4)
        self._width = np.array([len(s.as_buffer()) for s in self._sketch], np.int64)

    def by_width(self) -> Iterator[tuple[int, np.ndarray]]:
        for width in np.unique(self._width):
            rows = np.flatnonzero(self._width == width)
            # wide sketches, a few at a time
            for at in range(0, len(rows), max(1, (1 << 24) // int(width))):
                yield int(width), rows[at:at + max(1, (1 << 24) // int(width))]

    def sketches(self, rows: np.ndarray, width: int) -> np.ndarray:
        return np.stack([np.frombuffer(self._sketch[int(r)].as_buffer(), np.uint8) for r in rows]).reshape(len(rows), width)

    def entries(self, rows: np.ndarray, block: QueryBlock) -> Entries:
        """The block's terms in ``rows``; no other document's terms are looked at."""
        names, tfs = (c.take(pa.array(rows)) for c in (self._terms, self._tfs))
        place = pc.index_in(names.flatten(), value_set=block.names).fill_null(-1).to_numpy()
        row = np.repeat(rows, names.value_lengths().to_numpy())
        found = np.flatnonzero(place >= 0)
        row, term, tf = row[found], place[found].astype(np.int64), tfs.flatten().to_numpy()[found]
        return Entries(row, term, block.weight[term] * impact(tf, self.m[row]), len(block.names))


def search_index(index: DataFrame, items: DataFrame, *, k: int = 10) -> DataFrame:
    """The ``k`` best documents of ``index`` (see :func:`build_index`) for each row of ``items`` (item_id, text)."""
    spark, folder = index.sparkSession, new_folder(index.sparkSession, "max-sketch-queries")
    size = index.agg(F.count("*").alias("documents"), F.sum("n").alias("terms")).first()
    documents, n_terms = size.documents or 0, size.terms or 0
    terms, names, count = query_terms(items, folder)
    # how many documents hold each term that some item asks for; small tables are written first, so that a term which
    # a third of all rows hold can be split in the joins
    asked = written(terms.select("term").distinct(), f"{folder}/asked")
    held = index.select(F.explode("terms").alias("term")).join(asked, "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))
    held = written(held, f"{folder}/held")
    # floor(1000 ln((2N + 2) / (2 df + 1))) in doubles
    weight = F.floor(1000 * F.log((2.0 * documents + 2) / (2.0 * F.col("df") + 1))).cast("bigint")
    weighted = terms.join(held, "term").select("block", "item", "term", weight.alias("weight")).where("weight > 0")
    blocks = f"{folder}/weighted"
    weighted.repartition(F.col("block")).write.partitionBy("block").parquet(blocks)

    def found(batches):
        import pyarrow.dataset as ds
        from pyarrow.fs import FileType

        def load(number):
            """A block of queries; None where no document holds any of its terms."""
            files, path = file_system(f"{blocks}/block={number}")
            if files.get_file_info(path).type == FileType.NotFound:
                return None
            parts = ds.dataset(path, filesystem=files, format="parquet")
            return QueryBlock(parts.to_table(columns=["item", "term", "weight"]))

        kept = {0: load(0)} if count == 1 else {}  # one block stays and carries its best through the task

        def rows_of(block):
            for item, (scores, ids) in zip(block.items, block.best) if block else ():
                if len(scores):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(scores), item, np.int64)), pa.array(ids, mask=ids == NO_ID), pa.array(scores)],
                        names=["item", "doc_id", "score"])

        for batch in batches:
            slices = [IndexSlice(batch.slice(at, DOCS_AT_ONCE), documents, n_terms) for at in range(0, batch.num_rows, DOCS_AT_ONCE)]
            for number in range(count):
                block = kept[number] if number in kept else load(number)
                for part in slices if block else ():
                    block.search(part, k)
                if number not in kept:
                    yield from rows_of(block)
        for block in kept.values():
            yield from rows_of(block)

    ranked = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    best = index.select("doc_id", "n", "terms", "tfs", "sketch").mapInArrow(found, FOUND).withColumn("rank", ranked).where(F.col("rank") <= k)
    result = written(best.join(names, "item").select("item_id", "rank", "doc_id", "score"), new_folder(spark, "ranked"))
    remove(spark, folder)
    return result


def rank_documents(docs: DataFrame, items: DataFrame, *, k: int = 10) -> DataFrame:
    """The ``k`` best of all ``docs`` (doc_id, text) for each row of ``items`` (item_id, text): item_id, rank, doc_id, score."""
    spark = docs.sparkSession
    folder = new_folder(spark, "max-sketches")
    result = search_index(build_index(docs, folder), items, k=k)
    remove(spark, folder)
    return result
