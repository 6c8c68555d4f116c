"""SimHash fingerprints, linked exactly through vantage-point trees.

A vantage-point node splits fingerprints by Hamming distance to its vantage: at most the median
distance (inner) or more (outer). By the triangle inequality, a link of at most ``radius`` bits that
crosses the split has its inner end within ``radius`` of the boundary; so those inner fingerprints
are also sent to the outer side, and every linked pair meets in some shard. The upper levels
are fitted to a bounded sample (``sample`` fingerprints by hash order) and deal the distinct fingerprints out as
shards; each shard goes on splitting in memory until small blocks are compared bit by bit. A shard returns one link
per fingerprint that has any, to the least of its local component, so dense groups do not multiply.

Edge cases: null, empty and blank texts have fingerprint zero and link like any other; equal texts share a
fingerprint and so a component; a null doc_id never names a component unless all its members are null (then null);
repeated rows come out as often as they went in.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import each_text, lower_words, new_folder, remove, written
from tidemark.llm.components import connected

SEED = 42
#: Blocks of at most this many fingerprints are compared pair by pair.
BLOCK = 384
#: Vantages tried for each split; the one with the smallest larger side is taken.
TRIED = 6


def shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    """XXH64 of every run of ``size`` words, repeats included; of the whole text if it has fewer words."""
    if not words:
        return np.empty(0, np.uint64)
    runs = [b" ".join(words)] if len(words) < size else map(b" ".join, zip(*(words[i:] for i in range(size))))
    count = max(1, len(words) - size + 1)
    return np.fromiter((xxhash.xxh64_intdigest(r, SEED) for r in runs), np.uint64, count)


def fingerprint(hashes: np.ndarray) -> int:
    """Unsigned 64 bits, each set where over half of the hashes set it."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65_536):
        part = hashes[at:at + 65_536].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, fp) of every row; fp is the fingerprint as a signed number."""
    def stream(batches):
        for batch in batches:
            found = [fingerprint(shingle_hashes(lower_words(t), words)) for t in each_text(batch, "text")]
            fp = pa.array(np.array(found, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), fp], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(stream, "doc_id bigint, fp bigint")


@dataclass
class Split:
    """A vantage and the median distance to it."""

    vantage: np.uint64
    middle: int

    @classmethod
    def of(cls, points: np.ndarray, radius: int) -> Split | None:
        """The best of a few vantages; None if no split gains anything."""
        best, best_size = None, 0.95 * len(points)
        for vantage in points[:: max(1, len(points) // TRIED)][:TRIED]:
            far = np.bitwise_count(points ^ vantage)
            middle = int(np.partition(far, len(far) // 2)[len(far) // 2])
            for m in (middle - 1, middle):
                inner = np.count_nonzero(far <= m)
                size = max(inner, len(points) - inner + np.count_nonzero((far > m - radius) & (far <= m)))
                if size < best_size:
                    best, best_size = cls(vantage, m), size
        return best

    def sides(self, points: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Masks of the inner and the outer side; points near the boundary are on both."""
        far = np.bitwise_count(points ^ self.vantage).astype(np.int16)
        return far <= self.middle, far > self.middle - radius


def fit_tree(sample: np.ndarray, depth: int, radius: int) -> dict[int, Split]:
    """Splits by heap number (root 1, children 2i inner and 2i+1 outer)."""
    tree, waiting = {}, [(1, sample)]
    while waiting:
        node, points = waiting.pop()
        split = Split.of(points, radius) if node < 2**depth and len(points) >= 16 else None
        if split:
            tree[node] = split
            inner, outer = split.sides(points, radius)
            waiting += [(2 * node, points[inner]), (2 * node + 1, points[outer])]
    return tree


def route(tree: dict[int, Split], points: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
    """(leaf, points that belong there)."""
    waiting = [(1, points)]
    while waiting:
        node, here = waiting.pop()
        if not len(here):
            continue
        if node not in tree:
            yield node, here
            continue
        inner, outer = tree[node].sides(here, radius)
        waiting += [(2 * node, here[inner]), (2 * node + 1, here[outer])]


class Forest:
    """Union by least number, on arrays."""

    def __init__(self, size: int):
        self.root = np.arange(size)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            x, y = self.root[a], self.root[b]
            apart = x != y
            if not apart.any():
                return
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(self.root, np.maximum(x, y), np.minimum(x, y))
            while True:
                up = self.root[self.root]
                if (up == self.root).all():
                    break
                self.root = up


def link_locally(points: np.ndarray, radius: int) -> np.ndarray:
    """Each point's least local root, by vantage-point splits down to small blocks."""
    forest, waiting = Forest(len(points)), [np.arange(len(points))]
    while waiting:
        own = waiting.pop()
        here = points[own]
        split = Split.of(here, radius) if len(own) > BLOCK else None
        if split:
            inner, outer = split.sides(here, radius)
            waiting += [own[inner], own[outer]]
            continue
        for at in range(0, len(own), BLOCK):  # one block, or a group that no vantage divides
            near = np.bitwise_count(here[at:at + BLOCK, None] ^ here[None, :]) <= radius
            a, b = np.nonzero(near)
            keep = a + at < b
            forest.join(own[a[keep] + at], own[b[keep]])
    return forest.root


def close_pairs(points: np.ndarray, low: np.ndarray, high: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers (a, b) of all points within ``radius``, itself included, but of one class (``low`` = ``high``) only."""
    out, waiting = [(np.empty(0, np.int64),) * 2], [np.arange(len(points))]
    while waiting:
        own = waiting.pop()
        if not len(own) or low[own].min() == high[own].max():
            continue
        here = points[own]
        split = Split.of(here, radius) if len(own) > BLOCK else None
        if split:
            inner, outer = split.sides(here, radius)
            waiting += [own[inner], own[outer]]
            continue
        for at in range(0, len(own), BLOCK):
            a, b = np.nonzero(np.bitwise_count(here[at:at + BLOCK, None] ^ here[None, :]) <= radius)
            keep = a + at <= b
            a, b = own[a[keep] + at], own[b[keep]]
            apart = np.minimum(low[a], low[b]) != np.maximum(high[a], high[b])
            out.append((a[apart], b[apart]))
    return tuple(np.concatenate(side) for side in zip(*out))


def shard_tree(classes: DataFrame, radius: int, per_shard: int, sample: int):
    """The broadcast upper levels for the fingerprints of ``classes``."""
    spark = classes.sparkSession
    count = classes.count()
    depth = max(5, math.ceil(math.log(max(1, count / per_shard)) / math.log(1 / 0.65)))
    depth = min(depth, int(math.log2(sample / 16)))
    some = classes.orderBy(F.xxhash64("fp"), "fp").limit(min(sample, 64 * 2**depth)).select("fp")
    points = np.array([r.fp for r in some.collect()], np.int64).view(np.uint64)
    return spark.sparkContext.broadcast(fit_tree(points, depth, radius))


def neighbours(classes: DataFrame, radius: int, *, per_shard: int = 60_000, sample: int = 65_536) -> DataFrame:
    """All pairs (a, b) of fingerprints within ``radius`` bits that are not in one class.

    ``classes`` (fp, low, high) holds each fingerprint once with the least and the greatest class of its members;
    a fingerprint with members of different classes is paired with itself too."""
    tree = shard_tree(classes, radius, per_shard, sample)

    def deal(batches):
        for batch in batches:
            here, low, high = (batch.column(i).to_numpy().astype(np.int64) for i in range(3))
            here = here.view(np.uint64)
            order = np.argsort(here)
            for leaf, part in route(tree.value, here, radius):
                at = order[np.searchsorted(here, part, sorter=order)]
                columns = np.full(len(part), leaf, np.int32), part.view(np.int64), low[at], high[at]
                yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), names=["leaf", "fp", "low", "high"])

    def pair(shard: pa.Table) -> pa.Table:
        fp, low, high = (shard.column(c).to_numpy() for c in ("fp", "low", "high"))
        a, b = close_pairs(fp.view(np.uint64), low, high, radius)
        return pa.table({"a": fp[a], "b": fp[b]})

    dealt = classes.select("fp", "low", "high").mapInArrow(deal, "leaf int, fp bigint, low bigint, high bigint")
    pairs = dealt.groupBy("leaf").applyInArrow(pair, "a bigint, b bigint")
    return pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def linked(classes: DataFrame, radius: int, *, per_shard: int = 60_000, sample: int = 65_536) -> DataFrame:
    """Links (a, b) that join all fingerprints within ``radius`` bits; ``classes`` (fp) holds each once."""
    tree = shard_tree(classes, radius, per_shard, sample)

    def deal(batches):
        for batch in batches:
            here = batch.column(0).to_numpy().astype(np.int64).view(np.uint64)
            for leaf, part in route(tree.value, here, radius):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(part), leaf, np.int32)), pa.array(part.view(np.int64))], names=["leaf", "fp"])

    def link(shard: pa.Table) -> pa.Table:
        here = np.unique(shard.column("fp").to_numpy()).view(np.uint64)
        root = link_locally(here, radius)
        moved = np.flatnonzero(root != np.arange(len(here)))
        return pa.table({"a": here[moved].view(np.int64), "b": here[root[moved]].view(np.int64)})

    dealt = classes.select("fp").mapInArrow(deal, "leaf int, fp bigint")
    return dealt.groupBy("leaf").applyInArrow(link, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, *, words: int = 3, radius: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    folder = new_folder(spark, "simhash")
    rows = written(fingerprints(docs, words), f"{folder}/rows")
    classes = written(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), f"{folder}/classes")
    roots = connected(linked(classes, radius))
    rooted = classes.join(roots, classes.fp == roots.node, "left").select(
        "fp", "first_id", F.coalesce("root", "fp").alias("root"))
    rooted = written(rooted, f"{folder}/rooted")
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    of_class = rooted.join(least, "root").select("fp", "component_id")
    result = rows.join(of_class, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
    result = written(result, new_folder(spark, "simhash-rows"))
    remove(spark, folder)
    return result
