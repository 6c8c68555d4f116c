"""Approximate nearest neighbours through learned partitions.

A neighbour graph over a bounded sample of the vectors (``max_sample``) is cut into balanced parts with few edges
between them; a small network learns to tell a vector's parts from the parts of its graph neighbours. It then
gives every vector its most probable part, and sends each query to its ``probes`` most probable
parts, whose vectors are all compared exactly in double precision.

Equal vectors are one entry with their ``k + 1`` least ids, which is all that a result of ``k`` other rows can
name, so a vector that fills a third of the table is compared once. Parts are dealt over
salted groups of bounded size and queries over blocks; a query visits all salts of a part, and a row all blocks.

Edge cases: vectors that are null, zero, of another length than most of the sample, or hold null or
non-finite components take no part, nor do rows without an id; rows that repeat id and vector count once; rows
with the query's id are its own, whatever their vectors, and a query id with several vectors is a query for each; with ``k`` or fewer candidates all of them that the probed parts hold are returned, and a sample of at most
``least_per_part`` rows a part makes fewer parts; an empty table gives no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

NEIGHBOURS = 10
ROWS_PER_GROUP, QUERIES_PER_GROUP = 20_000, 4_096
CELLS_AT_ONCE = 4_000_000
FOUND = "query string, query_id bigint, vec_id bigint, score double"


def usable(table: DataFrame) -> DataFrame:
    """(vec_id, v) of the rows that take part, each once."""
    v = F.col("embedding").cast("array<double>")
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = table.select(F.col("vec_id").cast("bigint").alias("vec_id"), v.alias("v"))
    return rows.where(F.col("vec_id").isNotNull() & F.coalesce(good, F.lit(False)))


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """Each row's ``k`` nearest other rows."""
    k, norms, out = min(k, len(x) - 1), (x * x).sum(1), []
    for at in range(0, len(x), 512):
        part = x[at:at + 512]
        far = norms[None, :] - 2 * part @ x.T
        far[np.arange(len(part)), np.arange(at, at + len(part))] = np.inf
        out.append(np.argpartition(far, k - 1, axis=1)[:, :k])
    return np.concatenate(out)


def bisect(nodes: np.ndarray, edges: tuple[np.ndarray, np.ndarray], rng: np.random.Generator) -> np.ndarray:
    """Two halves of ``nodes`` (flags) with few edges between: a spectral order, then swaps that gain."""
    n = len(nodes)
    place = np.full(int(max(edges[0].max(), edges[1].max(), nodes.max())) + 1, -1)
    place[nodes] = np.arange(n)
    a, b = place[edges[0]], place[edges[1]]
    inside = (a >= 0) & (b >= 0)
    a, b = np.concatenate([a[inside], b[inside]]), np.concatenate([b[inside], a[inside]])
    degree = np.maximum(np.bincount(a, minlength=n), 1)
    value = rng.normal(size=n)
    for _ in range(60):  # power iteration on the lazy walk, without its constant vector
        value = 0.5 * value + 0.5 * np.bincount(a, weights=value[b], minlength=n) / degree
        value -= (value * degree).sum() / degree.sum()
        value /= np.linalg.norm(value) + 1e-12
    side = np.zeros(n, bool)
    side[np.argsort(value, kind="stable")[n // 2:]] = True
    for _ in range(8):
        across = np.bincount(a, weights=side[a] != side[b], minlength=n)
        gain = 2 * across - np.bincount(a, minlength=n)
        left, right = (np.flatnonzero(side == s) for s in (False, True))
        left, right = left[np.argsort(-gain[left])], right[np.argsort(-gain[right])]
        m = min(len(left), len(right))
        swap = int(np.count_nonzero(gain[left[:m]] + gain[right[:m]] > 0) * 0.5)
        if not swap:
            break
        side[left[:swap]], side[right[:swap]] = True, False
    return side


def balanced_parts(graph: np.ndarray, levels: int, seed: int = 1) -> np.ndarray:
    """Part number of each row of the graph, in ``2**levels`` parts of equal size."""
    rng = np.random.default_rng(seed)
    edges = np.repeat(np.arange(len(graph)), graph.shape[1]), graph.ravel()
    part = np.zeros(len(graph), np.int64)
    for _ in range(levels):
        following = np.empty_like(part)
        for p in np.unique(part):
            nodes = np.flatnonzero(part == p)
            following[nodes] = 2 * p + (bisect(nodes, edges, rng) if len(nodes) > 1 else 0)
        part = following
    return part


@dataclass
class Router:
    """A network with one hidden layer from vectors to log probabilities of parts."""

    mean: np.ndarray
    scale: float
    weights: list[np.ndarray]

    @classmethod
    def fit(cls, x: np.ndarray, targets: np.ndarray, *, hidden: int = 96, rounds: int = 30, batch: int = 128,
            rate: float = 0.004, seed: int = 2) -> Router:
        rng = np.random.default_rng(seed)
        router = cls(x.mean(0), float(x.std()) or 1.0, [
            rng.normal(0, math.sqrt(2 / x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden),
            rng.normal(0, math.sqrt(2 / hidden), (hidden, targets.shape[1])), np.zeros(targets.shape[1])])
        z = (x - router.mean) / router.scale
        first, second, step = [0.0] * 4, [0.0] * 4, 0
        steps = rounds * -(-len(x) // batch)
        for _ in range(rounds):
            order = rng.permutation(len(x))
            for at in range(0, len(x), batch):
                some = order[at:at + batch]
                w1, _, w2, _ = router.weights
                h, log_p = router._forward(z[some])
                error = (np.exp(log_p) - targets[some]) / len(some)
                back = (error @ w2.T) * (h > 0)
                step += 1
                for i, g in enumerate((z[some].T @ back, back.sum(0), h.T @ error, error.sum(0))):
                    first[i] = 0.9 * first[i] + 0.1 * g
                    second[i] = 0.99 * second[i] + 0.01 * g * g
                    move = first[i] / (1 - 0.9**step) / (np.sqrt(second[i] / (1 - 0.99**step)) + 1e-8)
                    router.weights[i] = router.weights[i] - rate * (1 - step / (steps + 1)) * move
        return router

    def _forward(self, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w1, b1, w2, b2 = self.weights
        h = np.maximum(z @ w1 + b1, 0)
        out = h @ w2 + b2
        out -= out.max(1, keepdims=True)
        return h, out - np.log(np.exp(out).sum(1, keepdims=True))

    def parts(self, x: np.ndarray, count: int) -> np.ndarray:
        """The ``count`` most probable parts of each vector, the best first."""
        log_p = self._forward((x - self.mean) / self.scale)[1]
        return np.argsort(-log_p, axis=1, kind="stable")[:, :count]


def train_router(x: np.ndarray, levels: int) -> Router:
    """Graph, parts and the network that predicts a vector's own part and its neighbours'."""
    graph = neighbour_graph(x, NEIGHBOURS)
    part = balanced_parts(graph, levels)
    targets = np.zeros((len(x), 2**levels))
    np.add.at(targets, (np.repeat(np.arange(len(x)), graph.shape[1]), part[graph].ravel()), 1.0)
    targets[np.arange(len(x)), part] += graph.shape[1]
    return Router.fit(x, targets / targets.sum(1, keepdims=True))


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def nearest(queries: np.ndarray, own: np.ndarray, vectors: np.ndarray, ids: list[list[int]], keep: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query the ``keep`` nearest ids but its ``own`` and their distances, ties to the smaller id."""
    counts = np.array(list(map(len, ids)))
    owner, flat = np.repeat(np.arange(len(ids)), counts), np.array([i for some in ids for i in some])
    # vectors that only one id has: out of the question for that id's queries
    alone = np.flatnonzero(counts == 1)
    alone = alone[np.argsort(flat[np.cumsum(counts) - counts][alone], kind="stable")]
    names = flat[np.cumsum(counts) - counts][alone]
    norms, out = (vectors * vectors).sum(1), []
    step = max(1, CELLS_AT_ONCE // max(1, len(vectors)))
    for at in range(0, len(queries), step):
        part, mine = queries[at:at + step], own[at:at + step]
        rough = norms[None, :] - 2 * part @ vectors.T + (part * part).sum(1)[:, None]
        for row, low, high in zip(rough, np.searchsorted(names, mine, "left"), np.searchsorted(names, mine, "right")):
            row[alone[low:high]] = np.inf
        if len(vectors) > keep:
            edge = np.partition(rough, keep - 1, axis=1)[:, keep - 1]
        else:
            edge = np.full(len(part), np.inf)
        slack = 1e-9 * (norms.max() + (part * part).sum(1))  # rounding of the expanded form
        for row, limit, q, i in zip(rough, edge + slack, part, mine):
            close = np.flatnonzero((row <= limit) & (row < np.inf))
            far = np.full(len(vectors), np.inf)
            far[close] = np.sqrt(((vectors[close] - q) ** 2).sum(1))
            entries = np.flatnonzero((far[owner] < np.inf) & (flat != i))
            order = np.lexsort((flat[entries], far[owner[entries]]))[:keep]
            out.append((flat[entries[order]], far[owner[entries[order]]]))
    return out


def search(table: DataFrame, queries: DataFrame, *, k: int = 10, levels: int = 4, probes: int = 13,
           max_sample: int = 6000, least_per_part: int = 64) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest rows of ``table`` for each row of ``queries``."""
    spark = table.sparkSession
    rows = usable(table).dropDuplicates(["vec_id", "v"])
    sample = rows.orderBy(F.xxhash64("vec_id", "v"), "vec_id").limit(max_sample).collect()
    lengths = [len(r.v) for r in sample]
    size = max(set(lengths), key=lambda n: (lengths.count(n), n)) if lengths else 0
    x = np.unique(np.array([r.v for r in sample if len(r.v) == size]).reshape(-1, max(size, 1)), axis=0)
    levels = max(0, min(levels, int(math.log2(max(1, len(x) / least_per_part)))))
    router = spark.sparkContext.broadcast(train_router(x, levels) if levels else None)
    probed = min(probes, 2**levels)

    least = Window.partitionBy("v").orderBy("vec_id")
    entries = (rows.where(F.size("v") == size).withColumn("n", F.row_number().over(least)).where(F.col("n") <= k + 1)
               .groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")))
    salts = max(1, -(-rows.count() // (ROWS_PER_GROUP * 2**levels)))
    # a query is named by its id and its vector, so several vectors of one id are several queries
    name = F.concat_ws(":", "vec_id", F.hex(F.xxhash64("v")))
    asked = (usable(queries).where(F.size("v") == size).dropDuplicates(["vec_id", "v"])
             .select("v", name.alias("query"), F.col("vec_id").alias("query_id")))
    blocks = max(1, -(-asked.count() // QUERIES_PER_GROUP))

    def place(count: int):
        def run(batches):
            for batch in batches:
                vectors = matrix(batch.column(0))
                parts = router.value.parts(vectors, count) if router.value else np.zeros((len(vectors), 1), np.int64)
                for column in parts.T:
                    part = pa.array(column.astype(np.int32))
                    yield pa.RecordBatch.from_arrays([part, *batch.columns], names=["part", *batch.schema.names])
        return run

    stored = entries.mapInArrow(place(1), "part int, v array<double>, ids array<bigint>").select(
        "*", F.pmod(F.xxhash64("v"), F.lit(salts)).cast("int").alias("salt"),
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    sent = asked.mapInArrow(place(probed), "part int, v array<double>, query string, query_id bigint").select(
        "*", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"),
        F.pmod(F.xxhash64("query"), F.lit(blocks)).cast("int").alias("block"))

    def compare(key, index: pa.Table, group: pa.Table) -> pa.Table:
        if not len(index) or not len(group):
            types = (pa.string(), pa.int64(), pa.int64(), pa.float64())
            return pa.table([pa.array([], t) for t in types], names=["query", "query_id", "vec_id", "score"])
        own = group.column("query_id").to_numpy()
        found = nearest(matrix(group.column("v")), own, matrix(index.column("v")), index.column("ids").to_pylist(), k)
        times = np.array([len(i) for i, _ in found])
        return pa.table({"query": group.column("query").take(pa.array(np.repeat(np.arange(len(own)), times))),
                         "query_id": np.repeat(own, times).astype(np.int64),
                         "vec_id": np.concatenate([i for i, _ in found]).astype(np.int64), "score": np.concatenate([s for _, s in found])})

    groups = ("part", "salt", "block")
    found = stored.groupBy(*groups).cogroup(sent.groupBy(*groups)).applyInArrow(compare, FOUND)
    best = Window.partitionBy("query").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
