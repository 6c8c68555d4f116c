import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import learned_partitions
from tidemark.llm.learned_partitions import balanced_parts, nearest, neighbour_graph, search

VECTORS = "vec_id bigint, embedding array<float>, label int"


def brute(rows, queries, k=10):
    good = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v):
            good.setdefault((i, tuple(v)), np.array(v, np.float32).astype(float))
    items = [(i, v) for (i, _), v in good.items()]
    out = []
    for q, v in items:
        if q in queries:
            far = sorted((float(np.sqrt(((w - v) ** 2).sum())), i) for i, w in items if i != q)[:k]
            out += [(q, n, i, s) for n, (s, i) in enumerate(far, 1)]
    return sorted(out)


def found(df):
    return sorted((r.query_id, r.rank, r.vec_id, r.score) for r in df.collect())


def test_recall_on_the_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, list(r.embedding)) for r in table.collect()]
    want = brute(rows, {i for i, _ in rows if i % 100 == 0})
    got = found(search(table, table.where("vec_id % 100 = 0")))
    assert len(got) == len(want)
    hits = {(q, i) for q, _, i, _ in got} & {(q, i) for q, _, i, _ in want}
    assert len(hits) >= 0.9 * len(want)
    score = {(q, i): s for q, _, i, s in want}
    assert all(score[q, i] == pytest.approx(s, rel=1e-12) for q, _, i, s in got if (q, i) in score)


def test_exact_when_all_parts_are_probed(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=6)]) for i in range(900)]
    rows += [(1000 + i, rows[5][1]) for i in range(300)] + [(2000 + i, rows[7][1]) for i in range(4)]  # ties
    odd = [(3000, None), (3001, [0.0] * 6), (3002, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (3003, [math.nan] * 6), (3004, [math.inf] + [1.0] * 5),
           (3005, [1.0]), (3006, []), (None, [1.0] * 6)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows + odd + rows[:3]], VECTORS).repartition(5)
    got = found(search(df, df.where("vec_id % 50 = 0 OR vec_id IS NULL"), probes=16))
    want = brute(rows, {i for i, _ in rows if i % 50 == 0})
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert [g[3] for g in got] == pytest.approx([w[3] for w in want], rel=1e-12)


def test_an_id_with_several_vectors(spark, monkeypatch):
    monkeypatch.setattr(learned_partitions, "QUERIES_PER_GROUP", 3)
    rng = np.random.default_rng(6)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=3)]) for i in [*range(60), *[100] * 8, *[200] * 20]]
    rows += [(300, rows[62][1]), (7, rows[63][1])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], VECTORS).withColumn("query", F.lit(1)).withColumn("v", F.lit("x"))
    got = found(search(df, df.where("vec_id % 100 = 0"), probes=16))
    want = brute(rows, {0, 100, 200, 300})
    assert [g[:3] for g in got] == [w[:3] for w in want] and len(got) == 300
    assert [g[3] for g in got] == pytest.approx([w[3] for w in want], rel=1e-12)


def test_few_rows(spark):
    df = spark.createDataFrame([(100, [1.0, 0.0], 0), (3, [0.0, 1.0], 0), (4, [0.0, 1.0], 0)], VECTORS)
    assert [(r[0], r[1], r[2]) for r in found(search(df, df))] == [
        (3, 1, 4), (3, 2, 100), (4, 1, 3), (4, 2, 100), (100, 1, 3), (100, 2, 4)]
    assert search(df.limit(0), df.limit(0)).count() == 0


def test_parts_are_balanced_and_cut_few_edges():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(i * 8, 1, (100, 4)) for i in range(8)])
    graph = neighbour_graph(x, 5)
    part = balanced_parts(graph, 3)
    assert np.bincount(part).tolist() == [100] * 8
    assert (part[graph] == part[:, None]).mean() > 0.9


def test_nearest_breaks_ties_by_id():
    (ids, far), = nearest(np.zeros((1, 2)), np.array([-1]), np.array([[3.0, 4.0], [4.0, 3.0], [0.0, 1.0]]), [[9, 12], [2], [7]], 3)
    assert ids.tolist() == [7, 2, 9] and far.tolist() == [1.0, 5.0, 5.0]
