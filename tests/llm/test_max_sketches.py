import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import max_sketches
from tidemark.llm.max_sketches import build_index, rank_documents, search_index, sketch_of, width_for
from tidemark.llm.common import new_folder

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k=10):
    """The contract by plain loops: (item_id, rank, doc_id, score)."""
    held = [(d, terms(t)) for d, t in docs]
    held = [(d, ts) for d, ts in held if ts]
    n_docs, n_all, df = len(held), sum(len(ts) for _, ts in held), {}
    for _, ts in held:
        for t in set(ts):
            df[t] = df.get(t, 0) + 1
    out = []
    for item, text in items:
        found = []
        for d, ts in held:
            m = 100 - 90 + (90 * len(ts) * n_docs) // n_all
            s = 0
            for t in set(terms(text)) & set(ts):
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                s += w * ((1000000000 * ts.count(t)) // (1000 * ts.count(t) + 8 * m))
            if s > 0:
                found.append((-s, d is None, d or 0, d))
        for rank, (s, _, _, d) in enumerate(sorted(found)[:k], 1):
            out.append((item, rank, d, -s))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def items(spark):
    def build(*rows):
        return spark.createDataFrame(list(rows), "item_id bigint, text string")

    return build


def rows_of(frame):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in frame.collect()), key=str)


def random_texts(seed, count, words, longest):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(words)] + ["É", "日本", "9", "Ab"]
    return [rng.choice([" ", "-", "_\n"]).join(vocabulary[min(int(rng.expovariate(6 / words)), len(vocabulary) - 1)]
                                              for _ in range(rng.randrange(longest))) for _ in range(count)]


@pytest.mark.parametrize("seed, words, longest", [(1, 30, 12), (2, 400, 60), (3, 3000, 300)])
def test_equal_to_brute_force(documents, items, seed, words, longest):
    made = random_texts(seed, 300, words, longest) + [None, "", "...", "w1 w1 w2", "w1 w1 w2"] + ["w3 w4"] * 40
    asked = [(i, t) for i, t in enumerate(random_texts(seed + 9, 25, words, 20))] + [(3, "w1 w2 w1"), (None, "w5"), (99, None), (98, "unheard")]
    found = rank_documents(documents(*made).repartition(5), items(*asked))
    assert rows_of(found) == brute(list(enumerate(made)), asked)


def test_many_blocks_of_items_and_small_slices(documents, items, monkeypatch):
    monkeypatch.setattr(max_sketches, "ITEMS_PER_BLOCK", 4)
    monkeypatch.setattr(max_sketches, "MOST_WIDTH", 64)
    made = random_texts(5, 200, 200, 120)
    asked = list(enumerate(random_texts(6, 30, 200, 15)))
    assert rows_of(rank_documents(documents(*made), items(*asked))) == brute(list(enumerate(made)), asked)


def test_repeated_and_null_ids(documents, items):
    made, ids = ["a b", "a b", "a", "b c", "a c"], [4, 4, None, 0, 2]
    asked = [(1, "a b"), (1, "a b"), (1, "c")]
    assert rows_of(rank_documents(documents(*made, ids=ids), items(*asked))) == brute(list(zip(ids, made)), asked)


def test_more_than_255_occurrences(documents, items):
    made = ["a " * n + "b " * 500 for n in (100, 254, 255, 256, 300, 2000)] + ["c"] * 30
    assert rows_of(rank_documents(documents(*made), items((0, "a"), (1, "a c")))) == brute(list(enumerate(made)), [(0, "a"), (1, "a c")])


def test_a_sketch_holds_the_greatest_of_each_coordinate():
    names = [f"t{i}".encode() for i in range(500)]
    sketch = np.frombuffer(sketch_of(names, range(1, 501)), np.uint8)
    assert len(sketch) == width_for(500) == 2048
    for name, tf in zip(names, range(1, 501)):
        assert sketch[max_sketches.coordinate(name) & 2047] >= min(tf, 255)


def test_bounds_spare_most_rescoring(spark, documents, items, monkeypatch):
    """Of documents that share few words with an item, few are scored exactly."""
    made = random_texts(8, 600, 5000, 80)
    made[77] += " " + " ".join(f"rare{i}" for i in range(8))
    wanted = " ".join([*(f"rare{i}" for i in range(8)), *made[5].split()[:3]])
    index = build_index(documents(*made), new_folder(spark, "test-index"))
    assert rows_of(search_index(index, items((0, wanted)))) == brute(list(enumerate(made)), [(0, wanted)])
    size = index.selectExpr("count(*)", "sum(n)").first()
    batch = index.select("doc_id", "n", "terms", "tfs", "sketch").toArrow().combine_chunks().to_batches()[0]
    df = {t: sum(t in r.terms for r in index.select("terms").collect()) for t in set(terms(wanted))}
    weights = [math.floor(1000 * math.log((2 * size[0] + 2) / (2 * df[t] + 1))) for t in df]
    block = max_sketches.QueryBlock(pa.table({"item": [0] * len(df), "term": list(df), "weight": weights}))
    part = max_sketches.IndexSlice(batch, size[0], size[1])
    asked = []
    exact = max_sketches.Entries.scores
    monkeypatch.setattr(max_sketches.Entries, "scores", lambda self, rows, terms: asked.append(len(rows)) or exact(self, rows, terms))
    block.search(part, 1)
    assert block.best[0][1].tolist() == [77] and sum(asked) < 60


def test_empty_tables_and_clashing_columns(documents, items):
    from pyspark.sql import functions as F

    assert rank_documents(documents("a").limit(0), items((1, "a"))).collect() == []
    assert rank_documents(documents("a"), items((1, "a")).limit(0)).collect() == []
    clash = documents("a b", "c", "d").withColumn("n", F.lit("x")).withColumn("sketch", F.lit(1)).withColumn("item", F.lit(1))
    asked = items((1, "a")).withColumn("rank", F.lit(5)).withColumn("item", F.lit(5))
    assert [(r.doc_id, r["rank"]) for r in rank_documents(clash, asked).collect()] == [(0, 1)]
