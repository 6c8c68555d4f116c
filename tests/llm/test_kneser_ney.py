import math
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm.kneser_ney import classify_quality, discounts, log_probabilities


def words(text):
    return (text or "").lower().split() + [""]


def brute(train, texts):
    """Interpolated modified Kneser-Ney, straight from its definition."""
    c = Counter(p for t in train for p in zip(words(t), words(t)[1:]))
    kinds = Counter(v for _, v in c)
    d = discounts(*[sum(x == n for x in c.values()) for n in (1, 2, 3, 4)])
    b = discounts(*[sum(x == n for x in kinds.values()) for n in (1, 2, 3, 4)])
    total = sum(kinds.values())
    floor = sum(b[min(x, 3) - 1] for x in kinds.values()) / total / (len(kinds) + 1)
    after = defaultdict(Counter)
    for (u, v), n in c.items():
        after[u][v] = n

    def lower(v):
        return (kinds[v] - b[min(kinds[v], 3) - 1]) / total + floor if kinds[v] else floor

    def p(u, v):
        if not after[u]:
            return lower(v)
        n = sum(after[u].values())
        gamma = sum(d[min(x, 3) - 1] for x in after[u].values()) / n
        x = after[u][v]
        return (x - d[min(x, 3) - 1] if x else 0) / n + gamma * lower(v)

    return [math.log(lower(words(t)[0])) + sum(math.log(p(u, v)) for u, v in zip(words(t), words(t)[1:])) for t in texts]


def test_equals_the_definition(spark, documents, prose):
    train = [prose(i, 60, 90) for i in range(30)] + ["", None, "one"]
    texts = train[:6] + [prose(99, 50, 120), "unseen words only", "", None, "alpha1 " * 300]
    docs = documents(*texts).withColumn("key", F.col("doc_id"))
    got = log_probabilities(docs.repartition(3), documents(*train)).orderBy("doc_id").collect()
    assert [r.log_prob for r in got] == pytest.approx(brute(train, texts), rel=1e-5)
    assert [r.n_tokens for r in got] == [len(words(t)) for t in texts]


def test_junk_goes_and_clean_text_stays(spark, documents, prose):
    clean = [prose(i, 80, 60) for i in range(200)]
    junk = [" ".join(f"{w}###" for w in prose(i, 40).split()) for i in range(10)]
    docs = documents(*clean, *junk, None, "", clean[0], ids=[*range(210), None, 211, 0])
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 200)] + [(200, 0, 0), (5, 0, 0), (None, 1, 0)],
                                   "doc_id bigint, quality int, toxic int")
    rows = classify_quality(docs, labels, quantile=0.995).collect()
    assert len(rows) == 212  # the repeated row shares one judgement
    keep = {r.doc_id: r.keep for r in rows}
    assert sum(not keep[i] for i in range(200)) <= 3 and not any(keep[i] for i in range(200, 210))
    assert keep[None] and keep[211]


def test_reference_is_every_trusted_document_outside_the_training_sample(spark, documents, prose):
    texts = [prose(i, 60, 60) for i in range(40)]
    ids = "doc_id bigint, quality int, toxic int"
    labels = spark.createDataFrame([(i, 1, 0) for i in range(2000)], ids)  # most ids are of no document
    hashed = spark.range(40).select("id", F.xxhash64("id").alias("h")).where("pmod(h, 2) = 0").orderBy("h").collect()
    sample = [r.id for r in hashed[:5]]
    rows = classify_quality(documents(*texts), labels, quantile=1.0, max_training_docs=5, pull=0.0).collect()
    got = {r.doc_id: math.log(r.perplexity) for r in rows}
    want = brute([texts[i] for i in sample], texts)
    assert [got[i] for i in range(40)] == pytest.approx([-p / 61 for p in want], rel=1e-4)
    top = max(p for i, p in got.items() if i not in sample)
    assert {round(math.log(r.threshold), 6) for r in rows} == {round(top, 6)}
    assert all(r.keep for r in rows)


def test_every_trusted_document_of_the_half_is_counted(spark, documents, prose):
    """The model used to stop at 20,000 documents."""
    texts = [prose(i % 400, 3) for i in range(41_500)]
    labels = spark.range(41_500).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    half = [r.id for r in spark.range(41_500).where(F.pmod(F.xxhash64("id"), F.lit(2)) == 0).collect()]
    assert len(half) > 20_000
    rows = classify_quality(documents(*texts), labels, pull=0.0).where("doc_id < 400").collect()
    want = brute([texts[i] for i in half], texts[:400])
    assert {r.doc_id: math.log(r.perplexity) for r in rows} == pytest.approx({i: -p / 4 for i, p in enumerate(want)}, rel=1e-5)


def test_all_documents_meet_each_shard_of_the_model_once(spark, documents, prose, monkeypatch):
    """Reading used to grow with blocks times shards."""
    from tidemark.llm import kneser_ney, ngram_blocks

    monkeypatch.setattr(kneser_ney, "KEYS_PER_SHARD", 500)
    train = [prose(i, 60, 90) for i in range(30)]
    texts = [prose(i, 50, 120) for i in range(60)]
    docs = documents(*texts).withColumn("key", F.xxhash64("doc_id"))
    got = log_probabilities(docs.repartition(5), documents(*train)).orderBy("doc_id").collect()
    assert [r.log_prob for r in got] == pytest.approx(brute(train, texts), rel=1e-5)
    reads = spark.sparkContext.accumulator(0)
    shard = kneser_ney.Model.shard

    def counted(self, number):
        reads.add(1)
        return shard(self, number)

    monkeypatch.setattr(kneser_ney.Model, "shard", counted)
    join = kneser_ney.look_up(kneser_ney.Model("file:/nowhere", 7, 0.1))
    blocks = ngram_blocks.token_blocks(docs.repartition(5), ["doc_id", "key"], tokens_per_block=200)
    asked = [r.asDict() for r in ngram_blocks.questions(blocks, 7).where("shard = 3").collect()]
    assert len(asked) > 5
    assert join(pa.Table.from_pylist(asked)).num_rows == len(asked) and reads.value == 1


def test_without_labels_or_rows(spark, documents):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert classify_quality(documents("a b", None), labels).where("keep").count() == 2
    assert classify_quality(documents("a").limit(0), labels).count() == 0
