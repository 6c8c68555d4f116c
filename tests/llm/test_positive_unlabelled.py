import random
import zlib

import numpy as np
import pytest

from tidemark.llm.positive_unlabelled import (
    document_features, features_of, fit, operating_point, risk_and_slopes, score_toxicity, words_of)

RUDE = ["grumbo", "snarlik", "vextro"]
STEMS = "ka lo mi ru ta ne so vi pe du".split()


def sentence(rng, rude):
    words = ["".join(rng.choice(STEMS) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(20, 60))]
    for _ in range(rng.randrange(1, 4) if rude else 0):
        words[rng.randrange(len(words))] = rng.choice(RUDE) + rng.choice(["", "en", "s"])
    return " ".join(words).capitalize()


@pytest.fixture(scope="module")
def world(spark):
    """1,500 documents, an eighth of them toxic; half are labelled, and some toxic ones only wait to be found."""
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(1500):
        rude = rng.random() < 0.125
        rows.append((i, sentence(rng, rude), rude))
        if rng.random() < 0.5:
            labels.append((i, 1, int(rude)))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t, _ in rows],
                                 "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(4)
    return docs, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"), {i: r for i, _, r in rows}


def test_held_out_accuracy(world):
    docs, labels, truth = world
    rows = score_toxicity(docs, labels).collect()
    assert sorted(r.doc_id for r in rows) == list(range(1500))
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    held = [r for r in rows if r.held_out]
    caught = [r.predicted for r in held if truth[r.doc_id]]
    wrong = [r.predicted for r in held if not truth[r.doc_id]]
    assert np.mean(caught) > 0.9 and np.mean(wrong) < 0.03


def test_labels_of_the_held_out_fold_change_nothing(world):
    from pyspark.sql import functions as F

    docs, labels, _ = world
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    turned = labels.withColumn("toxic", F.when(fold, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    first, second = ({r.doc_id: r.score for r in score_toxicity(docs, x).collect()} for x in (labels, turned))
    assert first == second


def test_slopes_are_those_of_the_risk():
    rng = np.random.default_rng(1)
    for prior in (0.1, 0.6):
        zp, zu = rng.normal(1, 1, 7), rng.normal(0.5, 1, 9)
        risk, by_p, by_u = risk_and_slopes(zp, zu, prior)
        if np.log1p(np.exp(zu)).mean() < prior * np.log1p(np.exp(zp)).mean():
            continue
        for z, slope, other in ((zp, by_p, lambda x: (x, zu)), (zu, by_u, lambda x: (zp, x))):
            for i in range(len(z)):
                moved = z.copy()
                moved[i] += 1e-6
                assert (risk_and_slopes(*other(moved), prior)[0] - risk) / 1e-6 == pytest.approx(slope[i], abs=1e-5)


def test_a_negative_part_below_zero_turns_round():
    risk, by_p, by_u = risk_and_slopes(np.full(3, 9.0), np.full(3, -9.0), 0.3)
    assert risk == pytest.approx(0.3 * np.log1p(np.exp(-9.0))) and (by_p > 0).all() and (by_u < 0).all()


def test_the_threshold_has_the_least_estimated_error():
    positive, unlabelled = np.array([3.0, 4.0, 5.0]), np.array([0.0] * 8 + [3.5, 4.5])
    threshold, slope = operating_point(positive, unlabelled, 0.2)
    assert 0 < threshold < 3 and slope > 0


def test_words_and_beginnings():
    assert words_of("Ab-ab ÉB x9y") == {b"ab", "Éb".encode(), b"x", b"y"}
    assert len(features_of(b"grumbo")) == 3 and len(features_of("éé".encode())) == 1
    assert len(document_features("aa aa aa")) == 1 and len(document_features("")) == 0


def test_fit_without_informative_features():
    rows = [np.array([i % 5], np.int32) for i in range(50)]
    model = fit(rows, rows, 0.2)
    assert not model.weights.any() and np.isfinite(model.intercept)


def test_edge_rows(spark, world):
    from pyspark.sql import functions as F

    docs, labels, _ = world
    odd = spark.createDataFrame([(None, "grumbo"), (5001, None), (5002, ""), (5003, "x " * 300_000), (5004, "grumbo"), (5004, "grumbo")],
                                "doc_id bigint, text string")
    both = docs.select("doc_id", "text").unionByName(odd).withColumn("score", F.lit("x")).withColumn("key", F.lit(1))
    noisy = labels.unionByName(spark.createDataFrame([(None, 1, 1), (5002, None, None), (9999, 1, 1)], labels.schema))
    rows = [r for r in score_toxicity(both, noisy).collect() if r.doc_id is None or r.doc_id > 5000]
    assert len(rows) == 6 and all(0 <= r.score <= 1 for r in rows)
    scores = [r.score for r in rows if r.doc_id == 5004]
    assert scores[0] == scores[1] and [r.held_out for r in rows if r.doc_id is None] == [False]
    assert score_toxicity(docs.limit(0), labels).collect() == []
    assert {r.score for r in score_toxicity(docs, labels.limit(0)).collect()} == {0.0}
