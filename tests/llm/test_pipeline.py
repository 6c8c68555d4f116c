import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import near_copies
from tidemark.llm.near_copies import drop_near_copies


def shingles(text, n=5):
    ws = re.sub("[A-Z]", lambda m: m[0].lower(), text or "").split()
    return {tuple(ws[i:i + n]) for i in range(max(1, len(ws) - n + 1))}


def similar(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) >= 0.8 * len(a | b)


def changed(rng, text, share):
    ws = text.split()
    for i in rng.sample(range(len(ws)), max(1, int(share * len(ws)))):
        ws[i] = f"new{rng.randrange(10**6)}"
    return " ".join(ws)


def test_one_row_of_each_class_stays(spark, documents, prose):
    rng = random.Random(6)
    passage = prose(500, 70)
    texts = [prose(i, rng.randrange(30, 300)) for i in range(50)]
    texts += [passage + " " + prose(600 + i, 120) for i in range(30)]  # a shared passage is no copy
    for base in texts[:20]:
        texts += [changed(rng, base, 0.01), base.upper().replace(" ", "\n")]
    big = prose(900, 250)
    texts += [changed(rng, big, 0.008) for _ in range(60)] + [big] * 40
    texts += ["", None, " ", "one two", "One two", "one three"]
    order = list(range(len(texts)))
    rng.shuffle(order)
    docs = documents(*[texts[i] for i in order], ids=order)
    kept = {r.doc_id for r in drop_near_copies(docs.repartition(4)).collect()}
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if similar(texts[i], texts[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    assert kept == {find(i) for i in range(len(texts))}


def classes_of(texts):
    """The least index of each class, by all pairs."""
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if len(a & b) >= 0.8 * len(a | b):
                a_root, b_root = sorted((find(i), find(j)))
                root[b_root] = a_root
    return {find(i) for i in range(len(texts))}


def test_versions_of_versions_are_one_class(spark, documents, prose, monkeypatch):
    rng = random.Random(8)
    chain, copies, base = [prose(700, 250, 6000)], [prose(701, 250, 6000)], prose(702, 250, 6000)
    while len(chain) < 150:
        chain.append(changed(rng, chain[-1], 0.015))
        copies.append(changed(rng, rng.choice(copies[-12:]), 0.015))
    texts = chain + copies + [changed(rng, base, rng.choice((0.008, 0.012))) for _ in range(150)]  # the base itself is absent
    want = classes_of(texts)
    assert len(want) < 10
    order = list(range(len(texts)))
    rng.shuffle(order)
    docs = documents(*[texts[i] for i in order], ids=order).repartition(3)
    for size in (1_000, 40):  # one block a key, and many
        monkeypatch.setattr(near_copies, "BLOCK_ROWS", size, raising=False)
        assert {r.doc_id for r in drop_near_copies(docs).collect()} == want


def test_rarest_shingles_find_every_similar_pair(spark, prose, tmp_path, monkeypatch):
    """Documents of one passage and own words, copies with edits, short texts: all similar pairs are candidates, few others are."""
    rng, passage = random.Random(12), prose(800, 150, 6000)
    texts = [passage + " " + " ".join(f"own{i}x{j}" for j in range(50)) for i in range(60)]  # similarity 0.58
    for i in range(8):
        base = prose(810 + i, rng.choice((20, 90, 400)), 6000)
        texts += [changed(rng, base, rng.choice((0.005, 0.01, 0.02, 0.04))) for _ in range(12)]
    texts += ["a b c d e f", "a b c d e g", "a b c d e f h", "one two"]
    sets = [shingles(t) for t in texts]
    want = {(a, b) for a in range(len(texts)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    rows = [(i, t, len(s), i) for i, (t, s) in enumerate(zip(texts, sets))]
    frame = spark.createDataFrame(rows, "content bigint, text string, size int, root bigint").repartition(3)
    folder = f"file://{tmp_path}"
    begun = near_copies.rare_beginnings(frame.select("content", "text"), frame, 5, 0.8, folder)
    for size in (1_000, 7):
        monkeypatch.setattr(near_copies, "BLOCK_ROWS", size)
        pairs = near_copies.open_pairs(begun, frame.select("content", "root"), 0.8, False, f"{folder}/all{size}").collect()
        got = {(r.a, r.b) for r in pairs}
        assert want <= got and len(got) == len(pairs) < 2 * len(want) < 600  # of 13,000 pairs
        assert not any(a < 60 for a, b in got)  # what all share is not rare
    one = near_copies.open_pairs(begun, frame.select("content", "root"), 0.8, True, f"{folder}/likest")
    assert one.count() <= 4 * len(texts) and {(r.a, r.b) for r in one.collect()} <= got


def test_fingerprint_pairs_are_neighbours(spark):
    """B and C are near, and so are A and B, but A and C are not; D has the fingerprint of B."""
    rows = [(1, 0b0, 9, 1), (2, 0b111, 10, 2), (3, 0b111111, 10, 3), (4, 0b111, 10, 4), (5, 0b111, 40, 5), (6, 0b111, 10, 2)]
    rooted = spark.createDataFrame(rows, "content bigint, fp bigint, size int, root bigint")
    got = sorted(tuple(sorted(r)) for r in near_copies.fingerprint_pairs(rooted, 3, 0.8).collect())
    assert got == [(1, 2), (1, 4), (1, 6), (2, 3), (2, 4), (3, 4), (3, 6), (4, 6)]


def test_neighbours_need_no_common_least_hash(spark, documents, prose, monkeypatch):
    monkeypatch.setattr(near_copies, "COMMON_SHARE", 2.0)  # no pair is likely
    text = prose(5, 4000, 6000)
    docs = documents(text, text + " end", prose(6, 4000, 6000), "start " + text, None)
    assert sorted(r.doc_id for r in drop_near_copies(docs).collect()) == [0, 2, 4]


def test_repeated_rows_and_odd_columns(spark, documents):
    docs = documents("a b c d e f", "a b c d e f", None, "x y", ids=[7, 7, None, None])
    docs = docs.withColumn("content", F.lit(1)).withColumn("h", F.lit("t")).withColumn("fp", F.lit(None).cast("string"))
    rows = drop_near_copies(docs).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in rows) == [(0, ""), (0, "x y"), (7, "a b c d e f")]
    assert rows[0].content == 1 and drop_near_copies(docs.limit(0)).count() == 0


@pytest.fixture(scope="module")
def stages(spark):
    """Each stage's name, input and output on the small tables."""
    sf = "/root/testdata/sf0.001"
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    from tidemark.llm.common import new_folder, written

    for name, stage in corpus_pipeline.STAGES:
        after = written(stage(spark, docs, sf), new_folder(spark, "test-stage"))
        out.append((name, docs, after))
        docs = after
    return out


def test_stages_keep_columns_and_rows(stages):
    for name, before, after in stages[:-1]:
        assert after.columns == before.columns, name
        assert 0.5 * before.count() < after.count() <= before.count()
        assert after.exceptAll(before).count() == 0
    name, before, after = stages[-1]
    assert after.count() == before.count() and after.where("NOT round_trip").count() == 0


def test_columns_named_like_those_of_the_stages_stay(spark, stages):
    odd = ["spans", "n_words", "contaminated", "cleaned", "__key", "__rows", "key", "rows", "keep", "row", "block"]
    docs = stages[0][1].limit(60)
    marked = docs.select("*", *[F.concat(F.lit(f"{c} "), F.col("doc_id").cast("string")).alias(c) for c in odd])
    for name, stage in corpus_pipeline.STAGES[:3]:
        after = stage(spark, marked, "/root/testdata/sf0.001")
        assert after.columns == marked.columns, name
        rows = after.collect()
        assert rows and all(r[c] == f"{c} {r.doc_id}" for r in rows for c in odd)


def test_near_copies_of_the_table(stages):
    _, before, after = stages[1]
    rows = sorted((r.doc_id, r.text) for r in before.collect())
    kept = {r.doc_id for r in after.collect()}
    for i, a in rows:
        if i not in kept:
            assert any(similar(a, b) for j, b in rows if j != i)
    left = [t for i, t in rows if i in kept]
    assert not any(similar(a, b) for n, a in enumerate(left) for b in left[:n])


def test_run(spark, stages):
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert sorted(r.ids_crc32 for r in got.collect()) == sorted(r.ids_crc32 for r in stages[-1][2].collect())
