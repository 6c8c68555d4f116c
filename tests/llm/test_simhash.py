import random
import re

import numpy as np
import xxhash

from tidemark.llm.components import connected
from tidemark.llm.simhash import fit_tree, link_locally, near_duplicates, neighbours, route


def brute_fingerprint(text, n=3):
    ws = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not ws:
        return 0
    shingles = [" ".join(ws[i:i + n]) for i in range(max(1, len(ws) - n + 1))]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_roots(values, near):
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if near(values[i], values[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(values))]


def noisy(rng, n, groups):
    """Fingerprints around few centres, with chains of close ones, and others anywhere."""
    centres = [rng.getrandbits(64) for _ in range(groups)]
    out = {rng.getrandbits(64) for _ in range(n)}
    for c in centres:
        for _ in range(n // groups):
            for b in rng.sample(range(64), rng.randrange(4)):
                c ^= 1 << b
            out.add(c)
    return np.array(sorted(out), np.uint64)


def test_local_links_equal_all_pairs():
    for seed in range(3):
        points = noisy(random.Random(seed), 700, 9)
        want = brute_roots([int(p) for p in points], lambda a, b: (a ^ b).bit_count() <= 3)
        assert link_locally(points, 3).tolist() == want


def test_every_close_pair_meets_in_a_shard():
    points = noisy(random.Random(5), 600, 20)
    leaves = [set(part.tolist()) for _, part in route(fit_tree(points, 6, 3), points, 3)]
    assert len(leaves) > 20
    values = [int(p) for p in points]
    for i, a in enumerate(values):
        for b in values[:i]:
            if (a ^ b).bit_count() <= 3:
                assert any(a in leaf and b in leaf for leaf in leaves)


def test_neighbours_are_all_close_pairs_of_different_classes(spark):
    rng = random.Random(3)
    points = [int(p) for p in noisy(rng, 1200, 6).view(np.int64)]
    low = [rng.randrange(3) for _ in points]
    high = [x if rng.random() < 0.8 else 3 for x in low]
    rows = spark.createDataFrame(list(zip(points, low, high)), "fp bigint, low bigint, high bigint")
    got = [tuple(r) for r in neighbours(rows.repartition(3), 3).collect()]
    close = lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count() <= 3
    want = {(max(a, b), min(a, b)) for i, a in enumerate(points) for j, b in enumerate(points[:i + 1])
            if close(a, b) and min(low[i], low[j]) != max(high[i], high[j])}
    assert len(got) == len(set(got)) and set(got) == want


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(60)] + [(200, 100 + i) for i in range(50)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(80)] + [(5, 5)]
    got = dict(connected(spark.createDataFrame(edges, "a bigint, b bigint")).collect())
    nodes = sorted({n for e in edges if e[0] != e[1] for n in e})
    known = {frozenset(e) for e in edges}
    roots = brute_roots(nodes, lambda a, b: frozenset((a, b)) in known)
    assert got == {n: nodes[r] for n, r in zip(nodes, roots)}


def test_documents_equal_brute_force(spark, documents, prose):
    rng = random.Random(4)
    texts = [prose(i, rng.randrange(1, 120)) for i in range(60)]
    for base in list(texts[:25]):
        ws = (base + " " + prose(77, 200)).split()
        for _ in range(3):
            copy = list(ws)
            copy[rng.randrange(len(ws))] = "changed"
            texts.append(" ".join(copy))
    texts += ["", None, " \n ", "ONE", "one", "É one two", texts[0].upper(), "w " * 8000]
    ids = [1000 - i for i in range(len(texts))]
    rows = sorted((r.doc_id, r.fingerprint, r.component_id) for r in near_duplicates(documents(*texts, ids=ids).repartition(3)).collect())
    fps = [brute_fingerprint(t) for t in texts]
    roots = brute_roots(fps, lambda a, b: (a ^ b).bit_count() <= 3)
    least = {r: min(i for i, x in zip(ids, roots) if x == r) for r in roots}
    assert rows == sorted((i, f"{f:016x}", least[r]) for i, f, r in zip(ids, fps, roots))


def test_odd_ids_and_no_rows(spark, documents):
    rows = near_duplicates(documents("a b c d", "a b c d", "a b c d", "x", ids=[None, 3, 3, None])).collect()
    assert sorted((r.doc_id is None, r.component_id) for r in rows if r.component_id) == [(False, 3), (False, 3), (True, 3)]
    assert len(rows) == 4
    assert near_duplicates(documents("a").limit(0)).count() == 0
