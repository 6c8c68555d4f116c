import math
import re
import zlib
from collections import Counter

import pytest

from tidemark.llm.backoff_automaton import score_documents

PRIOR = 200.0


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + [None]


def held_out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 1


def brute(pairs):
    c, c2 = Counter(), Counter()
    for i, text in pairs:
        if not held_out(i):
            ts = tokens(text)
            c.update(ts)
            c2.update(zip(ts, ts[1:]))
    n, v = sum(c.values()), len(c)
    p = lambda w: (c[w] + .5) / (n + .5 * (v + 1))
    rows = []
    for i, text in pairs:
        ts, score = tokens(text), 0.0
        for before, w in zip(["\0", *ts], ts):
            score += math.log10((c2[before, w] + PRIOR * p(w)) / (c[before] + PRIOR) if c[before] else p(w))
        rows.append((i, held_out(i), len(ts), sum(c[w] > 0 for w in ts), n,
                     sum(math.log10(p(w)) for w in ts), score))
    return rows


def key(row):
    return (row[0] is not None, row[0] or 0, row[2], row[6])


def same(got, want):
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    for a, b in zip(got, want):
        assert a[5:] == pytest.approx(b[5:], rel=1e-9)


def test_equals_brute_force(spark, documents, prose):
    texts = [prose(i, 3 + 7 * i) for i in range(40)]
    texts += ["", None, " \t\n", "É é İ", "word " * 900, texts[3], texts[3], "never seen\x0bbefore"]
    ids = [*range(len(texts) - 3), 3, 3, None]
    same(score_documents(documents(*texts, ids=ids).repartition(3)).collect(), brute(list(zip(ids, texts))))


def test_nothing_to_learn_and_no_rows(spark, documents):
    only = next(i for i in range(99) if held_out(i))
    row = score_documents(documents("a b", ids=[only])).first()
    assert (row.score, row.base_score, row.train_tokens, row.n_known) == (0.0, 0.0, 0, 0)
    assert score_documents(documents("a").limit(0)).count() == 0


def test_weights_of_a_state_sum_to_one():
    import numpy as np

    from tidemark.llm.backoff_automaton import BackoffAutomaton

    counts = np.array([3.0, 5.0, 2.0])
    pairs, n = np.array([3, 5]), np.array([2.0, 3.0])  # after word 1: words 0 and 2
    a = BackoffAutomaton(counts, pairs, n, 10, 3, 4.0)
    steps = [a.traverse(np.array([1, w]), np.array([0]))[1] for w in range(3)]
    unknown = math.log10(0.5 / (10 + 0.5 * 4)) + a.failure[1]
    assert sum(10 ** s for s in [*steps, unknown]) == pytest.approx(1.0)
