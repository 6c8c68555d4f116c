import random

import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho".split()
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def documents(spark):
    """Documents from texts, ids from 0; with the columns of the table."""

    def build(*texts, ids=None):
        rows = [(i, t, "en", "s", None if t is None else len(t))
                for i, t in zip(ids or range(len(texts)), texts)]
        return spark.createDataFrame(rows, DOCS)

    return build


@pytest.fixture(scope="session")
def prose():
    def build(seed, n, vocabulary=400):
        rng = random.Random(seed)
        return " ".join(rng.choice(WORDS) + str(rng.randrange(vocabulary // 17)) for _ in range(n))

    return build
