"""Toxicity by non-negative positive-unlabelled learning.

Only *confirmed* toxic documents and unlabelled text are learnt from: a document without a toxic label may
still be toxic. With the class prior ``pi`` the risk of the negative class is estimated as
``R_unlabelled(-) - pi R_positive(-)``. Where a flexible model drives that estimate below zero, which no true risk
can be, the step goes the other way (the non-negative estimator). The classifier is linear, on the presence of
words and word beginnings (4 to 6 letters), hashed. Features are those that confirmed documents hold
significantly more often than unlabelled ones; that too needs no negative label.

A fifth of the fitting sample is kept out of the descent. On it the threshold is the one of least estimated error
``U(t) - 2 pi TPR(t) + pi``, and the slope makes the mean probability of unlabelled text equal the prior.

What is counted over all rows: the prior, over all labels outside the held-out fold. What is fitted on a bounded
sample, chosen by row hash: at most about ``max_positives`` confirmed and ``max_unlabelled`` other documents of up to
``max_sample_chars`` characters. Every whole text is scored.

Edge cases: null and empty texts have no features and get the score of the intercept; a null id is not held out and not
learnt from; an id whose labels disagree, or are null, is not confirmed; equal rows get equal scores, and
count once in the sample; without confirmed documents every score is 0. Other columns are neither read nor returned.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import each_text, kept_by_worker, new_folder, remove, row_key, written

BITS = 20
BEGINNINGS = (4, 5, 6)
#: Words that a worker remembers to hold no feature of the model.
MAX_COLD_WORDS = 400_000
#: A-Z lower-cased; all else that is ASCII and no letter separates words.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str) -> set[bytes]:
    return set(text.encode("utf-8", "surrogatepass").translate(LETTERS).split())


def features_of(word: bytes) -> list[int]:
    """Places of a word and its beginnings in the table of weights."""
    letters = word.decode("utf-8", "surrogatepass")
    parts = [b"=" + word, *(letters[:n].encode("utf-8", "surrogatepass") for n in BEGINNINGS if len(letters) > n)]
    return [xxhash.xxh32_intdigest(p) >> (32 - BITS) for p in parts]


def document_features(text: str) -> np.ndarray:
    return np.array(sorted({f for w in words_of(text) for f in features_of(w)}), np.int32)


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def softplus(z):
    return np.log1p(np.exp(-np.abs(z))) + np.maximum(z, 0)


class _Sparse:
    """Rows of feature numbers, flat."""

    def __init__(self, rows: list[np.ndarray]):
        self.n = len(rows)
        self.flat = np.concatenate([np.empty(0, np.int32), *rows])
        self.row = np.repeat(np.arange(self.n), [len(r) for r in rows])

    def times(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=weights[self.flat], minlength=self.n)

    def back(self, per_row: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(self.flat, weights=per_row[self.row], minlength=size)


def risk_and_slopes(positive: np.ndarray, unlabelled: np.ndarray, prior: float):
    """Non-negative risk of logits, and its slope by each logit (reversed where the negative part is below zero)."""
    negative = softplus(unlabelled).mean() - prior * softplus(positive).mean()
    risk = prior * softplus(-positive).mean() + max(0.0, negative)
    if negative >= 0:
        return risk, np.full(len(positive), -prior / len(positive)), sigmoid(unlabelled) / len(unlabelled)
    return risk, prior * sigmoid(positive) / len(positive), -sigmoid(unlabelled) / len(unlabelled)


def operating_point(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> tuple[float, float]:
    """Threshold of least estimated error, and the slope for which the mean probability is the prior."""
    values = np.unique(np.concatenate([positive, unlabelled]))
    between = np.concatenate([[values[0] - 1], (values[1:] + values[:-1]) / 2, [values[-1] + 1]])
    caught = 1 - np.searchsorted(np.sort(positive), between) / len(positive)
    flagged = 1 - np.searchsorted(np.sort(unlabelled), between) / len(unlabelled)
    error = flagged - 2 * prior * caught
    threshold = between[error <= error.min() + 1e-12].mean()
    slopes = np.geomspace(0.25, 16, 25)
    return float(threshold), float(min(slopes, key=lambda a: abs(sigmoid(a * (unlabelled - threshold)).mean() - prior)))


@dataclass
class Toxicity:
    """Weights by hashed feature (zero: not a feature of the model) and the logit of a text without any."""

    weights: np.ndarray
    intercept: float

    def logits(self, texts) -> list[float]:
        cold: set[bytes] = kept_by_worker("positive_unlabelled", set)
        out = []
        for text in texts:
            found: set[int] = set()
            for word in words_of(text).difference(cold):
                used = [f for f in features_of(word) if self.weights[f]]
                if used:
                    found.update(used)
                elif len(cold) < MAX_COLD_WORDS:
                    cold.add(word)
            out.append(self.intercept + float(self.weights[sorted(found)].sum()))
        return out


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, *, steps: int = 200, rate: float = 0.02,
        decay: float = 1e-4, significance: float = 5.0, min_documents: int | None = None) -> Toxicity:
    """The classifier from the features of confirmed and of unlabelled documents."""
    size = 1 << BITS
    if min_documents is None:
        min_documents = int(np.clip(len(positive) // 100, 3, 8))
    n_pos, n_unl = (np.bincount(np.concatenate([np.empty(0, np.int32), *d]), minlength=size) for d in (positive, unlabelled))
    p, u = (n_pos + 0.5) / (len(positive) + 1), (n_unl + 0.5) / (len(unlabelled) + 1)
    spread = np.sqrt(u * (1 - u) / len(positive) + p * (1 - p) / len(unlabelled))
    chosen = np.flatnonzero((n_pos + n_unl >= min_documents) & (p - u > significance * spread))
    place = np.full(size, -1, np.int32)
    place[chosen] = np.arange(len(chosen))
    scale = np.minimum(np.log(p[chosen] / u[chosen]), 3.0)

    def rows(documents, part):
        kept = [(k := place[d])[k >= 0] for i, d in enumerate(documents) if (i % 5 == 4) == part]
        return _Sparse(kept or [np.empty(0, np.int32)])

    pos, unl = rows(positive, False), rows(unlabelled, False)
    w, b = np.zeros(len(chosen)), float(np.log(prior / (1 - prior)))
    moments = np.zeros((2, len(chosen) + 1))
    for step in range(1, steps + 1):
        _, by_pos, by_unl = risk_and_slopes(pos.times(w * scale) + b, unl.times(w * scale) + b, prior)
        slope = np.append((pos.back(by_pos, len(w)) + unl.back(by_unl, len(w))) * scale + decay * w, by_pos.sum() + by_unl.sum())
        moments = np.array([0.9 * moments[0] + 0.1 * slope, 0.999 * moments[1] + 0.001 * slope ** 2])
        move = rate * moments[0] / (1 - 0.9 ** step) / (np.sqrt(moments[1] / (1 - 0.999 ** step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    threshold, a = operating_point(*(rows(d, True).times(w * scale) + b for d in (positive, unlabelled)), prior)
    weights = np.zeros(size, np.float32)
    weights[chosen] = a * w * scale
    return Toxicity(weights, a * (b - threshold))


def held_out(column: str | Column, folds: int, fold: int) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % folds == fold, F.lit(False))


def confirmed_labels(labels: DataFrame, folds: int, fold: int) -> DataFrame:
    """Labelled ids outside the held-out fold: whether all rows of an id say toxic."""
    return (labels.where(F.col("doc_id").isNotNull() & ~held_out("doc_id", folds, fold))
            .groupBy(F.col("doc_id").cast("bigint").alias("doc_id"))
            .agg(F.min(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic")))


def sample_features(rows: DataFrame, key: str, wanted: int, folder: str) -> list[np.ndarray]:
    """Features of about ``wanted`` of the distinct ``rows`` (``key``, text), those of the least keys.

    The share of keys taken is fixed by the number of rows, so the expected size is at most ``wanted``.
    """
    total = rows.count()
    if not total:
        return []
    share = min(1.0, wanted / total)
    taken = rows if share == 1 else rows.where(F.pmod(F.col(key), F.lit(1 << 30)) < int(share * (1 << 30)))

    def hashed(batches):
        for batch in batches:
            found = [document_features(t).tobytes() for t in each_text(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["key", "features"])

    packed = taken.select(F.col(key), F.col("text")).mapInArrow(hashed, "key bigint, features binary")
    packed = written(packed.dropDuplicates(["key"]), folder).orderBy("key").toArrow()
    return [np.frombuffer(f.as_py(), np.int32) for f in packed.column("features")]


def train_toxicity(docs: DataFrame, labels: DataFrame, *, folds: int = 5, fold: int = 0, max_positives: int = 3000,
                   max_unlabelled: int = 9000, max_sample_chars: int = 20_000) -> Toxicity | None:
    """Learns from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic) outside the held-out fold."""
    folder = new_folder(docs.sparkSession, "toxicity")
    confirmed = written(confirmed_labels(labels, folds, fold), f"{folder}/labels")
    prior = confirmed.agg(F.avg(F.col("toxic").cast("double"))).first()[0]
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.where(F.col("doc_id").isNotNull() & ~held_out("doc_id", folds, fold)
                      & (F.coalesce(F.length("text"), F.lit(0)) <= max_sample_chars))
    rows = rows.withColumn("key", row_key("doc_id", "text"))
    if not prior or prior >= 1:
        remove(docs.sparkSession, folder)
        return None
    # ids and keys only; the texts of the sample are read where they lie
    toxic = rows.select("doc_id", "key").join(confirmed.where("toxic").select("doc_id"), "doc_id", "left_semi")
    toxic = written(toxic.select("key").distinct(), f"{folder}/toxic")
    share = min(1.0, max_positives / max(1, toxic.count()))
    picked = toxic.where(F.pmod("key", F.lit(1 << 30)) < int(share * (1 << 30)))
    positive = sample_features(rows.join(F.broadcast(picked), "key", "left_semi"), "key", max_positives * 2, f"{folder}/p")
    unlabelled = sample_features(rows, "key", max_unlabelled, f"{folder}/u")
    remove(docs.sparkSession, folder)
    return fit(positive, unlabelled, prior) if len(positive) > 4 and len(unlabelled) > 4 else None


def score_toxicity(docs: DataFrame, labels: DataFrame, *, folds: int = 5, fold: int = 0, **bounds) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of ``docs`` (doc_id, text)."""
    model = docs.sparkSession.sparkContext.broadcast(train_toxicity(docs, labels, folds=folds, fold=fold, **bounds))

    def score(batches):
        for batch in batches:
            known = model.value
            logits = known.logits(each_text(batch, "text")) if known else [-40.0] * batch.num_rows
            scores = sigmoid(np.array(logits)) if known else np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64())],
                                             names=["doc_id", "held_out", "score"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held_out("doc_id", folds, fold).alias("held_out"),
                       F.col("text").cast("string").alias("text"))
    scored = rows.mapInArrow(score, "doc_id bigint, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
