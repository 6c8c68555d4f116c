"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model is a pair model of all trusted documents of one half of the ids, by hash; the other half is kept for the
thresholds, which need text that the model has not seen. Its counts are Spark aggregates: pairs, then per first word
the number of pairs seen once, twice and more, and per second word the number of words before it. They
are cut into shards by key hash and written to the shared folder. Documents are gathered into blocks (see
:mod:`ngram_blocks`); a block sends its distinct words and pairs to their shards, each shard of the model is read once and answers
all blocks, and the answers go back to the blocks. So work grows with text and model, not with their product, and neither
is ever whole in one task. That is done for ``SLICES`` parts of the documents in turn, so that blocks, questions
and answers of only one part lie on disk at a time. Keys are 64-bit hashes, compared whole.

A document goes when its perplexity exceeds a quantile of its language: of trusted labelled documents that
the model has not seen (all but the training documents). Perplexity is that of the text's tokens
pulled towards the language's median by ``pull`` tokens, so that a few words do not decide.

Edge cases: null and empty texts are the end token alone; a null language is a language of its
own; a language with fewer than ``min_reference`` reference documents takes the quantile of
all languages; without any reference nothing goes. Rows with equal doc_id, language and text share one judgement.
A label that repeats with different values is trusted only if all its rows are.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import file_system, new_folder, pack, remove, row_key, shuffle_files_removed, written
from tidemark.llm.ngram_blocks import Block, answered, keys_of, pair_key, placed, questions, token_blocks

#: Model keys and tokens of documents that a task holds at a time, and parts of the documents that are asked about one after another.
KEYS_PER_SHARD, BLOCK_TOKENS, SLICES = 500_000, 400_000, 4
#: Training ids up to which they are sent to every executor, so that only texts of training documents leave their place.
MOST_SENT_IDS = 4_000_000
ANSWERS = "block string, shard int, context binary, gamma binary, lower binary, pairs binary"
LOG = "doc_id bigint, key bigint, n_tokens bigint, log_prob double"


def trusted_labels(labels: DataFrame) -> DataFrame:
    """Labelled ids whose every row says good and not toxic, with the half they fall in."""
    good = (F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)
    return (labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(F.coalesce(good, F.lit(False))).alias("good"))
            .where("good").select("doc_id", F.xxhash64("doc_id").alias("hash"))
            .withColumn("train", F.pmod("hash", F.lit(2)) == 0))


def count_pairs(docs: DataFrame) -> DataFrame:
    """Counts of adjacent words (as hashes) in ``docs`` (text); the end token is the empty word."""
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.filter(F.split(lowered, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    hashed = F.transform(F.concat(words, F.array(F.lit(""))), lambda w: F.xxhash64(w))
    pairs = F.arrays_zip(F.slice("w", 1, F.size("w") - 1).alias("first"), F.slice("w", 2, F.size("w") - 1).alias("second"))
    return (docs.select(hashed.alias("w")).where(F.size("w") > 1).select(F.explode(pairs).alias("p"))
            .groupBy(F.col("p.first").alias("first"), F.col("p.second").alias("second")).agg(F.count("*").alias("c")))


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from the counts of counts; 0.5, 1, 1.5 where those are too thin."""
    if not (n1 and n2 and n3):
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    return (1 - 2 * y * n2 / n1, max(0.0, 2 - 3 * y * n3 / n2), max(0.0, 3 - 4 * y * n4 / n3))


def _classes(column: str) -> list:
    c = F.col(column)
    return [F.count_if(c == 1).alias("n1"), F.count_if(c == 2).alias("n2"),
            F.count_if(c == 3).alias("n3"), F.count_if(c == 4).alias("n4")]


def train_model(docs: DataFrame, folder: str) -> Model:
    """Counts pairs of ``docs`` (text) and writes the model in shards below ``folder``."""
    counts = written(count_pairs(docs), f"{folder}/pairs")
    after = counts.groupBy("second").agg(F.count("*").alias("kinds"))
    upper = counts.agg(*_classes("c"), F.count("*").alias("pairs")).first()
    lower = after.agg(*_classes("kinds"), F.count("*").alias("words"), F.sum("kinds").alias("kinds"),
                      F.count_if(F.col("kinds") >= 3).alias("many")).first()
    d = discounts(upper.n1, upper.n2, upper.n3, upper.n4)
    b = discounts(lower.n1, lower.n2, lower.n3, lower.n4)
    kinds, words = lower.kinds or 0, lower.words or 0
    spread = (b[0] * lower.n1 + b[1] * lower.n2 + b[2] * lower.many) / kinds if kinds else 1.0
    floor = spread / (words + 1)

    def less(column, by):
        c = F.col(column)
        return F.when(c == 1, c - by[0]).when(c == 2, c - by[1]).otherwise(c - by[2])

    context = counts.groupBy("first").agg(F.sum("c").alias("count"), *_classes("c"), F.count_if(F.col("c") >= 3).alias("many"))
    context = context.select(
        F.col("first").alias("word"), F.col("count").cast("double"),
        ((d[0] * F.col("n1") + d[1] * F.col("n2") + d[2] * F.col("many")) / F.col("count")).alias("gamma"))
    cont = after.select(F.col("second").alias("word"), (less("kinds", b) / max(kinds, 1) + floor).alias("lower"))
    word_rows = context.join(cont, "word", "full_outer").select(
        F.lit(False).alias("pair"), F.col("word").alias("first"), F.lit(0).cast("bigint").alias("second"),
        F.coalesce("count", F.lit(0.0)).alias("count"), F.coalesce("gamma", F.lit(1.0)).alias("gamma"),
        F.coalesce("lower", F.lit(floor)).alias("lower"))
    pair_rows = counts.select(
        F.lit(True).alias("pair"), "first", "second", less("c", d).cast("double").alias("count"),
        F.lit(0.0).alias("gamma"), F.lit(0.0).alias("lower"))

    # words and pairs of about KEYS_PER_SHARD keys a shard: what a task holds at a time, whatever the model's size
    shards = max(1, -(-(upper.pairs + words) // KEYS_PER_SHARD))

    def keyed(batches):
        for batch in batches:
            is_pair = batch.column(0).to_numpy(zero_copy_only=False)
            first, second = (batch.column(i).to_numpy().astype(np.int64).view(np.uint64) for i in (1, 2))
            keys = np.where(is_pair, pair_key(first, second), first)
            yield pa.RecordBatch.from_arrays(
                [pa.array((keys % np.uint64(shards)).astype(np.int32)), batch.column(0), pa.array(keys.view(np.int64)), *batch.columns[3:]],
                names=["shard", "pair", "key", "count", "gamma", "lower"])

    rows = word_rows.unionByName(pair_rows).mapInArrow(
        keyed, "shard int, pair boolean, key bigint, count double, gamma double, lower double")
    rows = rows.select("shard", "pair", "key", *[F.col(c).cast("float").alias(c) for c in ("count", "gamma", "lower")])
    rows.repartition(shards, "shard").write.partitionBy("shard").parquet(f"{folder}/model")
    remove(docs.sparkSession, f"{folder}/pairs")
    return Model(f"{folder}/model", shards, floor)


@dataclass(frozen=True)
class Model:
    """A written model: its shards, and the probability of a word that it lacks."""

    folder: str
    shards: int
    floor: float

    def shard(self, number: int) -> dict[bool, tuple[np.ndarray, ...]]:
        """Keys, ascending, with count, gamma and lower, for words (False) and pairs (True)."""
        import pyarrow.dataset as ds
        from pyarrow.fs import FileType

        files, path = file_system(f"{self.folder}/shard={number}")
        if files.get_file_info(path).type == FileType.NotFound:
            return {kind: (np.empty(0, np.uint64), *[np.empty(0, np.float32)] * 3) for kind in (False, True)}
        table = ds.dataset(path, filesystem=files, format="parquet").to_table()
        is_pair, keys = table.column("pair").to_numpy(), table.column("key").to_numpy().view(np.uint64)
        values = [table.column(c).to_numpy() for c in ("count", "gamma", "lower")]
        out = {}
        for kind in (False, True):
            at = np.flatnonzero(is_pair == kind)
            at = at[np.argsort(keys[at])]
            out[kind] = (keys[at], *(v[at] for v in values))
        return out


def look_up(model: Model):
    """Answers all blocks' questions to one shard of the model."""

    def join(asked: pa.Table) -> pa.Table:
        rows = asked.to_pylist()
        shard, out = model.shard(rows[0]["shard"]), {c.split()[0]: [] for c in ANSWERS.split(", ")}

        def answer(keys: np.ndarray, kind: bool, defaults: tuple[float, ...]) -> list[bytes]:
            known, *values = shard[kind]
            at = np.minimum(np.searchsorted(known, keys), max(len(known) - 1, 0))
            hit = known[at] == keys if len(known) else np.zeros(len(keys), bool)
            found = []
            for column, default in zip(values, defaults):
                got = np.full(len(keys), default, np.float32)
                got[hit] = column[at[hit]]
                found.append(pack(got))
            return found

        for r in rows:
            words = answer(keys_of(r["word_keys"], r["words"]), False, (0.0, 1.0, model.floor))
            pairs = answer(keys_of(r["pair_keys"], r["pairs"]), True, (0.0,))
            for name, value in zip(out, (r["block"], r["shard"], *words, *pairs)):
                out[name].append(value)
        return pa.table([pa.array(v, t) for v, t in zip(out.values(), [pa.string(), pa.int32()] + [pa.binary()] * 4)], names=list(out))

    return join


def log_probabilities(docs: DataFrame, train: DataFrame) -> DataFrame:
    """Natural log probability of every row of ``docs`` (doc_id, key, text) under the model of ``train`` (text)."""
    spark = docs.sparkSession
    folder, target = new_folder(spark, "kneser-ney"), new_folder(spark, "log-probabilities")
    with shuffle_files_removed(spark):
        model = train_model(train, folder)
        shards = model.shards

        def read(block: Block, found: list[dict]) -> dict:
            def at(name, keys):
                return placed(keys, shards, {r["shard"]: r[name] for r in found}, np.float32).astype(np.float64)

            codes, place, follows = block.pairs()
            context, gamma, lower = (at(name, block.hashes) for name in ("context", "gamma", "lower"))
            seen = at("pairs", block.pair_keys(codes))
            p = lower[block.tokens]
            before = block.tokens[follows - 1]
            p[follows] = seen[place] / np.maximum(context[before], 1.0) + gamma[before] * p[follows]
            return {"doc_id": block.rows.column("doc_id"), "key": block.rows.column("key"),
                    "n_tokens": block.lengths, "log_prob": block.per_document(np.log(p))}

        rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("key").cast("bigint").alias("key"),
                           F.col("text").cast("string").alias("text"))
        for part in range(SLICES):
            own = f"{folder}/part-{part}"
            some = rows.where(F.pmod("key", F.lit(SLICES)) == part)
            blocks = written(token_blocks(some, ["doc_id", "key"], tokens_per_block=BLOCK_TOKENS), f"{own}/blocks")
            asked = questions(blocks, shards).groupBy("shard")
            answers = written(asked.applyInArrow(look_up(model), ANSWERS), f"{own}/answers")
            answered(blocks, answers, read, LOG).write.parquet(f"{target}/part={part}")
            remove(spark, own)
    remove(spark, folder)
    return spark.read.schema(LOG).parquet(*[f"{target}/part={part}" for part in range(SLICES)])


def classify_quality(
    docs: DataFrame, labels: DataFrame, *, quantile: float = 0.995, max_training_docs: int | None = None,
    pull: float = 20.0, min_reference: int = 20,
) -> DataFrame:
    """One row per distinct (doc_id, lang, text): perplexity, the language's threshold, and whether it stays.

    The model counts every trusted document of its half, unless ``max_training_docs`` asks for fewer.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("lang").cast("string").alias("lang"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("key", row_key("doc_id", "lang", "text"))
    trusted = trusted_labels(labels)
    # ids that documents do not hold are neither trained on nor reference
    held = trusted.join(rows.select("doc_id"), "doc_id", "left_semi")
    training = held.where("train")
    if max_training_docs is not None:
        training = training.orderBy("hash", "doc_id").limit(max_training_docs)
    # written once, so that training and reference are told apart by the same ids
    training = written(training.select("doc_id"), new_folder(docs.sparkSession, "training-ids"))
    sent = F.broadcast(training) if training.count() <= MOST_SENT_IDS else training
    found = log_probabilities(rows, rows.join(sent, "doc_id", "left_semi").select("text"))
    found = found.dropDuplicates(["doc_id", "key"])
    of_row = rows.select("key", "lang").dropDuplicates(["key"])
    scored = found.join(of_row, "key").withColumn("mean", -F.col("log_prob") / F.col("n_tokens"))
    unseen = trusted.select("doc_id").join(training, "doc_id", "left_anti")
    reference = scored.join(unseen, "doc_id", "left_semi")
    median = reference.groupBy("lang").agg(F.percentile_approx("mean", 0.5).alias("median"), F.count("*").alias("n"))
    overall = reference.agg(F.percentile_approx("mean", 0.5).alias("all_median"))

    def pulled(column):
        return (-F.col("log_prob") + pull * F.col(column)) / (F.col("n_tokens") + pull)

    # One row for each language, and one row in all.
    def with_centre(df):
        joined = df.join(F.broadcast(median), df.lang.eqNullSafe(median.lang), "left").drop(median.lang)
        joined = joined.join(F.broadcast(overall), F.lit(True), "left")
        centre = F.when(F.col("n") >= min_reference, F.col("median")).otherwise(F.col("all_median"))
        return joined.withColumn("centre", F.coalesce(centre, "mean")).withColumn("level", pulled("centre"))

    levels = with_centre(reference)
    cut = levels.groupBy("lang").agg(F.percentile_approx("level", quantile, 100_000).alias("cut"), F.count("*").alias("m"))
    all_cut = levels.agg(F.percentile_approx("level", quantile, 100_000).alias("all_cut"))
    judged = with_centre(scored)
    judged = judged.join(F.broadcast(cut), judged.lang.eqNullSafe(cut.lang), "left").drop(cut.lang)
    judged = judged.join(F.broadcast(all_cut), F.lit(True), "left")
    limit = F.when(F.col("m") >= min_reference, F.col("cut")).otherwise(F.col("all_cut"))
    return judged.select(
        "doc_id", "key", "lang", "n_tokens", F.exp("level").alias("perplexity"), F.exp(limit).alias("threshold"),
        F.coalesce(F.col("level") <= limit, F.lit(True)).alias("keep"))
