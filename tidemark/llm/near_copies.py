"""Near-duplicate classes of documents: word shingles that are similar to a given degree.

Candidates are the neighbours of SimHash fingerprints, found through vantage-point trees (see :mod:`simhash`), and, because a
64-bit fingerprint within 3 bits misses most pairs that share only four fifths of their shingles, from the
least shingle hashes of each document. First, documents that share one of them are led to the most central document among
them, and to those of two finer random divisions. That joins most of a group through few pairs, but not versions that are unlike
each hub. Documents that then share least hashes with another class are compared by an exact prefix join: each is found by its
rarest shingles alone, and a pair is a candidate only if what follows their first common one is enough for the similarity and
counts of their shingles by hash do not differ too much for it.
Text that many documents share is not rare, so it makes no pairs. First each meets the likest ones, then all pairs in
different classes that are left are checked, in blocks of bounded size. Last come all pairs of neighbours by fingerprint that are
still in different classes, whatever their least hashes. Every candidate pair is checked exactly on whole
shingle sets, and classes are the connected components of the pairs that hold.

Edge cases: texts are compared as words without case; equal word sequences are one class; so are all texts without
words, null included; fewer words than a shingle are one shingle; rows equal in id and text count as
copies; of a class the row with the least id stays (null ids last, ties by content), exactly once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import each_text, lower_words, new_folder, pack, remove, row_key, unpack, written
from tidemark.llm.components import connected
from tidemark.llm.simhash import fingerprint, neighbours, shingle_hashes

#: Least hashes kept of each document; of those of a pair this share must be common before it is checked with a hub.
LEAST_HASHES, COMMON_SHARE = 16, 0.375
#: Members of a shingle that are compared with as many others at once, and rows of such blocks that a task takes together.
BLOCK_ROWS, CELL_ROWS = 1_000, 8_000
#: Counts of a document's shingles, by the low bits of their hashes; more than 255 count as 255.
COUNTS = 256
ROWS = "key bigint, doc_id bigint, content bigint, fp bigint, size int, least array<bigint>"


def shape_rows(docs: DataFrame, words: int) -> DataFrame:
    """Per row of ``docs`` (key, doc_id, text): what candidates are found by."""
    def stream(batches):
        for batch in batches:
            content, fps, sizes, least = [], [], [], []
            for text in each_text(batch, "text"):
                of_text = lower_words(text)
                hashes = shingle_hashes(of_text, words)
                distinct = np.unique(hashes)
                content.append(xxhash.xxh64_intdigest(b" ".join(of_text)))
                fps.append(fingerprint(hashes))
                sizes.append(len(distinct))
                least.append(distinct[:LEAST_HASHES].view(np.int64).tolist())
            signed = lambda v: pa.array(np.array(v, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([
                batch.column("key"), batch.column("doc_id"), signed(content), signed(fps), pa.array(sizes, pa.int32()),
                pa.array(least, pa.list_(pa.int64()))], names=[c.split()[0] for c in ROWS.split(", ")])

    return docs.select("key", "doc_id", "text").mapInArrow(stream, ROWS)


def fingerprint_pairs(rooted: DataFrame, radius: int, similarity: float) -> DataFrame:
    """All pairs of contents of ``rooted`` (content, fp, size, root) with fingerprints within ``radius`` bits, different
    roots and sizes that allow the similarity."""
    of_fp = rooted.groupBy("fp").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    pairs = neighbours(of_fp, radius).select(F.col("a").alias("fp_a"), F.col("b").alias("fp_b"))
    left, right = (rooted.select(F.col("fp").alias(f"fp_{c}"), F.col("content").alias(c), F.col("root").alias(f"root_{c}"),
                                 F.col("size").alias(f"size_{c}")) for c in "ab")
    sizes = F.least("size_a", "size_b") >= similarity * F.greatest("size_a", "size_b")
    pairs = pairs.join(left, "fp_a").join(right, "fp_b")
    once = (F.col("fp_a") != F.col("fp_b")) | (F.col("a") > F.col("b"))
    return pairs.where(once & (F.col("root_a") != F.col("root_b")) & sizes).select("a", "b")


def shared_hashes(classes: DataFrame, folder: str) -> DataFrame:
    """(content, h, central) of the least hashes that contents share."""
    keyed = classes.select("content", F.explode("least").alias("h"))
    shared = written(keyed.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"), f"{folder}/shared")
    keyed = written(keyed.join(shared, "h"), f"{folder}/keyed")
    central = keyed.groupBy("content").agg(F.sum(F.log("n")).alias("central"))
    return written(keyed.join(central, "content").select("content", "h", "central"), f"{folder}/central")


def hub_pairs(keyed: DataFrame) -> DataFrame:
    """Candidate pairs of each content with the most central ones among those that share a least hash."""
    out = None
    for divisions in (1, 2, 8):
        part = F.pmod(F.xxhash64("content", "h"), F.lit(divisions)).alias("part")
        rows = keyed.select("content", "h", "central", part)
        hub = rows.groupBy("h", "part").agg(F.max_by("content", F.struct("central", "content")).alias("b"))
        pairs = rows.join(hub, ["h", "part"]).select(F.col("content").alias("a"), "b")
        out = pairs if out is None else out.unionByName(pairs)
    return out


def enough_hashes(keyed: DataFrame, classes: DataFrame, similarity: float) -> DataFrame:
    """The contents of ``keyed`` with so many of its hashes that one of their pairs can be similar."""
    counts = keyed.groupBy("content").agg(F.count("*").alias("n"))
    sizes = classes.select("content", F.size("least").alias("all"))
    # the other content of a pair has at least ``similarity`` times as many least hashes; two thirds leave a margin
    return counts.join(sizes, "content").where(F.col("n") >= COMMON_SHARE * 2 / 3 * similarity * F.col("all")).select("content")


def open_contents(keyed: DataFrame, classes: DataFrame, roots: DataFrame, similarity: float) -> DataFrame:
    """The contents with enough least hashes that contents of another root (content, root) have too."""
    rooted = keyed.select("content", "h").join(roots, "content")
    mixed = rooted.groupBy("h").agg(F.min("root").alias("r"), F.max("root").alias("s")).where("r <> s").select("h")
    return enough_hashes(rooted.join(mixed, "h", "left_semi"), classes, similarity)


def rare_beginnings(texts: DataFrame, classes: DataFrame, words: int, similarity: float, folder: str) -> DataFrame:
    """(content, h, size, place, counts): of each of ``texts`` the rarest shingles, so many that similar texts have one in common.

    Shingles are ordered by the number of ``texts`` that have them, the same way for all. Of two sets with overlap o, the first
    size - o + 1 of each meet; similar ones overlap in at least ``similarity`` times the size. Shingles of one text
    alone come first and are only counted."""
    def stream(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                sets = [np.unique(shingle_hashes(lower_words(t), words)).view(np.int64) for t in each_text(part, "text")]
                content = np.repeat(part.column("content").to_numpy(), list(map(len, sets)))
                # once a text, with its first shingle
                counts = [c for s in sets for c in [shingle_counts(s), *[None] * (len(s) - 1)][:len(s)]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(content), pa.array(np.concatenate(sets)), pa.array(counts, pa.binary())], names=["content", "h", "counts"])

    rows = texts.select("content", "text").mapInArrow(stream, "content bigint, h bigint, counts binary")
    rows = written(rows, f"{folder}/shingles")
    # written, so that the join below can split a hot shingle
    counts = written(rows.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"), f"{folder}/counts")
    of_text = Window.partitionBy("content")
    ranked = rows.join(counts, "h").select(
        "content", "h", F.row_number().over(of_text.orderBy("n", "h")).alias("rank"), F.count("*").over(of_text).alias("shared"))
    placed = ranked.join(classes.select("content", "size"), "content").withColumn("place", F.expr("int(size - shared + rank - 1)"))
    first = placed.where(F.col("place") <= F.col("size") - F.ceil(similarity * F.col("size") - F.lit(1e-6)))
    of_content = rows.where("counts IS NOT NULL").select("content", "counts")
    return written(first.select("content", "h", "size", "place").join(of_content, "content"), f"{folder}/beginnings")


def shingle_counts(hashes: np.ndarray) -> bytes:
    return np.bincount(hashes & (COUNTS - 1), minlength=COUNTS).clip(max=255).astype(np.uint8).tobytes()


def least_difference(counts: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many shingles the sets of rows ``a`` and ``b`` differ in at least: by so much their counts do."""
    out = np.empty(len(a), np.int64)
    for at in range(0, len(a), 8_192):
        part = slice(at, at + 8_192)
        out[part] = np.abs(counts[a[part]] - counts[b[part]]).sum(1, dtype=np.int64)
    return out


def pairs_of_cell(cell: pa.Table, similarity: float, likest: bool) -> pa.Table:
    """Pairs (a, b, score) of different roots in the blocks of a cell that can be similar: of each block's asking rows with its others.

    If the block's shingle is the first that both have, no more than what follows it can be common; if it is not, the pair
    is also in the block of the first. What their counts differ in cannot be common either. With ``likest`` each asking row gives one pair a block."""
    h, by, to, content, root, size, place = (cell.column(c).to_numpy() for c in ("h", "by", "to", "content", "root", "size", "place"))
    asks, lone = (cell.column(c).to_numpy(zero_copy_only=False) for c in ("asks", "lone"))
    counts = np.frombuffer(b"".join(cell.column("counts").to_pylist()), np.uint8).reshape(-1, COUNTS).astype(np.int16)
    order = np.lexsort((to, by, h))
    new = (np.diff(h[order]) != 0) | (np.diff(by[order]) != 0) | (np.diff(to[order]) != 0)
    left, share, out = (size - place).astype(np.float64), similarity / (1 + similarity), []
    for block in np.split(order, np.flatnonzero(new) + 1):
        asking, others = block[asks[block]], block[~asks[block]]
        if not len(asking) or not len(others):
            continue
        for part in np.split(asking, range(256, len(asking), 256)):
            total = np.add.outer(size[part], size[others])
            good = np.minimum.outer(left[part], left[others]) - share * total >= -1e-6
            good &= root[part][:, None] != root[others][None, :]
            # two lone rows ask each other
            good &= likest | ~(lone[others][None, :] & (content[part][:, None] < content[others][None, :]))
            a, b = np.nonzero(good)
            total, a, b = total[a, b], part[a], others[b]
            differ = least_difference(counts, a, b)
            near = differ <= (1 - 2 * share) * total + 1e-6
            a, b, score = a[near], b[near], 1 - differ[near] / total[near]
            if likest:
                best = np.lexsort((-score, a))
                best = best[np.diff(a[best], prepend=-1) != 0]
                a, b, score = a[best], b[best], score[best]
            out.append((content[a], content[b], score))
    a, b, score = (np.concatenate([np.empty(0, t), *(p[i] for p in out)]) for i, t in enumerate((np.int64, np.int64, np.float64)))
    return pa.table({"a": a, "b": b, "score": score})


def open_pairs(beginnings: DataFrame, roots: DataFrame, similarity: float, likest: bool, folder: str) -> DataFrame:
    """Candidate pairs of contents that have one of their rarest shingles in common and different ``roots`` (content, root).

    Of a shingle, the members of the root that most have need not meet each other: the lone others ask all
    members, in blocks of both. With ``likest`` each content gives a few pairs in all."""
    rooted = written(beginnings.join(roots, "content"), f"{folder}/rooted")
    of_key = rooted.groupBy("h", "root").agg(F.count("*").alias("n")).groupBy("h").agg(
        F.max_by("root", F.struct("n", "root")).alias("main"), F.sum("n").alias("n"), F.max("n").alias("most")).where("n > most")
    parts = lambda n: F.ceil(n / F.lit(BLOCK_ROWS)).cast("int")
    of_key = of_key.select("h", "main", parts(F.col("n") - F.col("most")).alias("asking"), parts(F.col("n")).alias("asked"))
    rows = rooted.join(written(of_key, f"{folder}/keys"), "h")
    rows = written(rows.withColumn("lone", F.col("root") != F.col("main")).drop("main"), f"{folder}/open")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    one_of = lambda n: F.pmod(F.xxhash64("content"), F.col(n)).cast("int")
    sent = rows.withColumn("asks", F.lit(False)).withColumn("to", one_of("asked")).withColumn("by", all_of("asking")).unionByName(
        rows.where("lone").withColumn("asks", F.lit(True)).withColumn("by", one_of("asking")).withColumn("to", all_of("asked")))
    copies = rows.agg(F.sum(F.col("asking") + F.when(F.col("lone"), F.col("asked")).otherwise(0)).alias("n")).first().n or 0
    cells = max(1, -(-copies // CELL_ROWS))
    sent = sent.select(F.pmod(F.xxhash64("h", "by", "to"), F.lit(cells)).alias("cell"),
                       "h", "by", "to", "asks", "lone", "content", "root", "size", "place", "counts")
    pairs = sent.groupBy("cell").applyInArrow(lambda cell: pairs_of_cell(cell, similarity, likest), "a bigint, b bigint, score double")
    if likest:
        pairs = pairs.groupBy("a", F.pmod(F.xxhash64("b"), F.lit(4)).alias("part")).agg(F.max_by("b", F.struct("score", "b")).alias("b"))
    return pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def likely(pairs: DataFrame, classes: DataFrame, similarity: float) -> DataFrame:
    """Distinct pairs whose sizes and least hashes allow the similarity."""
    pairs = pairs.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    for side in "ab":
        pairs = pairs.join(classes.select(
            F.col("content").alias(side), F.col("size").alias(f"size_{side}"), F.col("least").alias(f"least_{side}")), side)
    common = F.size(F.array_intersect("least_a", "least_b"))
    fewest = F.least(F.size("least_a"), F.size("least_b"))
    sizes = F.least("size_a", "size_b") >= similarity * F.greatest("size_a", "size_b")
    return pairs.where(sizes & (common >= COMMON_SHARE * fewest)).select("a", "b")


def similar_pairs(pairs: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """The ``pairs`` whose shingle sets are similar; ``texts`` (content, text) holds the texts of their contents."""
    def sets(batches):
        for batch in batches:
            of_text = [np.unique(shingle_hashes(lower_words(t), words)) for t in each_text(batch, "text")]
            deltas = [pack(np.diff(s, prepend=np.uint64(0))) for s in of_text]
            yield pa.RecordBatch.from_arrays([batch.column("content"), pa.array(list(map(len, of_text)), pa.int32()),
                                              pa.array(deltas, pa.binary())], names=["content", "n", "deltas"])

    def compare(batches):
        for batch in batches:
            keep = []
            for n_a, d_a, n_b, d_b in zip(*(batch.column(c).to_pylist() for c in ("n_a", "d_a", "n_b", "d_b"))):
                with np.errstate(over="ignore"):
                    a, b = (np.cumsum(unpack(d, n, np.uint64), dtype=np.uint64) for n, d in ((n_a, d_a), (n_b, d_b)))
                common = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(common >= similarity * (n_a + n_b - common))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(mask) for c in ("a", "b")], names=["a", "b"])

    hashed = texts.mapInArrow(sets, "content bigint, n int, deltas binary")
    for side in "ab":
        pairs = pairs.join(hashed.select(F.col("content").alias(side), F.col("n").alias(f"n_{side}"), F.col("deltas").alias(f"d_{side}")), side)
    return pairs.mapInArrow(compare, "a bigint, b bigint")


def near_copy_rows(docs: DataFrame, *, words: int = 5, similarity: float = 0.8, radius: int = 3) -> DataFrame:
    """(key, rows): the :func:`row_key` of the row that stays of every class, and how many rows have that key."""
    spark = docs.sparkSession
    folder = new_folder(spark, "near-copies")
    rows = docs.select(row_key("doc_id", "text").alias("key"), F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    shapes = written(shape_rows(rows, words), f"{folder}/rows")
    first = F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "content", "key"))
    classes = written(shapes.groupBy("content").agg(
        first.alias("first"), F.first("fp").alias("fp"), F.first("size").alias("size"), F.first("least").alias("least")), f"{folder}/classes")
    keyed = shared_hashes(classes, folder)

    def texts_of_contents(contents: DataFrame) -> DataFrame:
        wanted = contents.join(classes, "content").select("content", F.col("first.key").alias("key"))
        return rows.select("key", "text").join(wanted, "key").select("content", "text").dropDuplicates(["content"])

    texts = written(texts_of_contents(enough_hashes(keyed, classes, similarity)), f"{folder}/texts")

    def holding(pairs: DataFrame, step: str, texts: DataFrame) -> DataFrame:
        met = pairs.select(F.explode(F.array("a", "b")).alias("content")).distinct()
        of_pairs = texts.join(met, "content", "left_semi")
        return written(similar_pairs(pairs, of_pairs, words, similarity), f"{folder}/links-{step}")

    def with_roots(links: DataFrame, step: str) -> DataFrame:
        roots = connected(links)
        rooted = classes.join(roots, classes.content == roots.node, "left")
        return written(rooted.select("content", "first", F.coalesce("root", "content").alias("root")), f"{folder}/roots-{step}")

    pairs = written(likely(hub_pairs(keyed), classes, similarity), f"{folder}/pairs-hubs")
    links = holding(pairs, "hubs", texts)
    rooted = with_roots(links, "hubs")
    opened = open_contents(keyed, classes, rooted.select("content", "root"), similarity)
    beginnings = rare_beginnings(texts.join(opened, "content", "left_semi"), classes, words, similarity, folder)
    for step in ("likest", "all"):
        found = open_pairs(beginnings, rooted.select("content", "root"), similarity, step == "likest", f"{folder}/{step}")
        pairs = written(found, f"{folder}/pairs-{step}")
        if pairs.isEmpty():  # without a likest one there is no other
            break
        links = links.unionByName(holding(pairs, step, texts))
        rooted = with_roots(links, step)
    shaped = classes.select("content", "fp", "size").join(rooted.select("content", "root"), "content")
    pairs = written(fingerprint_pairs(shaped, radius, similarity), f"{folder}/pairs-neighbours")
    if not pairs.isEmpty():
        more = pairs.select(F.explode(F.array("a", "b")).alias("content")).distinct().join(texts, "content", "left_anti")
        more = written(texts_of_contents(more), f"{folder}/texts-neighbours")
        links = links.unionByName(holding(pairs, "neighbours", texts.unionByName(more)))
        rooted = with_roots(links, "neighbours")
    winners = rooted.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.key").alias("key"))
    counts = shapes.groupBy("key").agg(F.count("*").alias("rows"))
    result = written(winners.join(counts, "key"), new_folder(spark, "near-copy-rows"))
    remove(spark, folder)
    return result


def drop_near_copies(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one row of each class."""
    keep = near_copy_rows(docs, **options)
    # the row travels whole, so that no column of its own can clash
    packed = docs.select(F.struct(*docs.columns).alias("row"), row_key("doc_id", "text").alias("key"))
    joined = packed.join(keep.select("key", "rows"), "key")
    once = joined.where("rows = 1").unionByName(joined.where("rows > 1").dropDuplicates(["key"]))
    return once.select("row.*")
