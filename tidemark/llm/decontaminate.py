"""Benchmark decontamination by a generalised suffix automaton of the test items.

The normalised items become one automaton over word numbers, built on the driver from a table
whose size is checked first. Documents are streamed through it: the state after each word
is the longest stretch of words ending there that some item holds. A stretch of at least
``window`` words marks those words as hit; so does a whole item of fewer words.

Edge cases: null and empty texts have no words and no hits; an item without words matches nothing;
repeated items share states and are all named; a null item id is matched but not named; an empty benchmark hits nothing.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import each_text

#: Words are runs of ASCII letters and digits and of anything outside ASCII.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
NORMALISED = bytes(
    b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32
    for b in range(256))
LOWER = {b: b + 32 for b in range(65, 91)}
ADDED = ["n_words", "n_hit", "item_ids", "spans", "cleaned", "contaminated"]
RESULT = ("n_words bigint, n_hit bigint, item_ids array<string>, "
          "spans array<struct<start:int,end:int>>, cleaned string, contaminated boolean")
SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def words_of(text: str) -> list[bytes]:
    """Normalised words as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(NORMALISED).split()


class ItemAutomaton:
    """Generalised suffix automaton over items' words."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = [(i, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in ws]) for i, ws in items if ws]
        for _, word_ids in coded:
            last = 0
            for w in word_ids:
                last = self._extend(last, w)
        self.shortest = min([window, *(len(ws) for _, ws in coded)])
        self._mark(coded)

    def _new(self, length: int, arcs: dict[int, int], link: int) -> int:
        self.next.append(arcs)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _split(self, p: int, w: int, q: int) -> int:
        """The state of the shorter strings of ``q``, of which ``p`` then ``w`` is the longest."""
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._new(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = clone
        while p != -1 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, w: int) -> int:
        if w in self.next[last]:
            return self._split(last, w, self.next[last][w])
        state, p = self._new(self.length[last] + 1, {}, 0), last
        while p != -1 and w not in self.next[p]:
            self.next[p][w] = state
            p = self.link[p]
        if p != -1:
            self.link[state] = self._split(p, w, self.next[p][w])
        return state

    def _ancestor(self, state: int, length: int) -> int:
        """The state of the suffix of ``length`` words of ``state``."""
        while self.length[self.link[state]] >= length:
            state = self.link[state]
        return state

    def _mark(self, coded) -> None:
        """For each state the items that a match there completes, with the words that takes."""
        window_items: dict[int, set[int]] = {}
        short: dict[int, dict[int, set[int]]] = {}
        for number, (_, word_ids) in enumerate(coded):
            state = 0
            for at, w in enumerate(word_ids, 1):
                state = self.next[state][w]
                if at >= self.window:
                    state = self._ancestor(state, self.window)
                    window_items.setdefault(state, set()).add(number)
            if len(word_ids) < self.window:
                short.setdefault(state, {}).setdefault(len(word_ids), set()).add(number)
        self.items = [i for i, _ in coded]
        self.completes: list[tuple[tuple[int, tuple[int, ...]], ...]] = [()] * len(self.next)
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            own = [(self.window, tuple(window_items[state]))] if state in window_items else []
            own += [(n, tuple(numbers)) for n, numbers in short.get(state, {}).items()]
            self.completes[state] = self.completes[self.link[state]] + tuple(own)

    def match(self, words: list[bytes]) -> tuple[np.ndarray | None, set[int]]:
        """Hit flags of the words (None: none is hit) and the numbers of the items met."""
        if len(words) < self.shortest or not self.items:
            return None, set()
        ids = np.fromiter(map(self.vocabulary.get, words, [-1] * len(words)), np.int32, len(words))
        edges = np.flatnonzero(np.diff(np.concatenate([[False], ids >= 0, [False]]).astype(np.int8)))
        starts, ends = edges[::2], edges[1::2]
        long = ends - starts >= self.shortest  # an item word missing from a stretch ends any match
        change, met = None, set()
        arcs, link, length = self.next, self.link, self.length
        for start, end in zip(starts[long].tolist(), ends[long].tolist()):
            state = matched = 0
            for at, w in enumerate(ids[start:end].tolist(), start + 1):
                while state and w not in arcs[state]:
                    state = link[state]
                    matched = length[state]
                if w in arcs[state]:
                    state, matched = arcs[state][w], matched + 1
                for n, numbers in self.completes[state]:
                    if n <= matched:
                        if change is None:
                            change = np.zeros(len(words) + 1, np.int32)
                        change[at - n] += 1
                        change[at] -= 1
                        met.update(numbers)
        return (None if change is None else np.cumsum(change[:-1]) > 0), met


def build_automaton(items: DataFrame, window: int, max_item_chars: int) -> ItemAutomaton:
    """The automaton of ``items`` (item_id, text), whose total length must be below a limit."""
    rows = items.select(F.col("item_id").cast("string").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    chars = rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first().n
    if chars > max_item_chars:
        raise ValueError(f"the items hold {chars} characters; the automaton is meant for {max_item_chars}: split them")
    return ItemAutomaton([(r.item_id, words_of(r.text)) for r in rows.collect()], window)


def hit_spans(text: str, hit: np.ndarray) -> list[tuple[int, int]]:
    """Character ranges of the runs of hit words."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))
    places = [m.span() for m in WORD.finditer(text.translate(LOWER))]
    return [(places[a][0], places[b - 1][1]) for a, b in zip(edges[::2], edges[1::2])]


def without_spans(text: str, spans: list[tuple[int, int]]) -> str:
    parts, at = [], 0
    for start, end in spans:
        parts.append(text[at:start])
        at = end
    return "".join([*parts, text[at:]])


def decontaminate(
    docs: DataFrame, items: DataFrame, *, window: int = 13, words_per_hit: int = 20,
    remove_chars: int = 0, max_item_chars: int = 200_000_000,
) -> DataFrame:
    """All columns of every row of ``docs`` (with ``text``), and what was found in its text.

    ``contaminated``: at least one in ``words_per_hit`` words is hit. ``cleaned`` is the text without
    the spans longer than ``remove_chars``, null where the document is contaminated. Item ids
    are sorted as strings. The columns added replace columns of the same name.
    """
    automaton = docs.sparkSession.sparkContext.broadcast(build_automaton(items, window, max_item_chars))
    own = [c for c in docs.columns if c not in ADDED]
    schema = T.StructType([docs.schema[c] for c in own] + T._parse_datatype_string(RESULT).fields)

    def stream(batches):
        known = automaton.value
        types = [pa.int64(), pa.int64(), pa.list_(pa.string()), SPANS, pa.string(), pa.bool_()]
        for batch in batches:
            found = []
            for text in batch.column("text").to_pylist():
                words = words_of(text or "")
                hit, met = known.match(words)
                n_hit = 0 if hit is None else int(hit.sum())
                spans = hit_spans(text, hit) if n_hit else []
                bad = n_hit > 0 and words_per_hit * n_hit >= len(words)
                cut = [s for s in spans if s[1] - s[0] > remove_chars]
                found.append((len(words), n_hit, sorted({i for n in met if (i := known.items[n]) is not None}),
                              [{"start": a, "end": b} for a, b in spans],
                              None if bad else without_spans(text, cut) if cut else text, bad))
            columns = zip(*found) if found else [[]] * len(types)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *(pa.array(c, t) for c, t in zip(columns, types))], names=[*own, *ADDED])

    return docs.select(own).mapInArrow(stream, schema)


def contamination_report(docs: DataFrame, items: DataFrame, *, window: int = 13,
                         max_item_chars: int = 200_000_000) -> DataFrame:
    """Counts of :func:`decontaminate` by document, without its texts; contaminated from a twentieth of the words."""
    automaton = docs.sparkSession.sparkContext.broadcast(build_automaton(items, window, max_item_chars))

    def stream(batches):
        known = automaton.value
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), each_text(batch, "text")):
                words = words_of(text)
                hit, met = known.match(words)
                ids = sorted({i for n in met if (i := known.items[n]) is not None})
                rows.append((doc_id, len(words), 0 if hit is None else int(hit.sum()), len(ids),
                             hashlib.sha256(",".join(ids).encode()).hexdigest()))
            columns = zip(*rows) if rows else [[]] * 5
            types = [pa.int64()] * 4 + [pa.string()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types)],
                names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256"])

    found = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(
        stream, "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string")
    return found.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
