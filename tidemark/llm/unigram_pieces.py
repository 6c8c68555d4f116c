"""SentencePiece encoding by unigram Viterbi over a double-array trie, and decoding.

Pieces and log scores are read from a SentencePiece model file. Where the file is a merge model, whose
stored scores are merge ranks, piece ``r`` gets the Zipf log probability ``-ln(r + 1) - ln(H)``
(``H``: the sum of ``1 / (r + 1)``), so the best segmentation is still a sum of log scores.
White space is marked: a dummy space is put in front and every space becomes U+2581. A character
that no piece covers is spelled in byte pieces.

No piece holds the marker after another character (checked), so the best path of a text is the
chain of the best paths of its stretches "markers, then other characters"; each distinct
stretch is segmented once per worker and kept.

Edge cases: null and empty texts have no pieces and decode to the empty text; among paths of
equal score the one with the longest last piece wins; U+2581 in a text decodes
as a space, which ``round_trip`` shows; rows repeat as they come.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import crc, kept_by_worker, texts_of

MARK = "▁"
STRETCH = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
#: An uncovered character costs this much more than the worst piece.
UNKNOWN_COST = 10.0
UNREACHED = -math.inf
SCORE_STEPS = 2**20
KEPT_CHARS = 64
#: Stretches up to this length are segmented together, so many at a time.
TOGETHER_BYTES, TOGETHER = 64, 8192


@dataclass
class DoubleArray:
    """Byte trie: the child of ``s`` by byte ``b`` is ``t = base[s] + b + 1`` where ``check[t] == s``."""

    base: list[int]
    check: list[int]
    value: list[int]

    @classmethod
    def build(cls, keys: dict[bytes, int]) -> DoubleArray:
        root: dict = {}
        for key in keys:
            node = root
            for byte in key:
                node = node.setdefault(byte, {})
            node[-1] = keys[key]
        base, check, value = [0] * 512, [-1] * 512, [-1] * 512
        check[0], free, waiting = 0, 1, [(0, root)]
        while waiting:
            slot, node = waiting.pop()
            value[slot] = node.pop(-1, -1)
            if not node:
                continue
            labels = sorted(node)
            while free < len(check) and check[free] >= 0:
                free += 1
            at, tries = max(0, free - labels[0] - 1), 0
            while True:
                if at + 258 > len(check):
                    for column, fill in ((base, 0), (check, -1), (value, -1)):
                        column.extend([fill] * max(512, len(column) // 2))
                if all(check[at + b + 1] < 0 for b in labels):
                    break
                at, tries = at + 1, tries + 1
            if tries > 100:  # the front is crowded: leave its gaps
                free = max(free, at - 100)
            base[slot] = at
            for b in labels:
                check[at + b + 1] = slot
                waiting.append((at + b + 1, node[b]))
        pad = [-1] * 258  # no bounds test while walking
        return cls(base + [0] * 258, check + pad, value + pad)


@dataclass
class Pieces:
    """Vocabulary of a model file, its trie and its scores."""

    texts: list[bytes]
    scores: list[float]
    trie: DoubleArray
    byte_ids: list[int]
    unknown_id: int
    unknown_score: float

    @classmethod
    def load(cls, path: str) -> Pieces:
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        kinds = proto.ModelProto.SentencePiece
        scores = [p.score for p in model.pieces]
        if model.trainer_spec.model_type != proto.TrainerSpec.UNIGRAM:
            scores = zipf_scores(scores)
        scores = [round(s * SCORE_STEPS) / SCORE_STEPS for s in scores]  # sums are exact, so ties are ties
        keys, byte_ids, unknown = {}, [-1] * 256, 0
        texts: list[bytes] = []
        for number, piece in enumerate(model.pieces):
            text = piece.piece.encode()
            if piece.type in (kinds.NORMAL, kinds.USER_DEFINED):
                if MARK in piece.piece.lstrip(MARK):
                    raise ValueError(f"piece {piece.piece!r} holds the marker after another character")
                keys[text] = number
            elif piece.type == kinds.BYTE:
                byte_ids[int(piece.piece[1:-1], 16)] = number
                text = bytes([int(piece.piece[1:-1], 16)])
            else:
                unknown = number if piece.type == kinds.UNKNOWN else unknown
                text = b""
            texts.append(text)
        worst = min(scores[i] for i in keys.values())
        return cls(texts, scores, DoubleArray.build(keys), byte_ids, unknown, worst - UNKNOWN_COST)

    def segment(self, stretch: bytes) -> tuple[list[int], float]:
        """Best ids and their log score of one stretch of marked UTF-8."""
        n = len(stretch)
        best, came, by = [UNREACHED] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        best[0] = 0.0
        base, check, value, scores = self.trie.base, self.trie.check, self.trie.value, self.scores
        for start in range(n):
            so_far = best[start]
            if so_far == UNREACHED:
                continue
            state, at, first = 0, start, -1
            for byte in stretch[start:]:
                child = base[state] + byte + 1
                if check[child] != state:
                    break
                state, at = child, at + 1
                piece = value[state]
                if piece >= 0:
                    if first < 0:
                        first = at
                    score = so_far + scores[piece]
                    if score > best[at]:
                        best[at], came[at], by[at] = score, start, piece
            lead = stretch[start]
            end = start + (1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4)
            if first != end and so_far + self.unknown_score > best[end]:  # no piece is the character alone
                best[end], came[end], by[end] = so_far + self.unknown_score, start, -1
        ids: list[int] = []
        at = n
        while at:
            start, piece = came[at], by[at]
            if piece >= 0:
                ids.append(piece)
            else:
                ids.extend(self.byte_ids[b] if self.byte_ids[b] >= 0 else self.unknown_id
                           for b in reversed(stretch[start:at]))
            at = start
        return ids[::-1], best[n]

    def segment_together(self, stretches: list[bytes]) -> list[tuple[bytes, float]]:
        """What :meth:`segment` finds, for many short stretches at once; ids as bytes."""
        n, lengths = len(stretches), np.array(list(map(len, stretches)))
        width = int(lengths.max())
        text = np.zeros((n, width), np.int64)
        text[np.arange(width) < lengths[:, None]] = np.frombuffer(b"".join(stretches), np.uint8)
        base, check, value, scores, spelled = self.arrays
        best = np.full((n, width + 1), UNREACHED)
        came, by = np.zeros((n, width + 1), np.int32), np.full((n, width + 1), -1, np.int32)
        best[:, 0] = 0.0
        for start in range(width):
            here = np.flatnonzero((best[:, start] > UNREACHED) & (lengths > start))
            so_far = best[here, start]
            lead = text[here, start]
            ends = start + 1 + (lead >= 0xC0) + (lead >= 0xE0) + (lead >= 0xF0)
            alone = np.zeros(n, bool)  # has a piece that is just the character
            walking, state, score = here, np.zeros(len(here), np.int64), so_far
            end_of = np.zeros(n, np.int64)
            end_of[here] = ends
            for at in range(start, width):
                child = base[state] + text[walking, at] + 1
                go = (check[child] == state) & (lengths[walking] > at)
                walking, state, score = walking[go], child[go], score[go]
                if not len(walking):
                    break
                piece = value[state]
                hit = piece >= 0
                rows, piece, total = walking[hit], piece[hit], score[hit] + scores[piece[hit]]
                alone[rows[end_of[rows] == at + 1]] = True
                better = total > best[rows, at + 1]
                rows = rows[better]
                best[rows, at + 1], came[rows, at + 1], by[rows, at + 1] = total[better], start, piece[better]
            unknown = ~alone[here] & (so_far + self.unknown_score > best[here, ends])
            rows, to = here[unknown], ends[unknown]
            best[rows, to], came[rows, to] = so_far[unknown] + self.unknown_score, start
            by[rows, to] = np.where(to == start + 1, spelled[lead[unknown]], -1)
        rows, at, steps = np.arange(n), lengths.copy(), []
        odd = np.zeros(n, bool)
        while len(rows):
            piece = by[rows, at]
            odd[rows[piece < 0]] = True
            steps.append((rows, piece))
            at = came[rows, at].astype(np.int64)
            rows, at = rows[at > 0], at[at > 0]
        owner = np.concatenate([r for r, _ in steps[::-1]])
        ids = np.concatenate([p for _, p in steps[::-1]])[np.argsort(owner, kind="stable")].astype("<i4")
        bounds = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))]) * 4
        flat, total = ids.tobytes(), best[np.arange(n), lengths].tolist()
        found = [(flat[x:y], t) for x, y, t in zip(bounds.tolist(), bounds[1:].tolist(), total)]
        for i in np.flatnonzero(odd).tolist():  # characters of several bytes that are spelled
            alone_ids, score = self.segment(stretches[i])
            found[i] = np.array(alone_ids, "<i4").tobytes(), score
        return found

    @cached_property
    def arrays(self) -> tuple[np.ndarray, ...]:
        spelled = np.array([i if i >= 0 else self.unknown_id for i in self.byte_ids])
        return (*(np.array(c) for c in (self.trie.base, self.trie.check, self.trie.value)), np.array(self.scores), spelled)

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids: bytes joined, markers back to spaces, without the dummy space."""
        raw = b"".join(map(self.texts.__getitem__, ids.tolist())).replace(MARK.encode(), b" ")
        return raw.removeprefix(b" ").decode("utf-8", "replace")


def zipf_scores(ranks: list[float]) -> list[float]:
    """Log probabilities of pieces whose scores are negated merge ranks."""
    total = math.log(sum(1 / (1 - r) for r in ranks))
    return [-math.log(1 - r) - total for r in ranks]


class PieceEncoder:
    """Segments whole texts; each distinct stretch is solved once and kept by the worker."""

    def __init__(self, pieces: Pieces, kept: int = 600_000):
        self.pieces, self.kept = pieces, kept
        self.ids: dict[str, bytes] = {}
        self.scores: dict[str, float] = {}

    @classmethod
    def of_worker(cls, broadcast) -> PieceEncoder:
        pieces = broadcast.value
        return kept_by_worker((cls, id(pieces)), lambda: cls(pieces))

    @staticmethod
    def stretches(text: str) -> list[str]:
        """Stretches of the marked text; a lone mark in front of a stretch is left out."""
        if not text:
            return []
        if "  " not in text and MARK not in text and text[0] != " " and text[-1] != " ":
            return text.split(" ")
        found = STRETCH.findall(MARK + text.replace(" ", MARK))
        return [s[1:] if s[:1] == MARK and s[1:2] not in (MARK, "") else s for s in found]

    def _learn(self, parts: list[str]) -> None:
        marked = [(p if p[0] == MARK else MARK + p).encode("utf-8", "surrogatepass") for p in parts]
        order = sorted(range(len(parts)), key=lambda i: len(marked[i]))
        short = [i for i in order if len(marked[i]) <= TOGETHER_BYTES]
        for at in range(0, len(short), TOGETHER):
            group = short[at:at + TOGETHER]
            for i, found in zip(group, self.pieces.segment_together([marked[i] for i in group])):
                self.ids[parts[i]], self.scores[parts[i]] = found
        for i in order[len(short):]:
            ids, self.scores[parts[i]] = self.pieces.segment(marked[i])
            self.ids[parts[i]] = np.array(ids, "<i4").tobytes()

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, float]]:
        """Ids and log score of each text."""
        if len(self.ids) > self.kept:
            self.ids, self.scores = {}, {}
        parts = list(map(self.stretches, texts))
        new = list(set().union(*parts).difference(self.ids))
        self._learn(new)
        found = [(np.frombuffer(b"".join(map(self.ids.__getitem__, p)), "<i4"),
                  sum(map(self.scores.__getitem__, p))) for p in parts]  # sums are exact, see SCORE_STEPS
        for part in new:
            if len(part) > KEPT_CHARS:
                del self.ids[part], self.scores[part]
        return found


def encode_pieces(docs: DataFrame, model_path: str, *, with_ids: bool = True) -> DataFrame:
    """Pieces of every whole text: counts, score, checksum, the round trip and, on wish, the ids.

    ``docs`` needs doc_id and text. ``model_path`` must be readable on the driver; the vocabulary is
    sent to the executors (its size is the model file's, fixed).
    """
    pieces = docs.sparkSession.sparkContext.broadcast(Pieces.load(model_path))
    schema = ("doc_id bigint, n_pieces bigint, n_byte_pieces bigint, ids_crc32 bigint, log_score double, "
              "round_trip boolean" + (", ids array<int>" if with_ids else ""))

    def stream(batches):
        encoder = PieceEncoder.of_worker(pieces)
        vocabulary = encoder.pieces
        is_byte = np.zeros(len(vocabulary.texts), bool)
        is_byte[[b for b in vocabulary.byte_ids if b >= 0]] = True
        for batch in batches:
            ids_of, texts = batch.column(0).to_pylist(), texts_of(batch, "text")
            for at in range(0, len(texts), 500):
                rows = []
                part = texts[at:at + 500]
                for doc_id, text, (ids, score) in zip(ids_of[at:at + 500], part, encoder.encode(part)):
                    rows.append((doc_id, len(ids), int(is_byte[ids].sum()), crc(ids), score,
                                 vocabulary.decode(ids) == text, ids))
                columns = list(zip(*rows))
                arrays = [pa.array(c, t) for c, t in zip(
                    columns, [pa.int64()] * 4 + [pa.float64(), pa.bool_()])]
                if with_ids:
                    offsets = np.concatenate([[0], np.cumsum([len(i) for i in columns[6]])]).astype(np.int32)
                    arrays.append(pa.ListArray.from_arrays(offsets, np.concatenate(columns[6])))
                yield pa.RecordBatch.from_arrays(arrays, names=[c.split()[0] for c in schema.split(", ")])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(stream, schema)


def decode_pieces(rows: DataFrame, model_path: str, ids: str = "ids", out: str = "text") -> DataFrame:
    """``rows`` with the text of the ``ids`` column; a null list gives null."""
    pieces = rows.sparkSession.sparkContext.broadcast(Pieces.load(model_path))

    @F.pandas_udf("string")
    def text_of(column):
        return column.map(lambda i: None if i is None else pieces.value.decode(np.asarray(i)))

    return rows.withColumn(out, text_of(F.col(ids)))
