import random

import numpy as np
import pytest

from tidemark.llm.queries import tokenizer_path
from tidemark.llm.unigram_pieces import DoubleArray, PieceEncoder, Pieces, decode_pieces, encode_pieces, zipf_scores

MODEL = tokenizer_path("piece_bpe_32k.model")
ODD = ["a", " ", "  two  spaces ", "x\n\ty", "日本語 naïve 𝄞 ☃", "worthless   tail   ", "é" * 300, "a b" * 2000]


@pytest.fixture(scope="module")
def library(tmp_path_factory):
    """The same pieces and scores as a unigram model of the library."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = proto.ModelProto()
    model.ParseFromString(open(MODEL, "rb").read())
    for piece, score in zip(model.pieces, zipf_scores([p.score for p in model.pieces])):
        piece.score = score
    model.trainer_spec.model_type = proto.TrainerSpec.UNIGRAM
    path = tmp_path_factory.mktemp("m") / "unigram.model"
    path.write_bytes(model.SerializeToString())
    return sentencepiece.SentencePieceProcessor(model_file=str(path)), str(path)


def test_trie_holds_exactly_its_keys():
    rng = random.Random(3)
    keys = {bytes(rng.choice(b"abc\xff") for _ in range(rng.randrange(1, 7))): i for i in range(300)}
    trie = DoubleArray.build(keys)

    def find(key):
        state = 0
        for b in key:
            child = trie.base[state] + b + 1
            if trie.check[child] != state:
                return -1
            state = child
        return trie.value[state]

    assert all(find(k) == v for k, v in keys.items())
    assert all(find(k + b"\x00") == -1 for k in keys)


def test_best_paths_are_the_librarys(library, prose, spark):
    processor, path = library
    texts = ODD + [prose(i, 80) for i in range(20)]
    texts += [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).collect()]
    ours, stored = PieceEncoder(Pieces.load(MODEL)), PieceEncoder(Pieces.load(path))
    same = 0
    for text in texts:
        (ids, score), = ours.encode([text])
        theirs = processor.encode(text)
        assert ours.pieces.decode(ids) == text
        assert stored.encode([text])[0][1] == pytest.approx(score, abs=1e-3)
        if not any(map(processor.is_byte, theirs)):
            assert score == pytest.approx(sum(ours.pieces.scores[i] for i in theirs), abs=1e-3)
        same += ids.tolist() == theirs
    assert same > 0.8 * len(texts)  # the rest are ties


def test_brute_force_on_short_words():
    pieces = Pieces.load(MODEL)
    known = {t: i for i, t in enumerate(pieces.texts) if t and i not in pieces.byte_ids}

    def best(word):
        if not word:
            return 0.0
        return max((pieces.scores[known[word[:n]]] + best(word[n:]) for n in range(1, len(word) + 1) if word[:n] in known),
                   default=-1e9)

    for word in ["▁there", "▁ththnti", "▁shing", "tion"]:
        assert pieces.segment(word.encode())[1] == pytest.approx(best(word.encode()))


def test_together_equals_one_by_one(spark):
    pieces = Pieces.load(MODEL)
    rng = random.Random(8)
    words = ["▁" + "".join(rng.choice("aehtn.,é日☃\n#&") for _ in range(rng.randrange(12))) for _ in range(2000)]
    words += list({"▁" + w for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(80).collect() for w in r.text.split(" ") if w})
    raw = [w.encode() for w in words]
    for (ids, score), word in zip(pieces.segment_together(raw), raw):
        assert (np.frombuffer(ids, "<i4").tolist(), score) == pieces.segment(word)


def test_documents(spark, documents):
    rows = {r.doc_id: r for r in encode_pieces(documents("", None, "▁", *ODD), MODEL).collect()}
    assert rows[0].n_pieces == rows[1].n_pieces == 0 and rows[0].round_trip and rows[1].round_trip
    assert not rows[2].round_trip and all(rows[i].round_trip for i in range(3, len(ODD) + 3))
    assert rows[7].n_byte_pieces > 0
    back = decode_pieces(encode_pieces(documents(*ODD), MODEL), MODEL).orderBy("doc_id").collect()
    assert [r.text for r in back] == ODD
    assert encode_pieces(documents("a").limit(0), MODEL).count() == 0
    assert np.asarray(back[0].ids).dtype.kind == "i"
