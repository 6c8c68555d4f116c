import zlib

import numpy as np
import pytest

from tidemark.llm.arrow_tokens import TokenShard, token_files, write_token_files
from tidemark.llm.common import new_folder
from tidemark.llm.queries import tokenizer_path

TOKENIZER = tokenizer_path("byte_bpe_50k.json")
ODD = ["", None, " ", "a b", " a  b ", "x\n\ty  z  w 　 q", "it's we'll", "naïve 日本 " * 40,
       "<|endoftext|> in <|endoftext|>", "a\x1c b\x85 c", "#" * 5000, "word " * 3000, "tail   ",
       "".join(map(chr, range(1, 0x250))), " ".join(map(chr, range(1, 0x250))), "\n \n\t a\xa0 \xa0b\x85\x1d c ¼½2 a'sx '' 'rex"]


def expected(pairs):
    from tokenizers import Tokenizer

    tokenizer, at, rows = Tokenizer.from_file(TOKENIZER), 0, []
    for i, text in pairs:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        rows.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return rows


def test_equals_the_library(spark, documents, prose):
    texts = ODD + [prose(i, 5 + 40 * i) for i in range(40)]
    ids = [(11 * i) % len(texts) - 5 for i in range(len(texts))]
    docs = documents(*texts, ids=ids).repartition(3)
    got = sorted(tuple(r) for r in token_files(docs, TOKENIZER, end_id=2, length=16, batch_sequences=4).collect())
    assert got == expected(sorted(zip(ids, texts), key=lambda p: p[0]))


def test_null_and_repeated_ids_and_no_rows(spark, documents):
    docs = documents("same", "same", "other", None, ids=[None, 4, 4, 4])
    rows = token_files(docs, TOKENIZER, end_id=2).collect()
    assert sorted(r.n_tokens for r in rows) == [1, 2, 2, 2] and min(rows, key=lambda r: r.start).doc_id is None
    assert token_files(docs.limit(0), TOKENIZER, end_id=2).count() == 0


def test_sequences_are_views(spark, documents, prose):
    folder = new_folder(spark, "test")
    docs = documents(*[prose(i, 60) for i in range(9)]).coalesce(1)
    row = write_token_files(docs, folder, TOKENIZER, end_id=2, length=32, batch_sequences=2).first()
    shard = TokenShard(folder, row.tokens_file, row.docs_file)
    assert not shard.sequence(3).flags.owndata and len(shard.sequence(3)) == 32
    flat = np.concatenate([d[2] for d in shard.documents()])
    assert (flat[3 * 32:4 * 32] == shard.sequence(3)).all()
    last = (row.n_tokens - 1) // 32
    assert sum(shard.mask(last).to_pylist()) == row.n_tokens - last * 32
    with pytest.raises(Exception):
        shard.sequence(last + 2)
