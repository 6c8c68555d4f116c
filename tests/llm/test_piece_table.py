import hashlib
import random

import pytest

from tidemark.llm.piece_table import PieceTable, arrange, byte_offset, fill_in_middle, inverse, lead_bytes, restore, restored


def brute(doc_id, text):
    """The contract, by slices of a string."""
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i:i + 8], 16) for i in (0, 8, 16, 24))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    if h4 % 100 < 20:
        return n, "spm", a, b - a, f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", a, b - a, f"<P>{prefix}<S>{suffix}<M>{middle}"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def texts(count, seed=5):
    rng = random.Random(seed)
    alphabet = ["a", "é", "\u0000", "日", "😀", "\n", "<", "P", ">", "S", "<S", " "]
    made = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(count)]
    return [*made, "", None, "<P>", "x<M>y", "<" * 9, "é" * 200_000, "same", "same"]


def test_forms_cuts_and_hashes_equal_the_contract(documents):
    made = texts(400)
    ids = [*range(len(made) - 3), 7, 7, None]
    arranged = fill_in_middle(documents(*made, ids=ids))
    rows = restored(arranged, keep=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "output_sha256"]).collect()
    assert len(rows) == len(made)
    expected = sorted((str(i), *map(str, brute(i, t)), sha(brute(i, t)[4]), sha(t or ""), t or "") for i, t in zip(ids, made))
    got = sorted((str(r.doc_id), *map(str, (r.n, r.form, r.prefix_chars, r.middle_chars, r.output)), r.output_sha256, r.restored_sha256,
                  r.restored) for r in rows)
    assert got == expected
    assert {r.form for r in rows} == {"plain", "psm", "spm"}


def test_descriptors_rebuild_the_output(documents):
    made = texts(100, seed=6)
    for r, text in zip(sorted(fill_in_middle(documents(*made)).collect(), key=lambda r: r.doc_id), made):
        buffers = (text or "").encode(), b"<P><S><M>"
        assert b"".join(buffers[p.buffer][p.start:p.end] for p in r.pieces) == r.output.encode()


def test_every_pair_of_cuts_is_restored():
    text = "<<S é<P日"
    data = text.encode()
    assert lead_bytes(data) == len(text)
    for a in range(len(text) + 1):
        for b in range(a, len(text) + 1):
            for form in ("psm", "spm"):
                table = arrange(data, form, a, b)
                assert bytes(restore(bytes(table), form)) == data
                assert table.sha256() == hashlib.sha256(bytes(table)).hexdigest()


def test_permutations_have_inverses():
    table = PieceTable.of(b"abcdef").cut(2, 4)
    for order in ((0, 1, 2), (2, 0, 1), (1, 2, 0), (0, 2, 1)):
        assert table.permuted(order).permuted(inverse(order)).pieces == table.pieces
    assert [bytes(p) for p in table.cut(3).stream()] == [b"ab", b"c", b"d", b"ef"]


def test_offsets_across_stretches():
    data = ("é" * 40_000 + "a").encode()
    assert byte_offset(data, 39_999) == 79_998 and byte_offset(data, 40_000) == 80_000 and byte_offset(data, 40_001) == 80_001


def test_a_text_without_its_sentinel_is_refused():
    with pytest.raises(ValueError):
        restore(b"no sentinels", "psm")


def test_empty_table_and_clashing_columns(spark, documents):
    from pyspark.sql import functions as F

    assert fill_in_middle(documents("a").limit(0)).collect() == []
    extra = documents("one two").withColumn("form", F.lit(1)).withColumn("output", F.lit(2)).withColumn("pieces", F.lit("x"))
    assert [r.n for r in fill_in_middle(extra).collect()] == [7]
