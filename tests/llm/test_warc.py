import hashlib
import io
import random
import zlib

import pytest

from tidemark.llm.common import new_folder
from tidemark.llm.warc import (
    archive_round_trip, from_chunks, http_payload, join_segments, members, page_records, parse, read_archives, to_chunks, write_archives)

PAGES = "page_id bigint, url string, html string"


def test_chunked_framing():
    for n in (0, 1, 9, 10, 11, 1000):
        payload = random.Random(n).randbytes(n)
        assert from_chunks(to_chunks(payload, 10)) == payload
    assert from_chunks(b"3;x=1\r\nabc\r\n0\r\nTrailer: v\r\n\r\n") == b"abc"
    for bad in (b"5\r\nabc\r\n0\r\n\r\n", b"zz\r\n", b""):
        with pytest.raises(ValueError):
            from_chunks(bad)
    assert http_payload(b"HTTP/1.1 200 OK\r\nA: b\r\n\r\nplain") == b"plain"


def test_segments_must_be_whole():
    assert join_segments([(2, None, b"b"), (3, 3, b"c"), (1, None, b"a")]) == b"abc"
    for bad in ([(1, None, b"a")], [(1, None, b"a"), (3, 2, b"c")], [(1, None, b"a"), (2, 9, b"b")], [(2, 1, b"b")],
                [(1, None, b"a"), (1, None, b"a"), (2, 2, b"b")]):
        with pytest.raises(ValueError):
            join_segments(bad)


def expected(rows):
    raw = [(i, (h or "").encode()) for i, _, h in rows]
    largest = {}
    for i, b in raw:
        if len(b) >= 1000 and i is not None:
            largest[b] = max(i, largest.get(b, i))
    many = {b for _, b in raw if sum(x == b for _, x in raw) > 1}
    out = []
    for i, b in raw:
        to = largest.get(b) if b in many and largest.get(b) != i else None
        out.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if to is not None else "response", to, True))
    return sorted(out, key=repr)


def test_round_trip(spark):
    rng = random.Random(1)
    pages = [(i, f"http://h/{i}", "".join(rng.choice("abé日 \r\n") for _ in range(rng.choice([0, 5, 999, 1000, 70_000])))) for i in range(40)]
    pages += [(100 + i, "u", pages[3][2] or "z") for i in range(5)] + [(200 + i, "u", "q" * 1200) for i in range(30)]
    pages += [(300, None, None), (None, "a\r\nb", "n" * 2000), (301, "v", "n" * 2000), (None, "x", "alone" * 400),
              (302, "w", "twice" * 300), (302, "w", "twice" * 300), (303, "long", "w" * 400_000)]
    df = spark.createDataFrame(pages, PAGES).repartition(4)
    got = sorted((tuple(r) for r in archive_round_trip(df, segment_bytes=3000, chunk_bytes=700).collect()), key=repr)
    assert got == expected(pages)
    assert archive_round_trip(df.limit(0)).count() == 0


def test_payloads_come_back(spark):
    folder = new_folder(spark, "test-warc")
    df = spark.createDataFrame([(1, "u", "é" * 9000), (2, "v", "")], PAGES)
    rows = {r.page_id: r for r in read_archives(write_archives(df, folder, segment_bytes=500), folder).collect()}
    assert bytes(rows[1].payload).decode() == "é" * 9000 and rows[2].payload_bytes == 0 and rows[1].url == "u"


def test_segments_over_files(spark, tmp_path):
    """Segments in any order and file are joined; a record that lacks one is not complete."""
    def file(name, records):
        data = b"".join(zlib.compress(r, wbits=31) for r in records)
        (tmp_path / name).write_bytes(data)
        return str(tmp_path / name)

    one = list(page_records(1, "u", b"a" * 5000, "d", None, "x", 900, 400))
    two = list(page_records(2, "u", b"b" * 5000, "d", None, "y", 900, 400))
    names = [file("a", [one[3], two[0], one[1]]), file("b", one[4:] + one[:1]), file("c", [one[2], *two[2:]])]
    manifest = spark.createDataFrame([(n,) for n in names], "file string")
    rows = {r.page_id: r for r in read_archives(manifest, str(tmp_path)).collect()}
    assert bytes(rows[1].payload) == b"a" * 5000 and rows[1].complete
    assert not rows[2].complete and rows[2].payload is None


def test_members_and_fields():
    text = next(iter(page_records(7, "http://x/\n", b"hi", "d", None, "k", 900, 400)))
    packed = zlib.compress(text, wbits=31)
    assert [parse(m)[0]["warc-target-uri"] for m in members(io.BytesIO(packed * 3))] == ["http://x/%0A"] * 3
    with pytest.raises(ValueError):
        list(members(io.BytesIO(packed[:-12])))
