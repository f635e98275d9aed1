import base64
import hashlib

import pytest
import zstandard

from clauseforge.llm import warc as W


def test_archive_round_trip_with_and_without_dictionary():
    records = [W.record(i, f"http://x/{i}", b"<p>hello %d</p>" % i * 20) for i in range(200)]
    for dictionary in (b"", W.train_dictionary(records)):
        assert list(W.unpack(W.pack(records, dictionary))) == records
    assert W.train_dictionary(records) and W.train_dictionary([b"x"]) == b""
    big = [W.record(1, "u", bytes(range(256)) * 4000)]
    assert list(W.unpack(W.pack(big))) == big and list(W.unpack(b"")) == []


def test_compressed_dictionary_frame():
    import struct

    records = [W.record(i, "u", b"abc" * i) for i in range(60)]
    plain = W.pack(records, d := W.train_dictionary([r * 3 for r in records], 2048))
    packed = zstandard.ZstdCompressor().compress(d)
    frames = plain[8 + len(d) :]
    assert list(W.unpack(struct.pack("<II", W.DICTIONARY_FRAME, len(packed)) + packed + frames)) == records


@pytest.mark.parametrize("spoil", [lambda a: a[:-3], lambda a: a + b"junk", lambda a: a[:4] + b"\xff\xff\xff\x00" + a[8:]])
def test_faulty_archives_are_refused(spoil):
    with pytest.raises(ValueError):
        list(W.unpack(spoil(W.pack([W.record(1, "u", b"x" * 100)]))))


@pytest.mark.parametrize(
    "spoil", [lambda r: r.replace(b"WARC/1.1", b"WARC/9.9"), lambda r: r[:-1], lambda r: r.replace(b"WARC-Date", b"X-Date"), lambda r: r.replace(b"xxx", b"yyy"), lambda r: r.replace(b"WARC-Type: ", b"WARC-Type")]
)
def test_faulty_records_are_refused(spoil):
    raw = W.record(1, "http://u", b"xxx")
    W.parse_record(raw)
    with pytest.raises(ValueError):
        W.parse_record(spoil(raw))


def test_pages(spark):
    rows = [(5, "http://a\n b", "same", 1), (2, None, "same", 1), (9, "u", "", 1), (8, "u", None, 1), (7, "u", "é" * 70_000, 1), (None, "u", "same", 1), (2, "v", "same", 2)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, payload int")
    got = [r.asDict() for r in W.archive_round_trip(df).collect()]
    assert len(got) == len(rows)
    kinds = sorted((r["page_id"] or 0, r["record_type"], r["refers_to"]) for r in got)
    assert kinds == [(0, "revisit", 2), (2, "response", None), (2, "response", None), (5, "revisit", 2), (7, "response", None), (8, "response", None), (9, "revisit", 8)]
    for r in got:
        want = {5: "same", 2: "same", None: "same", 7: "é" * 70_000}.get(r["page_id"], "").encode()
        assert r["payload_bytes"] == len(want) and r["payload_digest"] == base64.b32encode(hashlib.sha1(want).digest()).decode()
    assert {r.page_id for r in W.archive_round_trip(df, min_bytes=10).where("record_type = 'revisit'").collect()} == set()
    assert W.archive_round_trip(df.where("false")).isEmpty()
