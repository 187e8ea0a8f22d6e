import base64
import hashlib
import zlib

import pytest

from ledgerwake.llm import warc
from ledgerwake.llm.common import fresh_path


def test_round_trip(spark):
    html = ["<p>one</p>", None, "<p>one</p>", "", "é" * 70_000, "<p>one</p>", "a\r\n\r\nWARC/1.1\r\n\r\n"]
    pages = spark.createDataFrame([(k, f"http://h/{k}\r\nx", x, 1) for k, x in enumerate(html)], "page_id long, url string, html string, payload int")
    got = {r.page_id: r for r in warc.archive_round_trip(pages).collect()}
    assert len(got) == len(html)
    for k, x in enumerate(html):
        data = (x or "").encode()
        first = next(j for j, y in enumerate(html) if (y or "") == (x or ""))
        assert got[k].payload_bytes == len(data) and got[k].payload_digest == base64.b32encode(hashlib.sha1(data).digest()).decode()
        assert (got[k].record_type, got[k].refers_to) == (("response", None) if first == k else ("revisit", first))


def test_members_are_indexed(spark):
    pages = spark.createDataFrame([(k, None, f"page {k}") for k in range(40)], "page_id long, url string, html string")
    folder = fresh_path(spark, "warc-test")
    archives = warc.normalise(warc.write_monolithic(warc.with_revisits(pages), f"{folder}/a", most_bytes=2000), f"{folder}/b")
    index = warc.read_index(spark, archives).collect()
    assert sorted(e.page_id for e in index) == list(range(40)) and len({e.path for e in index}) > 1
    assert warc.archive_round_trip(pages.limit(0)).count() == 0


def test_cut_off_stream():
    record = warc.build_record(1, "http://h/", b"x" * 3000, warc.payload_digest(b"x" * 3000), None, False)
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    pieces = [packer.compress(record) + packer.flush(zlib.Z_SYNC_FLUSH) for _ in range(3)]
    whole = b"".join(pieces) + packer.flush()
    assert len(list(warc.split_stream(warc.inflate(iter([whole]))))) == 3
    assert len(list(warc.split_stream(warc.inflate(iter([warc.member(record), warc.member(record)]))))) == 2
    for cut in (len(pieces[0] + pieces[1]), len(whole) - 1, 5):  # the first one falls between two records
        with pytest.raises(ValueError):
            list(warc.split_stream(warc.inflate(iter([whole[:cut]]))))


def foreign(kind, block, *more, length=None):
    head = ["WARC/1.0", f"WARC-Type:{kind}", f"warc-record-id:<urn:x:{kind}>", *more, f"Content-Length:   {len(block) if length is None else length}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def test_archives_of_others(spark, tmp_path):
    http = b"HTTP/1.1 200 OK\r\nContent-Type:text/html\r\nX-Folded: a\r\n b: c\r\nContent-Length:5\r\n\r\n"
    records = [
        foreign("warcinfo", b"software: x\r\nformat: y\r\n\r\nz", "Content-Type: application/warc-fields"),
        foreign("request", b"GET / HTTP/1.1\r\nHost:h\r\n\r\n", "Content-Type:application/http;msgtype=request", "WARC-Target-URI:http://h/:80"),
        foreign("response", http + b"hello", "Content-Type:\tapplication/http; msgtype=response", "WARC-Target-URI:http://h/:80"),
        foreign("revisit", http, "Content-Type: application/http", "WARC-Payload-Digest:sha1:ABC"),
        foreign("revisit", b"", "Content-Type: application/http"),
        foreign("resource", b"\0\1\2", "Content-Type: image/png"),
        foreign("metadata", b""),
    ]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    whole = packer.compress(records[0] + b"\r\n" + b"".join(records[1:4])) + packer.flush() + b"\0" * 700
    whole += b"".join(map(warc.member, records[4:])) + b"\0" * (2 << 20)
    (tmp_path / "a.warc.gz").write_bytes(whole)
    folder = fresh_path(spark, "warc-foreign")
    archives = warc.normalise(spark.createDataFrame([(f"file://{tmp_path}/a.warc.gz",)], "path string"), f"{folder}/b")
    index = sorted(warc.read_index(spark, archives).collect(), key=lambda e: e.offset)
    kinds = ["warcinfo", "request", "response", "revisit", "revisit", "resource", "metadata"]
    assert [e.record_type for e in index] == kinds and [e.record_id for e in index] == [f"<urn:x:{k}>" for k in kinds]
    assert [e.target_uri for e in index] == [None, "http://h/:80", "http://h/:80", None, None, None, None]
    path = archives.first().path.removeprefix("file://")
    with open(path, "rb") as file:
        for entry, record in zip(index, records, strict=True):
            file.seek(entry.offset)
            assert zlib.decompress(file.read(entry.length), 31) == record  # unchanged
    digest = lambda x: base64.b32encode(hashlib.sha1(x).digest()).decode()
    blocks = [b"software: x\r\nformat: y\r\n\r\nz", b"", b"hello", None, None, b"\0\1\2", b""]
    want = [(None, 5, "ABC", "revisit", None) if k == 3 else (None, None, None, "revisit", None) if x is None else (None, len(x), digest(x), kinds[k], None) for k, x in enumerate(blocks)]
    got = [tuple(r) for r in warc.read_records(archives).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


@pytest.mark.parametrize("end", [b"\0\0\0x", b"\0\x1f\x8b"])
def test_padding_is_zero_bytes_alone(end):
    record = foreign("metadata", b"m")
    with pytest.raises((ValueError, zlib.error)):
        list(warc.split_stream(warc.inflate(iter([warc.member(record), end]))))
    with pytest.raises((ValueError, zlib.error)):
        list(warc.inflate(iter([b"\0\0" + warc.member(record)])))
