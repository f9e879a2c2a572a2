import gzip
import hashlib
import base64
from collections import Counter

from evidentia.llm import warc

PAGES = [
    (1, "http://a.example/x", "<html><head><title> T  i </title><style>no{}</style></head><body><p>One &amp; two</p><a href='/l'>link</a><script>bad()</script></body></html>"),
    (2, None, None),
    (3, "http://a.example/y", ""),
    (None, "http://a.example/z", "plain \r\n\r\n text"),
    (1, "http://a.example/x", "<p>again</p>"),
    (4, "http://a.example/p", "<pre>a\n b</pre>c\nd"),
]


def sha1(data):
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def test_linked_records(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").selectExpr("*", "1 as record", "2 as record_id")
    responses = warc.page_responses(pages)
    rows = warc.derive(responses).collect()
    assert Counter(r.record_type for r in rows) == {"metadata": 6, "conversion": 6}
    by_source = {warc.parse(bytes(r.record))[0]["warc-record-id"]: warc.parse(bytes(r.record)) for r in responses.collect()}
    for r in rows:
        headers, block = warc.parse(bytes(r.record))
        source, source_block = by_source[r.refers_to]
        assert headers["warc-refers-to"] == r.refers_to == source["warc-record-id"]
        assert headers["warc-type"] == r.record_type and headers["warc-date"] == source["warc-date"]
        assert headers.get("warc-target-uri") == source.get("warc-target-uri") == r.target_uri
        assert headers["warc-block-digest"] == sha1(block) == r.block_digest and len(block) == r.content_length
        assert r.source_digest == source["warc-payload-digest"] == sha1(source_block.partition(b"\r\n\r\n")[2])
        if r.record_type == "metadata":
            assert b"source-status: HTTP/1.1 200 OK" in block and b"source-header-content-type: text/html; charset=utf-8" in block
    texts = Counter(warc.parse(bytes(r.record))[1].decode() for r in rows if r.record_type == "conversion")
    assert texts == {"One & two\nlink": 1, "": 2, "plain text": 1, "again": 1, "a\nb\nc d": 1}
    # the same input makes the same records
    assert Counter(map(str, rows)) == Counter(map(str, warc.derive(warc.page_responses(pages)).collect()))


def test_files_round_trip(spark, tmp_path):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    records = [bytes(r.record) for r in warc.page_responses(pages).collect()]
    (tmp_path / "a.warc").write_bytes(b"".join(records))
    read = warc.read_warc(spark, f"file://{tmp_path}/a.warc")
    assert Counter(bytes(r.record) for r in read.collect()) == Counter(records)
    derived = warc.derive(read)
    assert derived.count() == 2 * len(records)
    (tmp_path / "b.warc").write_bytes(b"".join(bytes(r.record) for r in derived.collect()))
    assert warc.read_warc(spark, f"file://{tmp_path}/b.warc").count() == 2 * len(records)
    assert warc.derive(warc.read_warc(spark, f"file://{tmp_path}/b.warc")).count() == 0


def test_unreadable_records(spark):
    rows = spark.createDataFrame([(1, bytearray(b"junk")), (2, None), (3, bytearray(b"WARC/1.1\r\nContent-Length: x\r\n\r\n"))], "page_id long, record binary")
    assert warc.derive(rows).count() == 0


def test_empty_table(spark):
    assert warc.derive(warc.page_responses(spark.createDataFrame([], "page_id long, url string, html string"))).count() == 0


def response(head, body):
    block = b"HTTP/1.1 200 OK\r\n" + head + b"\r\n\r\n" + body
    return warc.build([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:x>"), ("WARC-Date", "2024-01-01T00:00:00Z")], block)


def texts_of(record):
    meta, conversion = warc.derivatives(record)
    return warc.parse(conversion["record"])[1].decode(), warc.parse(meta["record"])[1].decode()


def test_bodies_are_decoded_as_their_headers_say():
    page = "<title>Café</title><body>naïve<a href='/x'>y</a><a href='/x'>z</a>"
    assert texts_of(response(b"Content-Type: text/html; charset=ISO-8859-1", page.encode("latin-1")))[0] == "Café\nnaïveyz"
    assert texts_of(response(b"Content-Type: text/html", b"<meta charset='windows-1251'><p>" + "привет".encode("cp1251")))[0] == "привет"
    assert texts_of(response(b"Content-Type: text/html; charset=no-such", "<p>é".encode()))[0] == "é"
    chunked = b"4\r\n<p>h\r\n2;a=b\r\ni \r\n5\r\nthere\r\n0\r\n\r\n"
    assert texts_of(response(b"Transfer-Encoding: chunked", chunked))[0] == "hi there"
    assert texts_of(response(b"Transfer-Encoding: chunked", b"no chunks"))[0] == "no chunks"
    assert texts_of(response(b"Content-Encoding: gzip", gzip.compress(b"<p>packed")))[0] == "packed"
    assert texts_of(response(b"Content-Encoding: gzip", b"<p>not packed"))[0] == "not packed"


def test_heads_that_are_not_closed_titles_and_links():
    text, meta = texts_of(response(b"X: y", b"<html><head><title>A  b</title><p>shown<a href='/l'>l</a><img src='/i'><a href='/l'>m</a>" + b"<p>long" * 20_000))
    assert text.startswith("shownlm\nlong") and text.count("long") == 20_000
    assert "title: A b\r\noutlink: /l\r\noutlink: /i\r\n" in meta and "source-header-x: y" in meta


def test_packed_files_and_bad_lengths(spark, tmp_path):
    records = [response(b"X: y", b"<p>%d" % k) for k in range(5)]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(map(gzip.compress, records)))
    assert Counter(bytes(r.record) for r in warc.read_warc(spark, f"file://{tmp_path}/a.warc.gz").collect()) == Counter(records)
    bad = b"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: x\r\n\r\n" + records[0] + b"WARC/1.0\r\nContent-Length: 9999\r\n\r\nshort"
    (tmp_path / "b.warc").write_bytes(bad)
    (tmp_path / "c.warc.gz").write_bytes(gzip.compress(records[1]) + gzip.compress(records[2])[:-9])
    assert [bytes(r.record) for r in warc.read_warc(spark, f"file://{tmp_path}/b.warc").collect()] == [records[0]]
    assert [bytes(r.record) for r in warc.read_warc(spark, f"file://{tmp_path}/c.warc.gz").collect()] == [records[1]]


def test_members_take_linear_time():
    """Ten thousand small members: the rest of the file isn't copied for each."""
    import os
    import time

    body = gzip.compress(os.urandom(2800))
    began = time.process_time()
    assert sum(1 for _ in warc.members(body * 10_000)) == 10_000
    assert time.process_time() - began < 3
    large = os.urandom(3 * warc.SLICE)
    assert list(warc.members(gzip.compress(large) + gzip.compress(b"") + gzip.compress(b"x") + b"rest")) == [large, b"", b"x"]
