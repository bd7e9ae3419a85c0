"""ARC to WARC (4)."""

import gzip
import hashlib

import pytest

from adlens.llm import arc_convert as A


def pages(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", "y") for r in rows],
                                 "page_id long, url string, html string, rid long, path string, record_type string")


def test_archive_round_trip_equals_brute_force(spark):
    big = "<p>" + "é" * 200
    rows = [(3, "http://a/ b", big), (2, "http://b", big), (9, None, big), (4, "http://c", "short"), (5, "http://c", "short"),
            (6, "http://d", None), (7, "http://d", ""), (8, "http://e", "x\r\n\r\ny" * 50), (10, "http://f", "z" * 300_000),
            (None, "http://g", big), (11, "http://h", "HTTP/1.0 fake\r\nContent-Length: 3\r\n\r\n" + "q" * 100)]
    got = {r.page_id: r for r in A.archive_pages(pages(spark, rows)).collect()}
    first = {}
    for i, _, h in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        first.setdefault(h or "", i)
    assert len(got) == len(rows)
    for i, _, h in rows:
        raw, r = (h or "").encode(), got[i]
        again = len(raw) >= 100 and first[h or ""] != i
        assert (r.payload_bytes, r.payload_digest) == (len(raw), hashlib.sha256(raw).hexdigest())
        assert (r.record_type, r.refers_to) == (("revisit", first[h or ""]) if again else ("response", None))


def test_repeated_rows_and_empty_table(spark):
    twice = [(1, "u", "t" * 200), (1, "u", "t" * 200)]
    got = A.archive_pages(pages(spark, twice)).collect()
    assert [(r.page_id, r.record_type) for r in got] == [(1, "response")] * 2
    assert A.archive_pages(pages(spark, [])).collect() == []


@pytest.mark.parametrize("version", [1, 2])
def test_header_lines_by_version(version):
    line = A.arc_header(version, "http://x/a b", "1.2.3.4", "20010203040506", "text/html", b"abc", "404")
    head = A.parse_header(line, version)
    assert (head["ip"], head["date"], head["kind"], head["length"]) == ("1.2.3.4", "20010203040506", "text/html", 3)
    assert head["url"] == "http://x/a%20b"
    legacy = line.replace(b"%20", b" ")
    assert A.parse_header(legacy, version)["url"] == "http://x/a b"
    assert A.parse_header(b"not a header\n", version) is None


def test_dates():
    assert A.warc_date("19990203040506") == "1999-02-03T04:05:06Z"
    assert A.warc_date("1999") == "1999-01-01T00:00:00Z"
    assert A.warc_date("19991399000000") == "1999-01-01T00:00:00Z"


def write(path, version, records, tail=b""):
    data = A.arc_version_block(version, "f.arc", "20000101000000")
    for url, date, kind, content in records:
        data += A.arc_header(version, url, "9.9.9.9", date, kind, content) + content + b"\n"
    path.write_bytes(gzip.compress(data + tail))
    return str(path)


@pytest.mark.parametrize("version", [1, 2])
def test_foreign_archive(spark, tmp_path, version):
    body = b"B" * 150
    http = b"HTTP/1.1 200 OK\r\nServer: x\r\n\r\n"
    path = write(tmp_path / f"v{version}.arc.gz", version, [
        ("http://one", "20010101000000", "text/html", http + body),
        ("dns:one", "2001", "text/dns", b"one A 9.9.9.9"),
        ("http://two", "20020101000000", "text/html", http + body)], tail=b"junk line\nhttp://cut 1.1.1.1 2001 text/html 99\nxx")
    files = A.convert_arc(spark.createDataFrame([(path, 3)], "path string, records long"))
    rows = A.read_warc(files).collect()
    assert sorted(r.record_type for r in rows) == ["resource", "response", "revisit"]
    first, again = (next(r for r in rows if r.record_type == t) for t in ("response", "revisit"))
    assert again.refers_rid == first.rid and again.payload_digest == first.payload_digest
    records = list(A.warc_records(files.first().path))
    info = records[0][0]
    assert info["warc-type"] == "warcinfo" and f"ARC/{version}".encode() in records[0][1]
    of = {h["warc-type"]: (h, b) for h, b in records}
    assert of["response"][0]["warc-target-uri"] in ("http://one", "http://two")
    assert of["response"][0]["warc-date"].startswith("200") and of["response"][0]["warc-ip-address"] == "9.9.9.9"
    assert of["resource"][0]["warc-date"] == "2001-01-01T00:00:00Z"
    assert of["resource"][1] == b"one A 9.9.9.9" and of["response"][1] == http + body
    for h, b in records:
        assert h["warc-block-digest"] == "sha256:" + hashlib.sha256(b).hexdigest() and int(h["content-length"]) == len(b)
        assert h["warc-record-id"].startswith("<urn:uuid:")
