"""ARC to WARC: both versions, damaged archives, revisits, odd rows."""

import gzip
import hashlib
import io

import pytest

from graphloom.llm import warc


def arc_file(version, records):
    out = warc.member(warc.arc_version_block(version, "t.arc.gz", "20200102030405"))
    for url, content in records:
        fields = {"URL": url, "IP-address": "10.0.0.1", "Archive-date": "20200102030405", "Content-type": "text/html", "Archive-length": str(len(content))}
        out += gzip.compress(warc.arc_line(version, fields) + b"\n" + content + b"\n")
    return out


@pytest.mark.parametrize("version", [1, 2])
def test_arc_versions(version):
    content = b"HTTP/1.1 200 OK\r\nX-Page-Id: 5\r\n\r\nbody\nmore"
    got = list(warc.read_arc(io.BytesIO(arc_file(version, [("http://a.b/c d", content), ("dns:x", b"1.2.3.4")]))))
    assert [r.fields["URL"] for r in got] == ["http://a.b/c%20d", "dns:x"] and [r.content for r in got] == [content, b"1.2.3.4"]
    record = warc.convert(got[0], "t.arc.gz", None)
    (headers, block), = warc.read_warc(io.BytesIO(warc.member(record)))
    assert block == content and headers["WARC-Type"] == "response" and headers["WARC-Date"] == "2020-01-02T03:04:05Z"
    assert headers["WARC-Payload-Digest"] == "sha256:" + hashlib.sha256(b"body\nmore").hexdigest()
    assert headers["WARC-Record-ID"] == warc.record_id("t.arc.gz", got[0].offset)
    (headers, block), = warc.read_warc(io.BytesIO(warc.member(warc.convert(got[1], "t.arc.gz", None))))
    assert headers["WARC-Type"] == "resource" and block == b"1.2.3.4"
    (headers, block), = warc.read_warc(io.BytesIO(warc.member(warc.convert(got[0], "t.arc.gz", (3, "u.arc.gz", 9)))))
    assert (headers["WARC-Type"], headers["X-Refers-To-Page"], headers["X-Payload-Bytes"]) == ("revisit", "3", "9")
    assert block == content[: content.index(b"body")] and headers["WARC-Refers-To"] == warc.record_id("u.arc.gz", 9)


def test_spaces_in_a_legacy_url_are_the_url_s():
    raw = warc.member(warc.arc_version_block(1, "t", "2020")) + gzip.compress(b"http://a/b c 1.1.1.1 2020 text/html 3\nabc\n")
    (record,) = warc.read_arc(io.BytesIO(raw))
    assert record.fields["URL"] == "http://a/b c" and record.content == b"abc"
    assert warc.warc_date("2020") == "2020-01-01T00:00:00Z"


@pytest.mark.parametrize("line", [b"http://a 1.1.1.1 2020 text/html 30\nabc\n", b"http://a text/html x\nabc\n"])
def test_damage_is_an_error(line):
    with pytest.raises(ValueError):
        list(warc.read_arc(io.BytesIO(warc.member(warc.arc_version_block(1, "t", "2020")) + gzip.compress(line))))
    with pytest.raises(ValueError):
        list(warc.read_arc(io.BytesIO(arc_file(1, [("http://a", b"abc")])[:-5])))


def expected(rows):
    out, first = [], {}
    for page, _, html in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        raw = (html or "").encode()
        again = len(raw) >= 100 and raw in first
        out.append((page, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", first[raw] if again else None))
        if len(raw) >= 100:
            first.setdefault(raw, page)
    return sorted(map(str, out))


def test_archive(spark):
    same, other = "<p>é</p>" * 40, "x" * 100
    rows = [(9, "http://a", same), (3, "http://b c\n", same), (5, None, same), (4, "u", "x" * 99), (6, "u", "x" * 99), (7, "u", None), (8, "u", ""),
            (None, "n", same), (10, "u", other), (10, "u", other), (11, "u", "HTTP/1.1 no head\r\n\r\n" + "y" * 200), (12, "u", "z" * 3_000_000)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, arc string").repartition(3)
    got = warc.archive(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(str, map(tuple, got))) == expected(rows)
    assert warc.archive(pages.limit(0)).count() == 0
