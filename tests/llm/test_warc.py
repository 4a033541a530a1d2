import hashlib

import pytest

from latticework.llm import warc

SCHEMA = "page_id long, url string, html string, name string, content string"


def brute(rows):
    bodies = [(p, (h or "").encode()) for p, _, h in rows]
    out = []
    for p, b in bodies:
        ids = [q for q, c in bodies if c == b and q is not None]
        best = max(ids) if ids else None
        revisit = len(b) >= 1000 and p != best
        out.append((p, len(b), hashlib.sha1(b).hexdigest(), "revisit" if revisit else "response", best if revisit else None))
    return sorted(out, key=str)


ROWS = [
    (1, "http://a/ b?x=ü", "<p>" + "é" * 600),
    (2, "http://b", "<p>" + "é" * 600),
    (9, None, "<p>" + "é" * 600),
    (3, "http://c", "short"),
    (4, "http://c", "short"),
    (5, "http://d", None),
    (6, "", ""),
    (None, "http://n", "y" * 1000),
    (7, "http://m", "y" * 1000),
    (8, "http://crlf", "WARC/1.1\r\n\r\nWARC-Type: response\r\n\r\n" + "z" * 999),
    (8, "http://crlf", "WARC/1.1\r\n\r\nWARC-Type: response\r\n\r\n" + "z" * 999),
    (10, "http://long", "long " * 200_000),
]


def test_archives_read_back_as_brute_force_says(spark):
    df = spark.createDataFrame([(*r, "clash", "clash") for r in ROWS], SCHEMA)
    got = [tuple(r) for r in warc.archive_pages(df).collect()]
    assert sorted(got, key=str) == brute(ROWS)


def test_small_archives_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(warc, "ARC_BYTES", 3000)
    monkeypatch.setattr(warc, "READ_BYTES", 100)
    df = spark.createDataFrame([(*r, "clash", "clash") for r in ROWS], SCHEMA)
    assert sorted((tuple(r) for r in warc.archive_pages(df).collect()), key=str) == brute(ROWS)


def test_record_identifiers_differ(spark):
    rows = [(1, "http://a", "x"), (1, "http://a", "x"), (1, "http://a", "y"), (None, None, None), (None, None, None)]
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA)
    parsed = warc.convert_arc(warc.pages_to_arc(df)).collect()
    assert len({r.record_id for r in parsed}) == len(parsed) == 5


def test_members_and_pieces_are_read_through():
    import gzip

    record = f"WARC/1.1{warc.CRLF}WARC-Record-ID: <a>{warc.CRLF}Content-Length: 3{warc.CRLF * 2}abc{warc.CRLF * 2}".encode()
    for data in (gzip.compress(record * 3), gzip.compress(record) * 3):
        assert [b for _, b in warc.parse_warc(warc.unzipped(data))] == [b"abc"] * 3
    with pytest.raises(ValueError):
        list(warc.parse_warc([record[:-6]]))


def test_empty_table(spark):
    assert warc.archive_pages(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("version", [1, 2])
def test_arc_versions_parse_by_declared_length(version):
    block = b"HTTP/1.1 200 OK\r\nX-Page-Id: 3\r\n\r\nbody\nhttp://fake 0.0.0.0 x y 5\n"
    data = warc.arc_archive(version, [("http://a/x y", block), ("http://b", block)], "f.arc")
    parsed = list(warc.parse_arc(data))
    assert [b for _, b in parsed] == [block, block]
    assert parsed[0][0]["URL"] == "http://a/x%20y"
    page, record, uri, date, *_ = warc.synthesise(*parsed[0], "f.arc 0")
    assert (page, uri, date) == (3, "http://a/x%20y", "2024-01-01T00:00:00Z") and record.startswith("urn:uuid:")
    assert warc.decoded_target(uri) == "http://a/x y"


def test_wrong_header_is_an_error():
    data = warc.arc_archive(1, [("http://a", b"x")], "f.arc").replace(b"text/html", b"text/html extra")
    with pytest.raises(ValueError, match="fields"):
        list(warc.parse_arc(data))
