import base64
import gzip
import hashlib

import pytest
from hypothesis import given
from hypothesis import strategies as st

from lanewise.llm import archives as A

# Fixed lines of both formats, as the formats lay them out.
V1 = (
    b"filedesc://old.arc 0.0.0.0 19970101000000 text/plain 71\n"
    b"1 0 somewhere\nURL IP-address Archive-date Content-type Archive-length\n\n"
    b"http://a.org/x 10.0.0.1 19961104142103 text/html 5\nhello\n"
    b"dns:a.org 10.0.0.2 19961104 text/dns 3\na b\n"
    b"http://a.org/y 10.0.0.1 19961104142110 no type at all 4\na\n\nb\n"
)
V2 = (
    b"filedesc://new.arc 0.0.0.0 20010101000000 text/plain 200 - - 0 new.arc 14\n"
    b"2 0 somewhere\n\n"
    b"http://b.org/ 10.0.0.3 20010101000001 text/html 404 abc123 - 99 new.arc 8\n12345678\n"
    b"not a header\n"
    b"http://b.org/z 10.0.0.3 20010101000002 text/html 200 - - 120 new.arc 50\ncut off"
)


def test_version_1_lines():
    rows = list(A.arc_records(V1))
    assert [r[1:] for r in rows] == [
        (1, "http://a.org/x", "10.0.0.1", "19961104142103", "text/html", None, None, b"hello"),
        (1, "dns:a.org", "10.0.0.2", "19961104", "text/dns", None, None, b"a b"),
        (1, "http://a.org/y", "10.0.0.1", "19961104142110", "no type at all", None, None, b"a\n\nb"),
    ]
    assert all(V1[r[0] :].startswith(r[2].encode()) for r in rows)


def test_version_2_lines_and_damage():
    assert [r[1:] for r in A.arc_records(V2)] == [
        (2, "http://b.org/", "10.0.0.3", "20010101000001", "text/html", "404", "abc123", b"12345678"),
        (2, "http://b.org/z", "10.0.0.3", "20010101000002", "text/html", "200", "-", b"cut off"),
    ]
    by_record = gzip.compress(V2[:100]) + gzip.compress(V2[100:])
    assert list(A.arc_records(by_record)) == list(A.arc_records(V2))
    assert list(A.arc_records(b"")) == []


@given(st.lists(st.tuples(st.sampled_from([1, 2]), st.text(), st.binary(max_size=60)), max_size=6))
def test_arc_round_trip(records):
    data = b"".join(
        A.version_block(v, "f.arc", "20000101000000") + b"\n" + A.arc_record(v, u, "20000101000000", c) + b"\n"
        for v, u, c in records
    )
    assert [(r[1], r[-1]) for r in A.arc_records(data)] == [(v, c) for v, _, c in records]


@given(st.lists(st.binary(max_size=80), max_size=5))
def test_warc_round_trip(blocks):
    data = b"".join(A.warc_record({"WARC-Type": "resource"}, b) + b"\r\n\r\n" for b in blocks)
    assert [b for _, b in A.warc_records(data)] == blocks


@pytest.mark.parametrize(
    ("date", "iso"),
    [
        ("20080102030405", "2008-01-02T03:04:05Z"),
        ("19961104", "1996-11-04T00:00:00Z"),
        ("20089999000000", "1970-01-01T00:00:00Z"),
        ("", "1970-01-01T00:00:00Z"),
    ],
)
def test_dates(date, iso):
    assert A.iso_date(date) == iso


def test_converted_fields():
    content = b"HTTP/1.1 200 OK\r\nContent-Length: 3\r\n\r\nabc"
    record = (7, 1, "http://a.org/", "10.0.0.1", "20080102030405", "text/html", None, None, content)
    [(fields, block)] = A.warc_records(A.converted("/x/f.arc.gz", record, None))
    assert block == content
    assert fields["warc-type"] == "response"
    assert fields["warc-payload-digest"] == "sha1:" + base64.b32encode(hashlib.sha1(b"abc").digest()).decode()
    assert fields["warc-record-id"] == A.record_id("http://a.org/", "20080102030405", "/y/f.arc.gz", 7)
    to = {"record_id": "<urn:uuid:1>", "url": "http://b.org/", "date": "20070102030405"}
    [(fields, block)] = A.warc_records(A.converted("/x/f.arc.gz", record, to))
    assert (fields["warc-type"], fields["warc-refers-to"]) == ("revisit", "<urn:uuid:1>")
    assert fields["warc-refers-to-date"] == "2007-01-02T03:04:05Z"
    assert block == content[:-3]
    plain = (*record[:-1], b"plain bytes \xff")
    [(fields, block)] = A.warc_records(A.converted("/x/f.arc.gz", plain, None))
    assert (fields["warc-type"], fields["content-type"], block) == ("resource", "text/html", plain[-1])


def plain_pages(rows):
    best = {}
    for page_id, html in rows:
        body = (html or "").encode()
        if len(body) >= 1000:
            best[body] = max(best.get(body, -1), -1 if page_id is None else page_id)
    out = []
    for page_id, html in rows:
        body = (html or "").encode()
        kept = best.get(body, page_id)
        revisit = kept != (-1 if page_id is None else page_id) and body in best
        out.append(
            (
                str(page_id),
                len(body),
                hashlib.sha1(body).hexdigest(),
                "revisit" if revisit else "response",
                str(kept) if revisit else "None",
            )
        )
    return sorted(out)


def test_pages_through_both_formats(spark):
    big = "<p>é</p>" * 400
    rows = [(k, "http://x.org/a b\n" if k % 3 else None, big if k % 2 else big + "x") for k in range(2500)]
    rows += [(3000, "http://y", None), (3001, "", ""), (3002, "http://z", "small"), (3003, "http://z", "small")]
    # Urls and contents like those of a version block.
    block = "2 0 other\nURL IP-address Archive-date\n"
    rows += [(4000 + k, f"{u}x{k}.arc", block * 40) for k, u in enumerate(("filedesc://", "FileDesc://", "filedesc:"))]
    rows += [(4010 + k, "filedesc://p", f"after {k} {big}") for k in range(6)]
    rows += [(None, "http://n", "\r\n\r\n" + big), (3004, "http://n", "WARC/1.0\r\n\r\nfiledesc://" * 60)]
    pages = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, content string, version string")
    found = A.archived_pages(pages.repartition(3))
    assert found.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    got = sorted(tuple(str(x) if k in (0, 4) else x for k, x in enumerate(r)) for r in found.collect())
    assert got == plain_pages([(i, h) for i, _, h in rows])


def test_repeated_rows_and_empty_tables(spark):
    kind = "page_id long, url string, html string"
    twice = A.archived_pages(spark.createDataFrame([(1, "http://x", "y" * 2000)] * 3, kind)).collect()
    assert sorted(r["record_type"] for r in twice) == ["response", "revisit", "revisit"]
    assert {r["refers_to"] for r in twice} == {None, 1}
    assert A.archived_pages(spark.createDataFrame([], kind)).count() == 0
