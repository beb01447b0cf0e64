"""WARC files: round trip, revisits, assembly."""

import hashlib

import pytest

from tessera.llm import warc
from tests.llm.helpers import by_id

BIG = "<p>" + "long enough to be worth a revisit " * 5 + "</p>"
PAGES = [
    (1, "http://a/1", BIG),
    (2, "http://a/2", BIG),
    (3, None, "short"),
    (4, "http://a/ 4\r\nX-Bad: 1", "short"),
    (5, "http://a/5", None),
    (6, "http://a/6", ""),
    (7, "http://a/7", "HTTP/1.1 200\r\n\r\nWARC/1.1\r\nContent-Length: 9\r\n\r\n\r\n\r\n" + "é\U0001f600" * 60),
    (8, "http://a/8", "x" * 400_000),
    (-9, "http://a/9", BIG + "\r\n\r\n"),
    (None, "http://a/none", BIG),
    (None, None, "small"),
    (2, "http://a/2", BIG),
]


def folder(tmp_path):
    return str(tmp_path / "out")


@pytest.fixture
def records(spark, tmp_path):
    pages = spark.createDataFrame([(*p, "x", "y") for p in PAGES], "page_id bigint, url string, html string, digest string, payload string")
    warc.write_warc(pages, folder(tmp_path))
    return warc.read_warc(spark, folder(tmp_path))


def test_round_trip(records):
    rows = records.collect()
    assert len(rows) == 3 * len(PAGES)
    payloads = sorted(bytes(r["payload"]) for r in rows if r["record_type"] == "response")
    revisits = [r for r in rows if r["record_type"] == "revisit"]
    # BIG of page 1 and of the page without an id are responses; both captures of page 2 revisit
    want = sorted((p[2] or "").encode() for p in PAGES if not (p[2] == BIG and p[0] == 2))
    assert payloads == want
    assert [r["refers_to"] for r in revisits] == ["<urn:capture:1:response>"] * 2
    for r in rows:
        if r["record_type"] == "response":
            assert r["payload_digest"] == hashlib.sha256(r["payload"]).hexdigest()
            assert r["payload_bytes"] == len(r["payload"])
    assert not any("\n" in (r["target_uri"] or "") for r in rows)


def test_captures(records):
    captures = warc.resolve_revisits(warc.assemble(records)).collect()
    by_page = {}
    for c in captures:
        assert c["request"]["record_type"] == "request" and c["metadata"]["record_type"] == "metadata"
        by_page.setdefault(c["capture_id"], c)
    two = by_page["<urn:capture:2:response>"]
    assert (two["n_requests"], two["n_metadata"]) == (2, 2)
    assert two["original"]["response"]["payload_bytes"] == len(BIG)
    assert bytes(two["original"]["response"]["payload"]) == BIG.encode()
    assert by_page["<urn:capture:8:response>"]["response"]["payload_bytes"] == 400_000
    assert by_page["<urn:capture:1:response>"]["original"] is None


def record(record_id, kind, concurrent=None, **other):
    names = ["refers_to", "target_uri", "date", "content_type", "payload_digest", "payload_bytes", "fields", "payload"]
    return (record_id, kind, concurrent, *[other.get(n) for n in names])


def test_orphans_and_surplus(spark):
    rows = [
        record("a", "response", payload_bytes=3),
        record("q2", "request", "a"),
        record("q1", "request", "a"),
        record("m", "metadata", "a"),
        record("lost", "request", "gone"),
        record("alone", "metadata"),
        record(None, "response"),
        record(None, "request", "a"),
        record("w", "warcinfo"),
        record("r", "revisit", refers_to="nowhere"),
        record(None, None),
    ]
    got = warc.resolve_revisits(warc.assemble(spark.createDataFrame(rows, warc.RECORD)))
    out = {
        r["capture_id"]: tuple(r[k] and r[k]["record_id"] for k in ("response", "metadata")) + (r["n_requests"], r["n_metadata"])
        for r in got.collect()
    }
    assert out == {
        "a": ("a", "m", 3, 1),
        "gone": (None, None, 1, 0),
        "alone": (None, "alone", 0, 1),
        "r": ("r", None, 0, 0),
    }
    # the empty table
    assert warc.assemble(spark.createDataFrame([], warc.RECORD)).collect() == []


def test_no_pages(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id bigint, url string, html string")
    warc.write_warc(pages, folder(tmp_path))
    assert warc.read_warc(spark, folder(tmp_path)).collect() == []


def test_several_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FILE_CAPTURES", 3)
    pages = spark.createDataFrame([(i, f"http://a/{i}", f"page {i % 5} " * 30) for i in range(40)], "page_id bigint, url string, html string")
    warc.write_warc(pages.coalesce(2), folder(tmp_path))
    captures = warc.resolve_revisits(warc.assemble(warc.read_warc(spark, folder(tmp_path))))
    got = captures.select(warc.page_id_of("metadata"), "response.record_type", warc.page_id_of("original.metadata")).collect()
    want = [(i, "response" if i < 5 else "revisit", None if i < 5 else i % 5) for i in range(40)]
    assert by_id(got) == by_id(want)


def test_query_gives_a_row_per_page_row(spark, tmp_path):
    other = BIG + "other"
    rows = [
        (1, "http://a/1", BIG),
        (1, "http://a/1", other),
        (1, "http://a/b", other),
        (2, "http://a/2", other),
        (2, "http://a/2", "short"),
        (2, "http://a/2", "short"),
        (2, None, "short"),
        (3, "http://a/3", BIG),
        (3, "http://a/3", BIG),
        (None, "http://a/none", "short"),
    ]
    spark.createDataFrame(rows, "page_id bigint, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = warc.op4_warc_transactions(spark, str(tmp_path)).collect()
    first = {BIG: 1, other: 1}
    want = []
    for page, _, html in rows:
        again = html in first and page != first[html]
        digest = hashlib.sha256(html.encode()).hexdigest()
        want.append((page, len(html), digest, "revisit" if again else "response", first[html] if again else None))
    assert by_id(got) == by_id(want)
