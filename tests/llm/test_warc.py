import gzip
import hashlib

import pytest

from newsloom.llm import warc

SF = "/root/testdata/sf0.01"


def expected(rows):
    best = {}
    for i, _, h in rows:
        p = (h or "").encode()
        best[p] = max(best.get(p, i), i)
    out = []
    for i, _, h in rows:
        p = (h or "").encode()
        again = len(p) >= 1000 and best[p] != i
        out.append((i, len(p), hashlib.sha1(p).hexdigest(), "revisit" if again else "response", best[p] if again else None))
    return sorted(out, key=str)


def test_pages_come_back(spark, tmp_path):
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html")
    rows = [tuple(r) for r in pages.collect()]
    for segment, chunk in ((1 << 17, 1 << 13), (900, 7)):
        path = f"file://{tmp_path}/{segment}"
        assert sorted(map(tuple, warc.round_trip(pages, path, segment, chunk).collect()), key=str) == expected(rows)
        html = {r.page_id: r.payload for r in warc.read(spark, path).where("record_type = 'response'").collect()}
        assert all(html[i].decode() == h for i, _, h in rows if i in html)


def test_odd_payloads(spark, tmp_path):
    long = "é漢WARC/1.1\r\nContent-Length: 3\r\n\r\n0\r\n\r\n" * 40
    rows = [(1, "u", None), (2, None, ""), (3, "u\r\nX-Page-Id: 9", long), (4, "v", long), (5, "v", long), (5, "v", long), (6, "w", "x" * 999), (7, "w", "x" * 999), (8, "z", "y" * 300_000), (9, "", "\r\n\r\n")]
    pages = spark.createDataFrame([(*r, "c") for r in rows], "page_id long, url string, html string, payload_digest string")
    for segment in (64, 1 << 17):
        assert sorted(map(tuple, warc.round_trip(pages, f"file://{tmp_path}/{segment}", segment, 5 if segment == 64 else 1 << 13).collect()), key=str) == expected(rows)
    assert warc.round_trip(pages.limit(0), f"file://{tmp_path}/none").count() == 0
    lone = spark.createDataFrame([(None, "u", long), (None, "u", long)], "page_id long, url string, html string")
    assert [tuple(r)[3:] for r in warc.round_trip(lone, f"file://{tmp_path}/lone").collect()] == [("response", None)] * 2


def test_broken_archives_are_refused(spark, tmp_path):
    row = {"page_id": 1, "url": "u", "html": "abc" * 100, "payload_digest": hashlib.sha1(b"abc" * 100).hexdigest(), "payload_bytes": 300, "record_type": "response", "refers_to": None}
    parts = list(warc.records_of(row, "x", 100, 50))
    for k, kept in enumerate((parts[:-1], parts[1:], parts[:1] + parts[2:], [p.replace(b"abc", b"abd") for p in parts])):
        (tmp_path / str(k)).mkdir()
        (tmp_path / str(k) / "a.warc.gz").write_bytes(gzip.compress(b"".join(p + warc.SPLIT for p in kept)))
        with pytest.raises(Exception, match="not whole|digest"):
            warc.read(spark, f"file://{tmp_path}/{k}").collect()


def test_chunked_framing():
    assert warc.unchunked(b"3;x=y\r\nabc\r\nA\r\n0123456789\r\n0\r\nT: 1\r\n\r\n") == b"abc0123456789"
    assert warc.unchunked(warc.chunked("é" * 20, 3)) == ("é" * 20).encode()
    with pytest.raises(ValueError):
        warc.unchunked(b"3\r\nabcd\r\n0\r\n\r\n")


def test_segments_and_references_are_those_of_the_standard(spark, tmp_path):
    """At production sizes: blocks within the limit of bytes, also of wide characters; every reference is the id of a
    response with the same payload."""
    rows = [(k, f"u{k}", ("é漢" * 9000 if k % 2 else f"p{k}" * 5000) + str(k % 6)) for k in range(24)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    path = f"file://{tmp_path}/a"
    assert sorted(map(tuple, warc.round_trip(pages, path).collect()), key=str) == expected(rows)
    records = [r for f in sorted((tmp_path / "a").glob("*.gz")) for r in warc.parse(f.read_bytes())]
    assert max(len(block) for _, block in records) <= warc.SEGMENT_BYTES and len({f["warc-record-id"] for f, _ in records}) == len(records)
    digests = {f["warc-record-id"]: f["warc-payload-digest"] for f, _ in records if f["warc-type"] == "response"}
    again = [f for f, _ in records if f["warc-type"] == "revisit"]
    assert again and all(digests[f["warc-refers-to"]] == f["warc-payload-digest"] for f in again)
    assert sum(f["warc-type"] == "continuation" for f, _ in records) > 20
    for text in ("aé漢😀b", "", "plain"):
        for n in (1, 2, 3, 9):
            parts = [p.decode() for p in warc.pieces(text.encode(), n)]
            assert "".join(parts) == text and all(len(p) == 1 or len(p.encode()) <= n for p in parts)
