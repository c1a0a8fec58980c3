"""Archives: an exact round trip through files, and what broken ones give."""

import base64
import hashlib

import pytest

from gleaner.llm import warc


def _pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, record_id string")


def test_round_trip(spark, tmp_path):
    long = "é<p>\r\n\r\nWARC/1.1 " * 9000
    rows = [(1, "http://a/ b", long, "x"), (2, None, None, "x"), (3, "http://c", "", "x"), (4, "http://d", long, "x"), (5, "http://e", "short", "x"), (9, "http://e", "short", "x"), (None, "http://f", "lost", "x")]
    got = {r.page_id: r for r in warc.archived_pages(_pages(spark, rows), str(tmp_path / "w")).collect()}
    assert set(got) == {1, 2, 3, 4, 5, 9}
    for page, _, html, _ in rows[:-1]:
        body = (html or "").encode()
        assert got[page].payload_bytes == len(body)
        assert got[page].payload_digest == base64.b32encode(hashlib.sha1(body).digest()).decode()
        assert got[page].error is None
    assert [(p, got[p].record_type, got[p].refers_to) for p in sorted(got)] == [(1, "response", None), (2, "response", None), (3, "revisit", 2), (4, "revisit", 1), (5, "response", None), (9, "revisit", 5)]
    full = warc.read_archive(spark, str(tmp_path / "w")).where("record_id like '%:4:%'").first()
    assert bytes(full.payload).decode() == long


def test_small_payloads_are_all_responses(spark, tmp_path):
    got = warc.archived_pages(_pages(spark, [(1, "u", "ab", "x"), (2, "u", "ab", "x")]), str(tmp_path / "w"), least_bytes=3).collect()
    assert {r.record_type for r in got} == {"response"}


def test_empty_table(spark, tmp_path):
    assert warc.archived_pages(_pages(spark, []), str(tmp_path / "w")).count() == 0


def test_missing_segments_and_wrong_lengths_are_told(spark, tmp_path):
    payload = "x" * 100_000
    digest = base64.b32encode(hashlib.sha1(payload.encode()).digest()).decode()
    parts = warc.records("<urn:page:1:1>", "u", payload.encode(), digest, None, 32_768, 8_192)
    assert len(parts) > 2
    cases = {"missing": (parts[:1] + parts[2:], "segments are missing"), "cut": ([*parts[:-1], parts[-1].replace(b"Total-Length: ", b"Total-Length: 1")], "total length"), "alone": (parts[1:], None)}
    for name, (kept, said) in cases.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "a.warc").write_bytes(b"".join(p + b"\r\n\r\n" for p in kept))
        row = warc.read_archive(spark, str(tmp_path / name)).first()
        assert row.payload is None and row.error and (said is None or said in row.error)


def test_framing():
    assert warc.unchunked(warc.chunked(b"abc" * 5000, 8192)) == b"abc" * 5000
    assert warc.unchunked(b"3;ext=1\r\nabc\r\n0\r\nTrailer: x\r\n\r\n") == b"abc"
    with pytest.raises(ValueError):
        warc.unchunked(b"5\r\nabc\r\n0\r\n\r\n")


def test_repeated_pages_frequent_payloads_and_very_long_ones(spark, tmp_path, monkeypatch):
    from gleaner.llm import _io

    monkeypatch.setattr(_io, "FREQUENT", 4)
    long = "".join(f"line {i} é\r\n\r\n" for i in range(150_000))
    rows = [(1, "u", "one", "x"), (1, "u", "two", "x"), (1, "u", "one", "x"), *((10 + i, f"u{i}", "same for many", "x") for i in range(40)), (60, "l", long, "x"), (61, "l", long, "x")]
    got = warc.archived_pages(_pages(spark, rows), str(tmp_path / "w")).collect()
    assert len(got) == len(rows) and all(r.error is None for r in got)
    many = {r.page_id: r for r in got if 10 <= r.page_id < 50}
    assert len(many) == 40 and [p for p, r in many.items() if r.record_type == "response"] == [10] and {r.refers_to for p, r in many.items() if p > 10} == {10}
    assert sorted((r.record_type, r.refers_to, r.payload_digest == base64.b32encode(hashlib.sha1(b"one").digest()).decode()) for r in got if r.page_id == 1 and r.record_type == "response") == [("response", None, False), ("response", None, True)]
    assert sum(r.record_type == "revisit" and r.refers_to == 1 for r in got if r.page_id == 1) == 1
    last = {r.page_id: r for r in got if r.page_id >= 60}
    assert last[60].payload_bytes == last[61].payload_bytes == len(long.encode()) and last[61].refers_to == 60
