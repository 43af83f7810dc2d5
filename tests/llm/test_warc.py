import hashlib
import io

import pytest

from modelwatch.llm import warc as W


def test_records_one_after_the_other():
    big = bytes(range(256)) * 4000
    records = [(1, "http://x/ä b", b"hello", None, False), (None, None, b"", None, False), (3, "u\r\nWARC-Type: x", big, None, False), (2, "v", big, 3, True)]
    archive = b"".join(W.make_record(*r) for r in records)
    got = list(W.read_records(io.BytesIO(archive), keep_payload=True))
    assert [g["page_id"] for g in got] == [1, None, 3, 2]
    assert [g["url"] for g in got] == ["http://x/ä b", "", "u\r\nWARC-Type: x", "v"]
    assert [g["payload"] for g in got] == [b"hello", b"", big, None]
    assert [g["payload_bytes"] for g in got] == [5, 0, len(big), len(big)]
    assert [g["payload_digest"] for g in got] == [hashlib.sha1(r[2]).hexdigest() for r in records]
    assert [g["refers_to"] for g in got] == [None, None, None, 3] and all(g["verified"] for g in got)


def test_damage_is_found(monkeypatch):
    good = W.make_record(1, "u", b"payload" * 300, None, False)
    with pytest.raises(ValueError, match="ends inside"):
        list(W.read_records(io.BytesIO(good[:-9])))
    monkeypatch.setattr(W, "sha1_base32", lambda data: "sha1:" + "A" * 32)
    assert [r["verified"] for r in W.read_records(io.BytesIO(W.make_record(1, "u", b"x", None, False)))] == [False]


def slow_types(rows):
    data = [(i, (h or "").encode()) for i, _, h in rows]
    lead = {}
    for i, p in data:
        if len(p) >= 1000 and i is not None:
            lead[p] = max(lead.get(p, i), i)
    out = []
    for i, p in data:
        to = lead.get(p)
        revisit = to is not None and i != to
        out.append((i, len(p), hashlib.sha1(p).hexdigest(), "revisit" if revisit else "response", to if revisit else None, True))
    return out


def test_pages_with_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(W, "ARCHIVE_BYTES", 2000)
    long, other = "é" * 600, "z" * 1000
    rows = [(i, f"http://h/{i}", long if i % 3 else f"page {i}") for i in range(40)]
    rows += [(None, "n", long), (None, None, other), (50, None, None), (51, "", ""), (52, "x", "z" * 999), (53, "x", "z" * 999), (38, "again", long)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, payload string")
    out = W.archive_pages(pages)
    assert out.columns == ["page_id", "record_type", "refers_to", "payload_bytes", "payload_digest", "verified"]
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.verified) for r in out.collect()]
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(got, key=key) == sorted(slow_types(rows), key=key)
    assert W.archive_pages(pages.limit(0)).count() == 0


def test_payloads_come_back(spark, tmp_path):
    pages = spark.createDataFrame([(1, "a", "<p>é</p>"), (2, "b", "x" * 2000), (3, "c", "x" * 2000)], "page_id long, url string, html string")
    archives = W.write_archives(pages, str(tmp_path / "w"))
    back = {r.page_id: (r.url, r.payload and bytes(r.payload).decode()) for r in W.read_archives(archives, keep_payload=True).collect()}
    assert back == {1: ("a", "<p>é</p>"), 2: ("b", None), 3: ("c", "x" * 2000)}
