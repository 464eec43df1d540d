import gzip
import hashlib
import io
import json

import pytest

from braidflow.llm import warc

SCHEMA = "page_id long, url string, html string, archive string"
BIG, OTHER = "é" * 700, "x" * 5000
ROWS = [
    (1, "http://a/ b", BIG, "x"), (2, None, BIG, None), (7, "http://c", BIG, "x"), (7, "http://d", BIG, "x"),
    (3, "http://e", "small", "x"), (4, "http://f", "small", "x"), (5, "u", None, "x"), (6, "u", "", "x"),
    (None, "u", OTHER, "x"), (2**53 + 1, "u", OTHER, "x"), (9, "u", "WARC/1.1\r\n\r\n" * 200, "x"),
]


@pytest.mark.parametrize("many", [10_000, 2])
def test_archive_pages(spark, monkeypatch, many):
    """Of equal payloads of 1000 bytes or more that of the largest page_id stays, of several such the last one written."""
    monkeypatch.setattr(warc, "MANY", many)
    got = warc.archive_pages(spark.createDataFrame(ROWS, SCHEMA).repartition(3)).collect()
    assert len(got) == len(ROWS)
    payloads = sorted((str(x[0]), len((x[2] or "").encode()), hashlib.sha1((x[2] or "").encode()).hexdigest()) for x in ROWS)
    assert sorted((str(r["page_id"]), r["payload_bytes"], r["payload_digest"]) for r in got) == payloads
    kinds = [(r["page_id"], r["record_type"], r["refers_to"]) for r in got if r["payload_bytes"] >= 1000]
    want = [(1, "revisit", 7), (2, "revisit", 7), (7, "response", None), (7, "revisit", 7), (None, "revisit", 2**53 + 1), (2**53 + 1, "response", None), (9, "response", None)]
    assert sorted(kinds, key=str) == sorted(want, key=str)
    assert all(r["record_type"] == "response" and r["refers_to"] is None for r in got if r["payload_bytes"] < 1000)


def test_empty(spark):
    assert warc.archive_pages(spark.createDataFrame([], SCHEMA)).collect() == []


def test_normaliser(tmp_path):
    payloads = [b"a" * 3000, b"b" * 100, b"a" * 3000]
    raw = b"".join(warc.response(0, i, i, "http://x", p, hashlib.sha1(p).hexdigest()) for i, p in enumerate(payloads))
    source, target = f"file://{tmp_path}/in.warc.gz", f"file://{tmp_path}/out.warc.gz"
    (tmp_path / "in.warc.gz").write_bytes(gzip.compress(raw))
    assert warc.normalise(source, target, {0: (0, 2, 2)}) == 3
    index = [json.loads(x) for x in (tmp_path / "out.warc.gz.idx").read_text().splitlines()]
    with open(tmp_path / "out.warc.gz", "rb") as f:
        found = [warc.read_record(f, e["offset"], e["length"]) for e in index]
    assert [h["WARC-Type"] for h, _ in found] == ["revisit", "response", "response"]
    assert [b.partition(b"\r\n\r\n")[2] for _, b in found] == [b"", *payloads[1:]]
    assert found[0][0]["WARC-Refers-To"] == found[2][0]["WARC-Record-ID"]
    whole = list(warc.parse(warc.inflate(io.BytesIO((tmp_path / "out.warc.gz").read_bytes()))))
    assert [b for _, b in whole] == [b for _, b in found]


def test_cut_off_stream():
    raw = warc.response(0, 0, 1, None, b"abc", hashlib.sha1(b"abc").hexdigest())
    for bad in (gzip.compress(raw)[:-12], gzip.compress(raw[:-20])):
        with pytest.raises((ValueError, StopIteration)):
            list(warc.parse(warc.inflate(io.BytesIO(bad))))
