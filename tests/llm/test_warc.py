"""Archives: exact round trip, and archives by other writers, good and broken."""

import base64
import hashlib

import pytest
import zstandard

from feedtide.llm import warc


def sha(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


PAGES = [
    (4, "http://x/a", "same"), (2, "http://x/b", "same"), (2, "http://x/c", "same"), (9, None, "same"), (None, "http://x/d", "same"), (5, "u\r\nWARC-Type: fake", "é" * 70),
    (6, "http://x/e", None), (7, "http://x/f", ""), (8, "", "\r\n\r\n\r\nWARC/1.1\r\n"), (10, "http://x/g", "long " * 400_000), (None, None, "alone"),
]


@pytest.fixture
def pages(spark):
    return spark.createDataFrame([(*p, "x") for p in PAGES], "page_id bigint, url string, html string, payload string").repartition(2)


@pytest.mark.parametrize("least", [0, 3, 10**9])
def test_round_trip(spark, pages, tmp_path, least):
    warc.write_archives(pages, str(tmp_path / "w"), least)
    rows = warc.read_archives(spark, str(tmp_path / "w")).collect()
    got = sorted(((r.record_id, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest, bytes(r.payload)) for r in rows), key=repr)
    expected = []
    for page_id, _, html in PAGES:
        payload = (html or "").encode()
        same = [p for p, _, h in PAGES if (h or "") == (html or "") and p is not None]
        first = min(same, default=None) if len(payload) >= least else None
        revisit = first is not None and first != page_id
        record = warc.PAGE + ("" if page_id is None else str(page_id))
        expected.append((record, "revisit" if revisit else "response", f"{warc.PAGE}{first}" if revisit else None, len(payload), sha(payload), b"" if revisit else payload))
    assert got == sorted(expected, key=repr)
    assert all(r.error is None for r in rows)


def test_archives_end_at_their_size(spark, pages, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 40_000)
    monkeypatch.setattr(warc, "RECORDS", 50)
    many = pages.crossJoin(spark.range(20)).drop("id").coalesce(1)
    warc.write_archives(many, str(tmp_path / "w"))
    files = [f for f in (tmp_path / "w").iterdir() if f.suffix == ".txt"]
    assert len(files) > 4
    for f in files:
        assert f.read_bytes()[:4] == warc.DICTIONARY_MAGIC
    assert warc.read_archives(spark, str(tmp_path / "w"), payloads=False).count() == 20 * len(PAGES)


def test_empty_table(spark, pages, tmp_path):
    warc.write_archives(pages.limit(0), str(tmp_path / "w"))
    assert warc.read_archives(spark, str(tmp_path / "w")).count() == 0


def record(kind="response", payload=b"hello", length=None, **more) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload
    head = {"WARC-Type": kind, "WARC-Record-ID": "<urn:x:1>", "WARC-Date": warc.DATE, "Content-Type": "application/http", "Content-Length": str(len(block) if length is None else length)} | more
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items() if v is not None)
    return b"WARC/1.0\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


@pytest.mark.parametrize("compressed", [False, True])
def test_other_writers_with_a_dictionary(spark, tmp_path, compressed):
    raw = b"HTTP/1.1 200 OK WARC-Type response Content-Length " * 20
    # streamed frames carry no content size and several blocks
    writer = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(raw)).compressobj
    body = b""
    for payload in (b"first", b"z" * 500_000, b""):
        stream = writer()
        text = record(payload=payload, **{"WARC-Payload-Digest": "sha1:" + sha(payload)})
        body += stream.compress(text[:100]) + stream.flush(zstandard.COMPRESSOBJ_FLUSH_BLOCK) + stream.compress(text[100:]) + stream.flush()
    content = zstandard.ZstdCompressor().compress(raw) if compressed else raw
    (tmp_path / "a.warc.zst").write_bytes(warc.DICTIONARY_MAGIC + len(content).to_bytes(4, "little") + content + body)
    (tmp_path / "b.warc.zst").write_bytes(zstandard.ZstdCompressor().compress(record(kind="warcinfo", **{"Content-Type": "text/plain"})))
    rows = warc.read_archives(spark, str(tmp_path)).collect()
    assert sorted(r.payload_bytes for r in rows if r.record_type == "response") == [0, 5, 500_000]
    assert all(r.error is None for r in rows) and len(rows) == 4


@pytest.mark.parametrize(
    "broken,problem",
    [
        (zstandard.ZstdCompressor().compress(record(length=3)), "wrong record length"),
        (zstandard.ZstdCompressor().compress(record(**{"WARC-Date": None})), "missing warc-date"),
        (zstandard.ZstdCompressor().compress(record(**{"WARC-Payload-Digest": "sha1:AAAA"})), "wrong digest"),
        (zstandard.ZstdCompressor().compress(b"no record"), "no WARC header"),
        (zstandard.ZstdCompressor().compress(record())[:-5], "truncated frame"),
        (b"GARBAGE!", "no frame at byte 0"),
    ],
)
def test_broken_archives_are_reported(spark, tmp_path, broken, problem):
    (tmp_path / "a.warc.zst").write_bytes(zstandard.ZstdCompressor().compress(record()) + broken if problem != "no frame at byte 0" else broken)
    rows = warc.read_archives(spark, str(tmp_path), raise_errors=False).collect()
    assert [r.error for r in rows if r.error] == [problem]
    assert len(rows) == (1 if problem == "no frame at byte 0" else 2)
    with pytest.raises(Exception, match=problem):
        warc.read_archives(spark, str(tmp_path)).collect()
