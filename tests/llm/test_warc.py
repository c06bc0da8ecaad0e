import hashlib
import io
import random
import re

import pytest

from promolift.llm import warc as W
from promolift.llm.common import fresh_path
from tests.llm.conftest import rows_of


def record(i, payload, **more):
    return W.gzip_member(W.build_record(i, f"http://x/{i}", payload, hashlib.sha1(payload).digest(), len(payload), **more))


def test_reader_round_trip_with_tiny_reads(monkeypatch):
    rng = random.Random(1)
    payloads = [b"", b"\r\n\r\n", bytes(rng.randrange(256) for _ in range(5000)), b"a" * 100_000, "é𝒳".encode() * 100]
    data = b"".join(record(i, p) for i, p in enumerate(payloads))
    for chunk in (1, 7, 1000, 1 << 18):
        monkeypatch.setattr(W, "CHUNK", chunk)
        got = list(W.read_records(io.BytesIO(data), keep_payload=True))
        assert [r["payload"] for r in got] == payloads
        assert [r["payload_digest"] for r in got] == [hashlib.sha1(p).hexdigest() for p in payloads]


def test_a_member_is_a_whole_record_and_headers_are_safe():
    import gzip
    text = gzip.decompress(W.gzip_member(W.build_record(3, "http://x/\r\nEvil: 1", b"p", hashlib.sha1(b"p").digest(), 1)))
    assert text.startswith(b"WARC/1.1\r\n") and text.endswith(b"p\r\n\r\n") and b"\r\nEvil" not in text
    assert b"WARC-Type: revisit" in gzip.decompress(record(1, b"q" * 2000, refers_to=9, is_revisit=True))


@pytest.mark.parametrize("spoil", ["payload", "length", "cut", "junk", "gzip"])
def test_damage_is_found(spoil):
    raw = W.build_record(1, None, b"payload" * 50, hashlib.sha1(b"payload" * 50).digest(), 350)
    if spoil == "payload":
        data = W.gzip_member(raw.replace(b"payloadpayload", b"Payloadpayload", 1))
    elif spoil == "length":
        data = W.gzip_member(re.sub(rb"\r\nContent-Length: (\d+)\r\n\r\nHTTP", b"\r\nContent-Length: 20\r\n\r\nHTTP", raw, count=1))
    elif spoil == "cut":
        data = W.gzip_member(raw)[:-30]
    elif spoil == "junk":
        data = W.gzip_member(raw + b"more")
    else:
        data = b"\x1f\x8bnot gzip at all"
    with pytest.raises(W.WarcError):
        list(W.read_records(io.BytesIO(data)))


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x") for i, u, h in rows], "page_id long, url string, html string, digest string").repartition(3)


def brute(rows):
    out = []
    for i, _, h in rows:
        b = (h or "").encode()
        same = [j for j, _, g in rows if (g or "").encode() == b and j is not None]
        top = max(same, default=None)
        revisit = len(b) >= 1000 and i != top
        out.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if revisit else "response", top if revisit else None))
    return sorted(out, key=str)


ROWS = [(1, "http://a", "x" * 1000), (5, None, "x" * 1000), (3, "http://a", "x" * 1000), (4, "u", "x" * 999), (6, "u", "x" * 999), (7, "u", None),
        (8, "u", ""), (9, "u", "é" * 500), (10, "u", "é" * 500), (11, "u", "<p>" * 200_000), (12, "ü \n", "<p>" * 200_000), (None, "u", "y" * 2000),
        (13, "u", "y" * 2000), (5, "again", "x" * 1000)]


def test_archives_equal_brute_force(spark):
    got = sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"])
                  for r in rows_of(W.archive_round_trip(pages(spark, ROWS)))), key=str)
    assert got == brute(ROWS)


def test_files_roll_and_are_standard(spark):
    import gzip
    files = rows_of(W.write_archives(pages(spark, ROWS).coalesce(1), fresh_path(spark, "warc-test"), file_bytes=300))
    assert len(files) > 3 and sum(f["n_records"] for f in files) == len(ROWS)
    for f in files:
        with gzip.open("/" + f["path"].removeprefix("file:").lstrip("/")) as g:
            assert g.read().count(b"WARC/1.1\r\n") == f["n_records"]


def test_empty(spark):
    assert W.archive_round_trip(pages(spark, [])).count() == 0


def test_a_url_of_two_megabytes():
    raw = [W.build_record(i, u, b"p", hashlib.sha1(b"p").digest(), 1) for i, u in enumerate(["é" * 350_000, "u"])]
    got = list(W.read_records(io.BytesIO(b"".join(map(W.gzip_member, raw))), keep_payload=True))
    assert [r["headers"]["warc-target-uri"] for r in got] == ["%C3%A9" * 350_000, "u"] and [r["payload"] for r in got] == [b"p", b"p"]
    # A header that never ends is still found by the end of its member.
    with pytest.raises(W.WarcError, match="header without an end"):
        list(W.read_records(io.BytesIO(W.gzip_member(b"WARC/1.1\r\n" + b"a" * 3_000_000))))
