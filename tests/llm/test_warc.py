import base64
import hashlib

import pytest
import zstandard

from barloom.llm import warc

SCHEMA = "page_id long, url string, html string, first string, key int"


def test_archive_pages(spark, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE", 4096)
    rows = [(i, f"http://x/{i}", f"<p>{i % 7} é {'y' * (i % 5)}</p>" * 20) for i in range(120)]
    rows += [(500, None, None), (501, "u\r\nx", ""), (502, "u", "big" * 100_000), (None, "n", rows[3][2]), (None, "n", "only"), (0, "http://x/0", rows[0][2])]
    df = spark.createDataFrame([(*r, "f", 1) for r in rows], SCHEMA)
    got = warc.archive_pages(df, payloads=True).collect()
    assert len(got) == len(rows)
    least = {}
    for i, _, h in rows:
        if i is not None:
            least[h or ""] = min(i, least.get(h or "", i))
    by_id = {r.page_id: r for r in got if r.page_id is not None}
    for i, _, h in rows:
        if i is None:
            continue
        r, payload = by_id[i], (h or "").encode()
        assert r.payload_bytes == len(payload)
        assert r.payload_digest == base64.b32encode(hashlib.sha1(payload).digest()).decode()
        first = least[h or ""]
        assert (r.record_type, r.refers_to) == (("response", None) if i == first else ("revisit", first))
        assert r.payload == (payload if i == first else b"")
    assert sorted((r.record_type, r.refers_to) for r in got if r.page_id is None) == [("response", None), ("revisit", 3)]
    assert warc.archive_pages(df.limit(0)).count() == 0


def test_small_payloads_are_responses(spark):
    df = spark.createDataFrame([(1, "u", "aa"), (2, "u", "aa"), (3, "u", "b" * 50), (4, "u", "b" * 50)], "page_id long, url string, html string")
    got = {r.page_id: r.record_type for r in warc.archive_pages(df, least_bytes=10).collect()}
    assert got == {1: "response", 2: "response", 3: "response", 4: "revisit"}


def test_frames_and_dictionary():
    records = [warc.make_record(i, f"http://x/{i}", b"payload %d " % i * 50, None, False, "2024-01-01T00:00:00Z") for i in range(300)]
    data = warc.make_archive(records)
    assert data[:4] == b"\x5d\x2a\x4d\x18"
    assert list(warc.read_archive(data)) == records
    assert list(warc.read_archive(warc.make_archive(records[:1]))) == records[:1]  # too few for training
    plain = b"".join(zstandard.ZstdCompressor().compress(r) for r in records[:3])
    assert list(warc.read_archive(plain)) == records[:3]  # no dictionary
    assert sum(map(len, records)) > 3 * len(data)


def test_validation():
    good = warc.make_record(1, "u", b"abc", None, False, "d")
    assert warc.parse_record(good)["payload"] == b"abc"
    for bad in (good[:-1], good.replace(b"abc", b"abd"), good.replace(b"WARC/1.1", b"WARC/9"), good.replace(b"WARC-Date: d\r\n", b""), good.replace(b"Content-Type: application", b"Content-Type application")):
        with pytest.raises(ValueError):
            warc.parse_record(bad)
    data = warc.make_archive([good])
    with pytest.raises((ValueError, zstandard.ZstdError)):
        list(warc.read_archive(data[:-6]))
